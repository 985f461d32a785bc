"""Projection and schema operators.

All of these only rewrite the logical plan (names, projections, literals);
the single data-dependent one, ``drop_all_null_features`` (P20), runs one
aggregate of ``count(c)`` over all candidate columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import dedupe_names, infer_id_columns, matching, normalize_colname, with_prefix
from ..functions.scalar import no_nan


def q(name: str):
    """Column reference that tolerates odd characters in names."""
    return F.col(f"`{name}`")


# ------------------------------------------------------------------ P2-P11
def normalize_columns(df: DataFrame) -> DataFrame:
    """Normalise every name (P1); collisions get ``_1``, ``_2`` suffixes."""
    names = dedupe_names([normalize_colname(c) or "col" for c in df.columns])
    return df.toDF(*names)


def add_period(df: DataFrame, period: int, col: str = "ano") -> DataFrame:
    """P3."""
    return df.withColumn(col, F.lit(int(period)))


def rename_if_present(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename only the names that exist."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def drop_if_present(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """P5."""
    existing = [c for c in cols if c in df.columns]
    return df.drop(*existing) if existing else df


def drop_by_prefix(df: DataFrame, prefixes: Iterable[str]) -> DataFrame:
    """P6 (loose form): drop every name that starts with a prefix."""
    return drop_if_present(df, with_prefix(df.columns, prefixes))


def drop_by_pattern(df: DataFrame, pattern: str) -> DataFrame:
    """Drop every name fully matching ``pattern``."""
    return drop_if_present(df, matching(df.columns, pattern))


def coalesce_into(df: DataFrame, target: str, candidates: Sequence[str]) -> DataFrame:
    """``target = coalesce(target, c1, c2, ...)``; candidates dropped."""
    cands = [c for c in candidates if c in df.columns and c != target]
    if not cands:
        return df if target in df.columns else df.withColumn(target, F.lit(None).cast("string"))
    parts = ([q(target)] if target in df.columns else []) + [q(c) for c in cands]
    if target in df.columns:
        return df.withColumn(target, F.coalesce(*parts)).drop(*cands)
    # new column takes the place of the first candidate
    out = []
    for c in df.columns:
        if c == cands[0]:
            out.append(F.coalesce(*parts).alias(target))
        elif c not in cands:
            out.append(q(c))
    return df.select(*out)


def unify_variants(df: DataFrame, base: str, prefer: str = "first") -> DataFrame:
    """Collapse ``base_<2-4 digits>`` into ``base`` (left-most non-NULL
    wins with ``prefer='first'``, newest suffix with ``'latest'``; Q5)."""
    variants = matching(df.columns, rf"{re.escape(base)}_\d{{2,4}}")
    if not variants:
        return df
    if prefer == "latest":
        variants = sorted(variants, key=lambda c: int(c.rsplit("_", 1)[1]), reverse=True)
    return coalesce_into(df, base, variants)


def add_missing_null(df: DataFrame, col: str, dtype: str = "double") -> DataFrame:
    """P11."""
    return df if col in df.columns else df.withColumn(col, F.lit(None).cast(dtype))


# ------------------------------------------------------------------ P12-P14
def split_xy(df: DataFrame, target: str = "y", id_col: str | None = "ra",
             drop_cols: Sequence[str] = ("year_t", "year_t1", "ano")) -> tuple[list[str], DataFrame]:
    """Feature names, and the table with ``y`` cast to int."""
    if target not in df.columns:
        raise ValueError(f"target column '{target}' not found")
    skip = {target, *(c for c in drop_cols)}
    if id_col:
        skip.add(id_col)
    feats = [c for c in df.columns if c not in skip]
    return feats, df.withColumn(target, F.col(target).cast("int"))


@dataclass(frozen=True)
class FeatureSelection:
    selected: list[str]
    numeric: list[str]
    categorical: list[str]
    dropped: list[str] = field(default_factory=list)


# Name fragments that mark a t+1 (future) column.
LEAK_NAME_FRAGMENTS = ("_t+1", "_tp1", "t+1")


def is_numeric_type(dt: T.DataType) -> bool:
    """Numeric for features and drift; booleans count as categorical (Q19)."""
    return isinstance(dt, T.NumericType)


def select_feature_columns(df: DataFrame, target: str = "y", id_columns: Iterable[str] | None = None,
                           exact_exclude: Iterable[str] | None = None,
                           pattern_exclude: Iterable[str] = LEAK_NAME_FRAGMENTS) -> FeatureSelection:
    """Drop target, ids and t+1-looking names; split by type."""
    ids = set(infer_id_columns(df.columns) if id_columns is None else id_columns)
    exact = set(exact_exclude or {target}) | {target}
    frags = [p.lower() for p in pattern_exclude]
    sel, dropped = [], []
    for c in df.columns:
        if c in exact or c in ids or any(p in c.lower() for p in frags):
            dropped.append(c)
        else:
            sel.append(c)
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    num = [c for c in sel if is_numeric_type(types[c])]
    cat = [c for c in sel if c not in num]
    return FeatureSelection(sel, num, cat, sorted(dropped))


def feature_kinds(df: DataFrame, cols: Sequence[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical)."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    num = [c for c in cols if is_numeric_type(types[c])]
    return num, [c for c in cols if c not in num]


# ------------------------------------------------------------------ P16-P20
META_COLS = ("ra", "year_t", "year_t1", "y")


def align_to_schema(train: DataFrame, other: DataFrame, keep: Sequence[str] = META_COLS) -> DataFrame:
    """``other`` gets train's columns in train's order; absent ones are
    NULL of the train type; extras dropped; meta columns of ``other`` kept."""
    other_cols = set(other.columns)
    out = []
    for f in train.schema.fields:
        if f.name in other_cols:
            out.append(q(f.name).cast(f.dataType).alias(f.name))
        else:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
    names = {f.name for f in train.schema.fields}
    out += [q(c) for c in keep if c in other_cols and c not in names]
    return other.select(*out)


def reindex(df: DataFrame, features: Sequence[str], types: Mapping[str, T.DataType] | None = None) -> DataFrame:
    """Lenient projection, absent features as NULL."""
    have = set(df.columns)
    types = types or {}
    out = []
    for c in features:
        dt = types.get(c, T.DoubleType())
        out.append(q(c) if c in have else F.lit(None).cast(dt).alias(c))
    return df.select(*out)


def strict_select(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Projection that fails listing missing features."""
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    return df.select(*[q(c) for c in features])


def schema_diff(train: DataFrame, test: DataFrame, exclude: Iterable[str] = META_COLS) -> dict:
    """Sorted names missing from / extra in ``test``."""
    ex = set(exclude)
    a = {c for c in train.columns if c not in ex}
    b = {c for c in test.columns if c not in ex}
    return {"missing_in_test": sorted(a - b), "extra_in_test": sorted(b - a)}


def common_columns(ref: DataFrame, cur: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """U4: columns of ``ref`` (in its order) also in ``cur``, minus exclusions."""
    ex, have = set(exclude), set(cur.columns)
    return [c for c in ref.columns if c in have and c not in ex]


def all_null_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """One aggregate ``count(c)`` for every column (bounded result)."""
    if not cols:
        return []
    kinds = {f.name: f.dataType for f in df.schema.fields}
    row = df.agg(*[F.count(no_nan(q(c), kinds[c])).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"c{i}"] == 0]


def drop_all_null_features(train: DataFrame, other: DataFrame, features: Sequence[str]):
    """P20: features that are 100% NULL in train are removed from both."""
    dead = all_null_columns(train, [c for c in features if c in train.columns])
    return drop_if_present(train, dead), drop_if_present(other, dead), dead


# ------------------------------------------------------------------ P22-P26
# The closed list of known feature names, in order.
FEATURE_NAMES = (
    "fase", "turma", "ano_nasc", "genero", "ano_ingresso", "instituicao_de_ensino",
    "no_av", "rec_av1", "rec_av2", "rec_av3", "rec_av4", "iaa", "ieg", "ips",
    "rec_psicologia", "ida", "matem", "portug", "ingles", "indicado", "atingiu_pv",
    "ipv", "ian", "fase_ideal", "defas", "pedra", "idade", "ipp", "tenure",
    "gap_fase", "pedra_ord", "rec_av_count",
)


def resolve_features(feature_set: str = "all", variables: Sequence[str] | None = None,
                     known: Sequence[str] = FEATURE_NAMES) -> list[str]:
    """``all`` = the known list; ``selected``/``custom`` need a list."""
    if feature_set == "all":
        return list(known)
    if feature_set in ("selected", "custom"):
        if not variables:
            raise ValueError(f"feature_set='{feature_set}' requires a list of variables")
        return list(dict.fromkeys(variables))
    raise ValueError(f"unknown feature_set {feature_set!r}")


def allow_list(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Keep allowed names (ordered, de-duplicated) that are present."""
    feats = list(dict.fromkeys(features))
    if not feats:
        raise ValueError("select at least one feature")
    return df.select(*[q(c) for c in feats if c in df.columns])


# Columns that are never model input.
NON_FEATURE_COLS = ("y", "year_t", "year_t1", "ano")


def drop_non_features(df: DataFrame, cols: Iterable[str] = NON_FEATURE_COLS) -> DataFrame:
    """P24."""
    return drop_if_present(df, cols)


# The known features in order, which of them are derived, and what they hold (worded here).
DEFAULT_DICTIONARY = (
    ("fase", "learning phase of the student", False),
    ("turma", "class within the phase", False),
    ("ano_nasc", "year of birth", False),
    ("genero", "gender as coded in the table", False),
    ("ano_ingresso", "year in which the student joined", False),
    ("instituicao_de_ensino", "school in the year", False),
    ("no_av", "number of assessments in the year", False),
    ("rec_av1", "recommendation of the first assessment team", False),
    ("rec_av2", "recommendation of the second assessment team", False),
    ("rec_av3", "recommendation of the third assessment team", False),
    ("rec_av4", "recommendation of the fourth assessment team", False),
    ("iaa", "self-assessment indicator, mean of the year", False),
    ("ieg", "engagement indicator, mean of the year", False),
    ("ips", "psychosocial indicator, mean of the year", False),
    ("rec_psicologia", "recommendation of the psychology team", False),
    ("ida", "learning indicator, mean of the year", False),
    ("matem", "mathematics mark of the year", False),
    ("portug", "Portuguese mark of the year", False),
    ("ingles", "English mark of the year", False),
    ("indicado", "whether the student was put forward for a scholarship", False),
    ("atingiu_pv", "whether the turning point was reached in the year", False),
    ("ipv", "turning-point indicator, mean of the year", False),
    ("ian", "indicator of being at the right level", False),
    ("fase_ideal", "phase in which the student should be", False),
    ("defas", "gap in levels in the year", False),
    ("pedra", "class of the student by the development index", False),
    ("idade", "age in the year", False),
    ("ipp", "psychopedagogic indicator, mean of the year", False),
    ("tenure", "years since joining", False),
    ("gap_fase", "ideal phase less phase", True),
    ("pedra_ord", "class as an ordinal number", True),
    ("rec_av_count", "number of recommendations given", True),
)


def feature_dictionary(spark, rows: Sequence[tuple[str, str, bool]] = DEFAULT_DICTIONARY) -> DataFrame:
    """A small dimension table ``(feature, description, derived)``; join
    it with ``describe_features`` (Spark broadcasts it while it is small)."""
    return spark.createDataFrame(list(rows), "feature string, description string, derived boolean")


def describe_features(features: DataFrame, dictionary: DataFrame, col: str = "feature") -> DataFrame:
    """Enrich a feature list with the dictionary (bounded broadcast)."""
    return features.join(dictionary, on=col, how="left")
