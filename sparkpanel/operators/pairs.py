"""Temporal pairs.

A pair row holds an entity's period-``t`` features and a target derived only
from its period-``t+1`` row.  Two period tables pair by one inner equi-join
in which only the id and the target cross from the ``t+1`` side; a whole
panel pairs all its periods with one ``lead()`` window keyed by the id.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import detect_id_column
from ..functions.scalar import target_not_equal
from .quality import validate_pair_inputs

# The reference target is 0 when the t+1 indicator equals 10.
DEFAULT_TARGET_COL = "ian"
DEFAULT_TARGET_VALUE = 10
OPERATIONAL_COLS = ("ano",)


def default_target(col: str = DEFAULT_TARGET_COL, value=DEFAULT_TARGET_VALUE) -> Callable[[DataFrame], Column]:
    return lambda df: target_not_equal(F.col(col), value)


def _pair_columns(features: DataFrame, id_col: str, drop: Sequence[str]) -> list[str]:
    skip = set(drop) | {id_col}
    return [c for c in features.columns if c not in skip]


def temporal_pair(df_t: DataFrame, df_t1: DataFrame, year_t: int, year_t1: int, *,
                  id_col: str | None = None, target_col: str = DEFAULT_TARGET_COL,
                  target_value=DEFAULT_TARGET_VALUE,
                  drop_feature_cols: Sequence[str] = OPERATIONAL_COLS,
                  validate: bool = True, min_common: int = 1) -> DataFrame:
    """``[id, year_t, year_t1, y, features of t...]`` for ids present in both.

    ``validate`` runs the reference's checks in one job: ids non-null and
    unique per period, at least ``min_common`` shared ids.
    """
    if id_col is None:
        id_col = detect_id_column(df_t.columns)
    if id_col not in df_t1.columns:
        raise ValueError(f"id column '{id_col}' not found in period {year_t1}")
    if target_col not in df_t1.columns:
        raise ValueError(f"column '{target_col}' not found in period {year_t1}")
    if validate:
        validate_pair_inputs(df_t, df_t1, id_col, year_t, year_t1, min_common=min_common)
    # ids compare as text (Q7), so '007' and 7 are different ids
    right = df_t1.select(F.col(id_col).cast("string").alias("_id_t1"),
                         target_not_equal(F.col(target_col), target_value).alias("_y"))
    feats = _pair_columns(df_t, id_col, drop_feature_cols)
    left = df_t.withColumn("_id_t", F.col(id_col).cast("string"))
    return (left.join(right, F.col("_id_t") == F.col("_id_t1"), how="inner")
            .select(F.col(id_col), F.lit(int(year_t)).alias("year_t"),
                    F.lit(int(year_t1)).alias("year_t1"), F.col("_y").alias("y"), *[F.col(c) for c in feats]))


def assert_one_row_per_period(panel: DataFrame, id_col: str, period_col: str) -> None:
    """Stop with an error if an (id, period) has several rows (ids as text; NULL ids never pair)."""
    twice = (panel.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("id"), period_col)
             .agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(5).collect())
    if twice:
        raise ValueError(f"several rows for one id and period: {[(r[0], r[1], r[2]) for r in twice]}")


def all_pairs(panel: DataFrame, *, id_col: str, period_col: str = "ano",
              target: Callable[[DataFrame], Column] | None = None, step: int = 1,
              drop_feature_cols: Sequence[str] = (), validate: bool = True) -> DataFrame:
    """Every consecutive pair of a panel in ONE pass.

    ``lead()`` over ``PARTITION BY id ORDER BY period`` brings the next
    period's target onto each row; a row pairs only when that next period is
    exactly ``period + step``.  The panel is read once and shuffled once by
    id; each id holds at most #periods rows, so a hot id cannot skew it.
    Rows without an id pair with nothing.  ``validate`` stops with an error if an (id, period) has
    several rows; skip it only for a panel that an aggregate by (id, period) has just made.
    """
    target = target or default_target()
    if validate:
        assert_one_row_per_period(panel, id_col, period_col)
    panel = panel.where(F.col(id_col).isNotNull())
    w = Window.partitionBy(F.col(id_col).cast("string")).orderBy(period_col)
    feats = _pair_columns(panel, id_col, set(drop_feature_cols) | {period_col})
    nxt = panel.select(F.col(id_col), F.col(period_col), *[F.col(c) for c in feats],
                       F.lead(F.col(period_col)).over(w).alias("_next"),
                       F.lead(target(panel)).over(w).alias("y"))
    return (nxt.where(F.col("_next") == F.col(period_col) + F.lit(step))
            .select(F.col(id_col), F.col(period_col).cast("int").alias("year_t"),
                    (F.col(period_col) + F.lit(step)).cast("int").alias("year_t1"),
                    F.col("y"), *[F.col(c) for c in feats]))


def keep_common_ids(df_t: DataFrame, df_t1: DataFrame, id_col: str) -> DataFrame:
    """rows of ``df_t`` whose id also occurs in ``df_t1`` (left-semi
    against the distinct ids, so repeated ids on the right are combined
    map-side before the shuffle)."""
    ids = df_t1.select(F.col(id_col).cast("string").alias("_id_t1")).distinct()
    return df_t.join(ids, df_t[id_col].cast("string") == F.col("_id_t1"), how="left_semi")


def target_summary(pairs: DataFrame, by: Sequence[str] = ("year_t", "year_t1")) -> DataFrame:
    """A3+A4 per pair: rows, positives, negatives, NULL targets, positive rate."""
    y = F.col("y")
    return (pairs.groupBy(*by)
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.sum(F.when(y == 1, 1).otherwise(0)).cast("long").alias("n_pos"),
                 F.sum(F.when(y == 0, 1).otherwise(0)).cast("long").alias("n_neg"),
                 F.sum(F.when(y.isNull(), 1).otherwise(0)).cast("long").alias("n_null"),
                 F.avg(y.cast("double")).alias("pos_rate")))


def target_counts(pairs: DataFrame, by: Sequence[str] = ("year_t",)) -> DataFrame:
    """A3: counts per target value, NULL included."""
    return pairs.groupBy(*by, "y").agg(F.count(F.lit(1)).alias("n"))
