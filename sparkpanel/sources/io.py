"""Sources and sinks.

Readers resolve a path to a DataFrame lazily; Spark checks existence when
the relation is created, which we surface as one ``SourceNotFound`` error.
Writers are plain ``DataFrameWriter`` calls; partitioned layout
(``partitionBy(period)``) replaces the reference's one-file-per-year naming so
that a period filter prunes files.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import csv_split
from ..functions.names import dedupe_names, normalize_colname
from ..functions.scalar import no_nan

# Tokens the reference's CSV reader treats as missing.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
             "n/a", "nan", "null")


class SourceNotFound(FileNotFoundError):
    """A required input is missing."""


def _guard(fn, path):
    try:
        return fn()
    except AnalysisException as exc:  # PATH_NOT_FOUND and friends
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            raise SourceNotFound(f"input not found: {path}") from exc
        raise


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """S2."""
    paths = [path] if isinstance(path, str) else list(path)
    return _guard(lambda: spark.read.parquet(*paths), path)


def read_csv_strings(spark: SparkSession, path: str, sep: str = ";",
                     encoding: str = "utf-8", normalize_names: bool = True,
                     na_tokens: Iterable[str] = NA_TOKENS, multi_line: bool | str = "split") -> DataFrame:
    """Header CSV read with every column as string (no inference, so
    ``007`` stays ``007``), names normalised (P2) and NA tokens -> NULL.

    The raw header row is read first (one row) and normalised/de-duplicated
    here, because Spark's own header handling renames duplicates
    case-insensitively before normalisation could see them (Q10).

    Quoted fields may hold line breaks and doubled quotes.  ``multi_line="split"`` reads such files in
    splits (``csv_split``); where a quote stands outside a quoted field, or the encoding is not UTF-8, and
    with ``multi_line=True``, each file is read by one task.  ``False`` takes every line as a record."""
    opts = dict(sep=sep, encoding=encoding, multiLine=bool(multi_line), quote='"', escape='"')
    head = _guard(lambda: spark.read.options(header=False, **opts).csv(path).first(), path)
    if head is None:
        raise SourceNotFound(f"empty input: {path}")
    raw = [(h or "").lstrip("\ufeff") for h in head]
    names = dedupe_names([normalize_colname(c) or "col" for c in raw]) if normalize_names \
        else dedupe_names([c or "col" for c in raw])
    schema = T.StructType([T.StructField(n, T.StringType(), True) for n in names])
    df = _split_csv(spark, path, schema, sep) if multi_line == "split" and encoding.lower() in UTF8 else None
    if df is None:
        df = spark.read.schema(schema).options(header=True, enforceSchema=True, **opts).csv(path)
    tokens = list(na_tokens)
    if not tokens:
        return df
    return df.select(*[F.when(F.trim(F.col(f"`{n}`")).isin(tokens), F.lit(None).cast("string"))
                       .otherwise(F.col(f"`{n}`")).alias(n) for n in names])


UTF8 = ("utf-8", "utf8")


def _split_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str) -> DataFrame | None:
    """The rows of a CSV path read in splits, or None where the quotes don't allow it."""
    rows = csv_split.records(spark, path)
    if not rows.filter(~csv_split.well_formed(F.col("text"), sep)).isEmpty():
        return None
    # one more column than the schema would be dropped by either reader, one fewer is NULL
    opts = dict(sep=sep, quote='"', escape='"', multiLine="true", mode="PERMISSIVE")
    return rows.select(F.from_csv("text", _ddl(schema), opts).alias("r")).select("r.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema.fields)


def lossless_types(df: DataFrame) -> DataFrame:
    """Text columns whose every value is a plainly written number become long or double (one
    aggregate over all columns); ``007`` or a number too long for a long keeps its column text (Q8)."""
    cols = [f"`{c}`" for c in df.columns]
    whole, real = "^-?(0|[1-9][0-9]{0,17})$", r"^-?(0|[1-9][0-9]{0,14})(\.[0-9]{1,15})?$"
    seen = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.count(c).alias(f"n{i}"), F.count_if(F.col(c).rlike(whole)).alias(f"w{i}"),
        F.count_if(F.col(c).rlike(real)).alias(f"r{i}"))]).first()

    def kind(i: int) -> str:
        n = seen[f"n{i}"]
        return "string" if not n else "long" if seen[f"w{i}"] == n else "double" if seen[f"r{i}"] == n else "string"

    return df.select(*[F.col(c).cast(kind(i)).alias(name) for i, (c, name) in enumerate(zip(cols, df.columns))])


def read_table(spark: SparkSession, path: str, csv_sep: str = ",", multi_line: bool | str = "split") -> DataFrame:
    """Dispatch on suffix: ``.parquet``, a name without a suffix (a folder that Spark wrote) as
    Parquet too, ``.csv`` / ``.csv.gz`` with the types that lose nothing.  NaN becomes NULL.
    ``multi_line`` as in ``read_csv_strings``."""
    low = path.lower().rstrip("/")
    if low.endswith((".csv", ".csv.gz")):
        return lossless_types(read_csv_strings(spark, path, sep=csv_sep, normalize_names=False,
                                               multi_line=multi_line))
    if low.endswith(".parquet") or "." not in low.rsplit("/", 1)[-1]:
        df = read_parquet(spark, path)
        return df.select(*[no_nan(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
    raise ValueError(f"unsupported table format: {path}")


def read_first_available(spark: SparkSession, directory: str, stem: str,
                         csv_sep: str = ";", multi_line: bool | str = "split") -> DataFrame:
    """Prefer ``<stem>.parquet``, then the folder ``<stem>`` that ``jobs.build_dataset`` writes, else
    ``<stem>.csv.gz`` (``;``), else error."""
    base = directory.rstrip("/")
    for name in (f"{stem}.parquet", stem, f"{stem}.csv.gz"):
        try:
            return read_table(spark, f"{base}/{name}", csv_sep, multi_line)
        except SourceNotFound:
            continue
    raise SourceNotFound(f"no {stem}.parquet, {stem} or {stem}.csv.gz in {base}")


def load_periods(spark: SparkSession, paths: Mapping[int, str], period_col: str = "ano",
                 reader=None, multi_line: bool | str = "split") -> DataFrame:
    """S3: one panel DataFrame from one table per period (union by name,
    missing columns as NULL)."""
    reader = reader or (lambda p: read_table(spark, p, multi_line=multi_line))
    out = None
    for period, p in sorted(paths.items()):
        df = reader(p).withColumn(period_col, F.lit(int(period)))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no periods given")
    return out


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: Iterable[str] | None = None, mode: str = "overwrite",
                sep: str = ";", compression: str | None = None) -> None:
    """Parquet or CSV (``;`` and optional gzip)."""
    w = df.write.mode(mode)
    parts = list(partition_by or [])
    if parts:
        w = w.partitionBy(*parts)
    if fmt == "parquet":
        w.parquet(path)
    elif fmt == "csv":
        w = w.option("header", True).option("sep", sep)
        if compression:
            w = w.option("compression", compression)
        w.csv(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Reports are small DataFrames written as JSON lines."""
    df.coalesce(1).write.mode(mode).json(path)


def load_train_test(spark: SparkSession, train_path: str, test_path: str,
                    multi_line: bool | str = "split") -> tuple[DataFrame, DataFrame]:
    """Both pair tables (split into X/y with ``schema.split_xy``)."""
    return read_table(spark, train_path, multi_line=multi_line), read_table(spark, test_path, multi_line=multi_line)
