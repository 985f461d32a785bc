"""Key and data-quality checks.

Every check is one aggregate over the table (partial aggregation before the
shuffle), producing a small report DataFrame; the ``assert_*`` helpers run
that aggregate and raise on violations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import no_nan


def id_quality(df: DataFrame, id_col: str, by: Sequence[str] = ()) -> DataFrame:
    """rows, NULL ids, duplicate ids (rows beyond the first) per group.

    The distinct count is planned as a two-level aggregate keyed by
    ``(by, id)``, so a hot id is combined map-side.
    """
    idc = F.col(id_col)
    return (df.groupBy(*by)
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count_if(idc.isNull()).alias("n_null_ids"),
                 (F.count(idc) - F.count_distinct(idc)).alias("n_duplicate_ids")))


def assert_unique_ids(df: DataFrame, id_col: str, period=None) -> None:
    if id_col not in df.columns:
        raise ValueError(f"id column '{id_col}' does not exist (period {period})")
    r = id_quality(df, id_col).first()
    if r["n_null_ids"]:
        raise ValueError(f"id column '{id_col}' has {r['n_null_ids']} NULLs (period {period})")
    if r["n_duplicate_ids"]:
        raise ValueError(f"id column '{id_col}' has {r['n_duplicate_ids']} duplicates (period {period})")


def common_ids(df_t: DataFrame, df_t1: DataFrame, id_col: str) -> DataFrame:
    """Distinct ids present in both tables (compared as strings, Q7)."""
    a = df_t.select(F.col(id_col).cast("string").alias(id_col)).where(F.col(id_col).isNotNull())
    b = df_t1.select(F.col(id_col).cast("string").alias(id_col)).where(F.col(id_col).isNotNull())
    return a.intersect(b)


def coverage_report(df_t: DataFrame, df_t1: DataFrame, id_col: str) -> DataFrame:
    """One row ``(n_t, n_t1, n_common)`` of distinct string ids.

    One keyed aggregate over both sides (rows per id and side, combined
    map-side), then one global aggregate; no per-side collect."""
    k = F.col(id_col).cast("string").alias("k")
    both = (df_t.select(k, F.lit(0).alias("s")).unionByName(df_t1.select(k, F.lit(1).alias("s")))
            .where(F.col("k").isNotNull()))
    per = both.groupBy("k").agg(F.count_if(F.col("s") == 0).alias("c0"), F.count_if(F.col("s") == 1).alias("c1"))
    return per.agg(F.count_if(F.col("c0") > 0).alias("n_t"), F.count_if(F.col("c1") > 0).alias("n_t1"),
                   F.count_if((F.col("c0") > 0) & (F.col("c1") > 0)).alias("n_common"))


def assert_common_ids(df_t: DataFrame, df_t1: DataFrame, id_col: str, year_t=None, year_t1=None,
                      *, min_common: int = 1) -> dict:
    r = coverage_report(df_t, df_t1, id_col).first().asDict()
    r.update(year_t=year_t, year_t1=year_t1, id_col=id_col)
    if r["n_common"] < min_common:
        raise ValueError(f"not enough common ids between {year_t} and {year_t1}: "
                         f"common={r['n_common']} (min_common={min_common})")
    return r


def coverage_by_period(panel: DataFrame, id_col: str, period_col: str = "ano",
                       step: int = 1) -> DataFrame:
    """F6 for every consecutive period pair of a panel in one job:
    ``(year_t, year_t1, n_t, n_t1, n_common)``.

    Distinct (id, period) keys, then ``lead()`` over each id's periods flags
    the ids also present in ``period + step``; one aggregate per period and
    a join of that (#periods-row) table with itself shifted.  Periods with
    no ``t+1`` rows are dropped."""
    from pyspark.sql import Window
    keys = (panel.select(F.col(id_col).cast("string").alias("k"), F.col(period_col).alias("p"))
            .where(F.col("k").isNotNull()).distinct())
    w = Window.partitionBy("k").orderBy("p")
    flagged = keys.withColumn("_both", F.lead("p").over(w) == F.col("p") + step)
    per = flagged.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_if("_both").alias("n_common"))
    nxt = per.select((F.col("p") - step).alias("p"), F.col("n").alias("n_t1"))
    return (per.join(nxt, "p", "inner")
            .select(F.col("p").cast("int").alias("year_t"), (F.col("p") + step).cast("int").alias("year_t1"),
                    F.col("n").alias("n_t"), "n_t1", "n_common"))


def pair_input_report(df_t: DataFrame, df_t1: DataFrame, id_col: str) -> dict:
    """F4+F5 on both sides and F6 in ONE job: per id (as string) the rows on
    each side (a keyed aggregate, hot ids combined map-side), then one
    global aggregate of that.  Returns NULL/duplicate counts per side and the
    distinct / common id counts."""
    k = F.col(id_col).cast("string").alias("k")
    both = (df_t.select(k, F.lit(0).alias("s"))
            .unionByName(df_t1.select(k, F.lit(1).alias("s"))))
    per = both.groupBy("k").agg(F.count_if(F.col("s") == 0).alias("c0"),
                                F.count_if(F.col("s") == 1).alias("c1"))
    known = F.col("k").isNotNull()
    r = per.agg(
        F.sum(F.when(~known, F.col("c0")).otherwise(0)).alias("null_t"),
        F.sum(F.when(~known, F.col("c1")).otherwise(0)).alias("null_t1"),
        F.sum(F.when(known & (F.col("c0") > 1), F.col("c0") - 1).otherwise(0)).alias("dup_t"),
        F.sum(F.when(known & (F.col("c1") > 1), F.col("c1") - 1).otherwise(0)).alias("dup_t1"),
        F.count_if(known & (F.col("c0") > 0)).alias("n_t"),
        F.count_if(known & (F.col("c1") > 0)).alias("n_t1"),
        F.count_if(known & (F.col("c0") > 0) & (F.col("c1") > 0)).alias("n_common")).first()
    return {key: int(r[key] or 0) for key in r.asDict()}


def validate_pair_inputs(df_t: DataFrame, df_t1: DataFrame, id_col: str, year_t=None, year_t1=None,
                         min_common: int = 1) -> dict:
    """The reference's three pair checks, in its order, from one job."""
    for side, df, year in (("t", df_t, year_t), ("t1", df_t1, year_t1)):
        if id_col not in df.columns:
            raise ValueError(f"id column '{id_col}' does not exist (period {year})")
    r = pair_input_report(df_t, df_t1, id_col)
    for side, year in (("t", year_t), ("t1", year_t1)):
        if r[f"null_{side}"]:
            raise ValueError(f"id column '{id_col}' has {r[f'null_{side}']} NULLs (period {year})")
        if r[f"dup_{side}"]:
            raise ValueError(f"id column '{id_col}' has {r[f'dup_{side}']} duplicates (period {year})")
    if r["n_common"] < min_common:
        raise ValueError(f"not enough common ids between {year_t} and {year_t1}: "
                         f"common={r['n_common']} (min_common={min_common})")
    return r


def basic_stats(df: DataFrame, y_col: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """A1+A2+A3+A4 in ONE aggregate: rows, columns, mean missing rate over
    all cells (every column counts, Q22), target counts incl. NULL, positive
    rate."""
    cols = df.columns
    n_cols = len(cols)
    nulls = [F.count_if(no_nan(F.col(f"`{f.name}`"), f.dataType).isNull()) for f in df.schema.fields]
    total_nulls = nulls[0]
    for e in nulls[1:]:
        total_nulls = total_nulls + e
    y = F.col(y_col)
    n = F.count(F.lit(1))
    return (df.groupBy(*by)
            .agg(n.alias("n_rows"),
                 F.lit(n_cols).alias("n_cols"),
                 (total_nulls.cast("double") / (n * F.lit(n_cols))).alias("missing_rate"),
                 F.count_if(y == 0).alias("n_y0"),
                 F.count_if(y == 1).alias("n_y1"),
                 F.count_if(y.isNull()).alias("n_y_null"),
                 F.avg(y.cast("double")).alias("pos_rate")))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(feature, n_rows, n_nonnull, n_null, all_null)`` per column,
    from ONE aggregate of ``count(c)`` over all columns, unpivoted."""
    cols = list(columns or df.columns)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    agg = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count(no_nan(F.col(f"`{c}`"), kinds[c])).alias(f"c{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c.replace(chr(39), chr(39) * 2)}', c{i}" for i, c in enumerate(cols))
    long = agg.selectExpr("__n", f"stack({len(cols)}, {stack}) AS (feature, n_nonnull)")
    return long.select("feature", F.col("__n").alias("n_rows"), "n_nonnull",
                       (F.col("__n") - F.col("n_nonnull")).alias("n_null"),
                       (F.col("n_nonnull") == 0).alias("all_null"))


def check_pair_table(pairs: DataFrame, target: str = "y", period_col: str = "ano") -> DataFrame:
    """schema checks (target present, period absent) and a one-row count
    of targets outside {0, 1} (NULL included)."""
    if target not in pairs.columns:
        raise ValueError(f"pair table lacks target column '{target}'")
    if period_col in pairs.columns:
        raise ValueError(f"pair table must not contain '{period_col}'")
    y = F.col(target)
    return pairs.agg(F.count_if(y.isNull() | ~y.isin(0, 1)).alias("n_bad_target"),
                     F.count(F.lit(1)).alias("n_rows"))
