"""Drift from stored sketches (D8, S10): base rows are read once per period.

Each period leaves, for every numeric column, one KLL quantile sketch and the number of
its values, and for every other column its value counts.  Both merge, so a period may
arrive in parts and periods may be put together; any two periods are then
compared from these small tables alone.  Decile edges and the share of values up
to an edge come from the sketches' quantiles at ``GRID`` even ranks.  With ``k`` = 4096 a
rank is off by about 0.15% of the rows and the grid adds 0.1%, so a bin's share is off by up to
half a point.  Category shares are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import drift as D

K = 4096
GRID = 1000


def numeric_sketches(df: DataFrame, by: Sequence[str], cols: Sequence[str], k: int = K) -> DataFrame:
    """(by..., feature, n, sketch) of every numeric column with a value."""
    long = D._long(df, by, cols, True).filter(F.col("v").isNotNull())
    return long.groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("v", F.lit(k)).alias("sketch"))


def category_counts(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(by..., feature, cat, n, known) of every value, null as its own."""
    long = D._long(df, by, cols, False)
    return long.groupBy(*by, "feature", F.coalesce("v", F.lit(D.NA)).alias("cat")).agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("known"))


def merged_sketches(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of parts as one a group."""
    return parts.groupBy(*by, "feature").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def merged_counts(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    return parts.groupBy(*by, "feature", "cat").agg(F.sum("n").alias("n"), F.sum("known").alias("known"))


def numeric_drift(ref: DataFrame, cur: DataFrame, by: Sequence[str], bins: int = 10) -> DataFrame:
    """(by..., feature, score, n_ref, n_cur) from the sketches of both sides; groups that both have."""
    ranks = F.array(*[F.lit(float(p)) for p in D.decile_probs(bins)])
    fine = F.array(*[F.lit((i + 1) / GRID) for i in range(GRID)])
    edges = F.array_sort(F.array_distinct(F.kll_sketch_get_quantile_double("sketch", ranks)))

    def upto(grid: str) -> Column:
        """The share of a side's values up to an edge: of its quantiles, how many lie there."""
        return F.size(F.filter(grid, lambda x: x <= F.col("edge"))) / F.lit(float(GRID))

    r = ref.select(*by, "feature", F.col("n").alias("n_ref"), F.kll_sketch_get_quantile_double("sketch", fine).alias("ref"), edges.alias("e"))
    c = cur.select(*by, "feature", F.col("n").alias("n_cur"), F.kll_sketch_get_quantile_double("sketch", fine).alias("cur"))
    both = c.join(r, [*by, "feature"]).withColumn("inner", F.slice("e", 2, F.greatest(F.size("e") - 2, F.lit(0))))
    # shares up to each inner edge, then 1; a bin's share is the step between two
    steps = both.select(*by, "feature", "n_ref", "n_cur", F.size("e").alias("edges"), F.posexplode_outer("inner").alias("at", "edge"),
                        "ref", "cur")
    upto = steps.select(*by, "feature", "n_ref", "n_cur", "edges", "at",
                        *[F.when(F.col("edge").isNull(), F.lit(1.0)).otherwise(upto(s)).alias(n) for s, n in (("ref", "pr"), ("cur", "pc"))])
    # at most bins - 1 entries a group
    shares = upto.groupBy(*by, "feature", "n_ref", "n_cur", "edges").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("at", F.lit(0)).alias("at"), "pr", "pc"))).alias("s"))

    def cells(side: str):
        ends = F.concat(F.transform("s", lambda x: x[side]), F.array(F.lit(1.0)))
        starts = F.concat(F.array(F.lit(0.0)), F.transform("s", lambda x: x[side]))
        return F.zip_with(ends, starts, lambda a, b: a - b)

    terms = F.zip_with(cells("pr"), cells("pc"), D._psi_term)
    score = F.when(F.col("edges") < 2, 0.0).otherwise(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))
    return shares.select(*by, "feature", score.alias("score"), F.col("n_ref").cast("long").alias("n_ref"), F.col("n_cur").cast("long").alias("n_cur"))


def category_drift(ref: DataFrame, cur: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., feature, score, n_ref, n_cur) from value counts; groups that both have."""
    both = (ref.withColumn("side", F.lit(0)).unionByName(cur.withColumn("side", F.lit(1)))
            .groupBy(*by, "feature", "cat").agg(*[F.sum(F.when(F.col("side") == s, F.col(c)).otherwise(0)).alias(f"{c}{s}")
                                                  for s in (0, 1) for c in ("n", "known")]))
    totals = (both.groupBy(*by, "feature").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), F.sum("known0").alias("n_ref"),
                                               F.sum("known1").alias("n_cur")).filter("t0 > 0 and t1 > 0"))
    term = D._psi_term(F.col("n0") / F.col("t0"), F.col("n1") / F.col("t1"))
    return (both.join(totals, [*by, "feature"]).groupBy(*by, "feature", "n_ref", "n_cur").agg(F.sum(term).alias("score"))
            .select(*by, "feature", "score", F.col("n_ref").cast("long").alias("n_ref"), F.col("n_cur").cast("long").alias("n_cur")))
