"""Distributed running sums and exact quantiles.

Both AUC (negatives below each score) and exact quantiles (which value holds
rank r) need a prefix sum over values sorted within a group.  A plain window
``PARTITION BY group ORDER BY value`` would put every distinct value of a
group into one task.  Here values are first combined per distinct value,
then cut into ranges by per-group approximate quantiles (a bounded list of
edges per group), the sum before each range comes from a window over the
small (group, range) total table, and the running sum inside a range is a
window partitioned by (group, range).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Distinct values that one task ranks; the number of ranges of a group grows with its values.
ROWS_PER_RANGE = 2_000_000
STRIDE = 64  # edges that one step of the search for a value's range looks at


def _n_ranges(spark, n_ranges: int | None) -> int:
    if n_ranges is None:
        n_ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, int(n_ranges))


def add_range_index(df: DataFrame, edges: Column, n: int, v: Column, out: str) -> DataFrame:
    """Add how many of the (at most n) ascending edges are <= v.  The search goes down in steps of
    STRIDE edges, each unrolled, so it takes 64 comparisons for each power of 64."""
    span = 1
    while span * STRIDE < n:
        span *= STRIDE
    df = df.withColumn(out, F.lit(0))
    while span >= 1:
        terms = [F.coalesce((F.try_element_at(edges, F.col(out) + i * span) <= v).cast("int"), F.lit(0))
                 for i in range(1, min(STRIDE, -(-n // span)) + 1)]
        df = df.withColumn(out, F.col(out) + span * sum(terms[1:], terms[0]))
        span //= STRIDE
    return df


def _local(spark, rows, schema) -> DataFrame:
    """A small DataFrame from bounded driver-side rows (edges, targets)."""
    return spark.createDataFrame(rows, schema)


def with_ranges(df: DataFrame, keys: Sequence[str], order_col: str, n_ranges: int | None = None,
                out: str = "_rng") -> DataFrame:
    """Add a range index per row: the number of per-group approximate
    quantile edges ``<= order_col``.  The edges are computed in one job and
    kept as a small broadcast table (bounded: #groups x n_ranges values);
    without group keys they become a literal array (no join at all)."""
    spark = df.sparkSession
    n = _n_ranges(spark, n_ranges)
    if n <= 1:
        return df.withColumn(out, F.lit(0))
    keys = list(keys)
    ps = [i / n for i in range(1, n)]
    v = F.col(order_col).cast("double")
    q = F.array_sort(F.array_distinct(F.percentile_approx(v, ps, max(10000, 10 * n)))).alias("_edges")
    if not keys:
        edges = df.agg(q).first()["_edges"] or []
        held = F.lit([float(e) for e in edges]) if edges else F.array().cast("array<double>")
        return add_range_index(df, held, n - 1, v, out)
    edges = df.groupBy(*keys).agg(q)
    edges = _local(spark, edges.collect(), edges.schema)
    j = df.join(F.broadcast(edges), on=keys, how="left")  # dealt by the keys, a group would be one task's
    return add_range_index(j, F.col("_edges"), n - 1, v, out).drop("_edges")


def prefix_sums(df: DataFrame, keys: Sequence[str], order_col: str, weights: Sequence[str],
                n_ranges: int | None = None, suffix: str = "_before") -> DataFrame:
    """For rows unique per (keys, order_col): the sum of each weight over rows
    of the same group with a strictly smaller ``order_col``."""
    cols = list(df.columns)
    keys = list(keys)
    r = with_ranges(df, keys, order_col, n_ranges)
    tot = r.groupBy(*keys, "_rng").agg(*[F.sum(w).alias(f"_t_{w}") for w in weights])
    # bounded: #groups x n_ranges rows (a single small partition without keys)
    wprev = Window.partitionBy(*keys).orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*keys, "_rng", *[F.coalesce(F.sum(f"_t_{w}").over(wprev), F.lit(0)).alias(f"_o_{w}")
                                      for w in weights])
    win = Window.partitionBy(*keys, "_rng").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    inside = r.select("*", *[F.coalesce(F.sum(w).over(win), F.lit(0)).alias(f"_i_{w}") for w in weights])
    j = inside.join(tot, on=[*keys, "_rng"], how="inner")
    return j.select(*cols,
                    *[(F.col(f"_o_{w}") + F.col(f"_i_{w}")).alias(f"{w}{suffix}") for w in weights])


def exact_quantiles(df: DataFrame, keys: Sequence[str], value_col: str, probs: Sequence[float],
                    n_ranges: int | None = None, out: str = "q") -> DataFrame:
    """Exact quantiles with linear interpolation (position ``p * (n - 1)``),
    the same definition as Spark's ``percentile`` and DuckDB's
    ``quantile_cont``, per group: ``(keys..., n, q array<double>)``.

    Work: a distributed value histogram (persisted for the call), the
    prefix sums above, and a lookup of at most ``2 * len(probs)`` ranks per
    group.  Only bounded tables (counts, ranks and found values per group)
    reach the driver; the result is a small table of #groups rows."""
    import math
    from pyspark import StorageLevel
    spark = df.sparkSession
    keys = list(keys)
    v = F.col(value_col).cast("double")
    hist = (df.where(v.isNotNull()).groupBy(*keys, v.alias("_v"))
            .agg(F.count(F.lit(1)).alias("_c"))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        stats = hist.groupBy(*keys).agg(F.sum("_c").alias("n"), F.count(F.lit(1)).alias("_d")).collect()
        ranks_of = {}
        for r in stats:                                                   # #groups rows
            n = int(r["n"])
            rk = set()
            for p in probs:
                x = float(p) * (n - 1)
                rk.update((math.floor(x), math.ceil(x)))
            ranks_of[tuple(r[k] for k in keys)] = (n, sorted(rk))
        if n_ranges is None:
            biggest = max([int(r["_d"]) for r in stats] or [0])
            n_ranges = max(1, -(-biggest // ROWS_PER_RANGE))
        ps = prefix_sums(hist, keys, "_v", ["_c"], n_ranges)
        lo, hi = F.col("_c_before"), F.col("_c_before") + F.col("_c")
        if keys:
            tschema = T.StructType([*[hist.schema[k] for k in keys],
                                    T.StructField("_ranks", T.ArrayType(T.LongType()))])
            targets = _local(spark, [(*k, rk) for k, (_, rk) in ranks_of.items()], tschema)
            hit = ps.join(F.broadcast(targets), on=keys, how="inner")  # a row a group, from the driver
            ranks = F.col("_ranks")
        else:
            hit = ps
            ranks = F.array(*[F.lit(int(x)) for x in (ranks_of.get((), (0, []))[1] or [-1])])
        hit = hit.select(*keys, "_v", F.explode(F.filter(ranks, lambda r: (r >= lo) & (r < hi))).alias("_r"))
        found = {}
        for r in hit.collect():                                           # <= 2*len(probs) per group
            found.setdefault(tuple(r[k] for k in keys), {})[int(r["_r"])] = float(r["_v"])
    finally:
        hist.unpersist()
    rows = []
    for key, (n, _) in ranks_of.items():
        vals = found.get(key, {})
        qs = []
        for p in probs:
            x = float(p) * (n - 1)
            lo_r, hi_r = math.floor(x), math.ceil(x)
            vlo, vhi = vals.get(lo_r), vals.get(hi_r)
            if vlo is None or vhi is None:
                qs.append(None)
            elif lo_r == hi_r or vlo == vhi:
                qs.append(vlo)
            else:  # same arithmetic as Spark's percentile
                qs.append((hi_r - x) * vlo + (x - lo_r) * vhi)
        rows.append((*key, n, qs))
    schema = T.StructType([*[hist.schema[k] for k in keys], T.StructField("n", T.LongType()),
                           T.StructField(out, T.ArrayType(T.DoubleType()))])
    return _local(spark, rows, schema)
