import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkpanel.operators.ranking import exact_quantiles, prefix_sums


def test_exact_quantiles_match_numpy_in_many_ranges(spark):
    rng = np.random.default_rng(11)
    rows = [("a", float(v)) for v in np.round(rng.normal(size=3000), 3)] + \
           [("b", float(v)) for v in rng.integers(0, 7, 500)] + [("c", 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    ps = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: r.q for r in exact_quantiles(df, ["k"], "v", ps, n_ranges=6).collect()}
    for k in ("a", "b", "c"):
        vals = np.array([v for kk, v in rows if kk == k])
        assert got[k] == pytest.approx(list(np.quantile(vals, ps)), abs=1e-12)
    spark_pct = df.groupBy("k").agg(F.percentile("v", ps).alias("q")).collect()
    for r in spark_pct:
        assert got[r.k] == pytest.approx(r.q, abs=1e-12)


def test_prefix_sums_global(spark):
    rows = [(float(i), i % 3) for i in range(100)]
    df = spark.createDataFrame(rows, "s double, w long")
    got = {r.s: r.w_before for r in prefix_sums(df, [], "s", ["w"], n_ranges=7).collect()}
    run = 0
    for s, w in rows:
        assert got[s] == run
        run += w


def test_rows_of_a_feature_are_not_dealt_by_it(spark, monkeypatch):
    from sparkpanel.operators import drift as D
    df = spark.range(400).selectExpr("cast(id as double) a", "cast(id % 7 as double) b")
    plans, real = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: plans.append(self._jdf.queryExecution().toString()) or real(self))
    got = {r.feature: (r.score, r.n_ref, r.n_cur) for r in D.numeric_psi(df, df, ["a", "b"]).collect()}
    assert got == {"a": (0.0, 400, 400), "b": (0.0, 400, 400)}
    counting = next(p for p in plans if "c_cur" in p).split("== Physical Plan ==")[1]
    assert "BroadcastHashJoin" in counting and "SortMergeJoin" not in counting
