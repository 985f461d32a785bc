import numpy as np
import pytest

from sparkpanel.operators import drift as D


def _np_psi(ref, cur, bins=10):
    edges = np.unique(np.quantile(ref, np.linspace(0, 1, bins + 1)))
    if len(edges) < 2:
        return 0.0
    inner = edges[1:-1]
    rb = np.array([np.sum(inner < v) for v in ref])
    cb = np.array([np.sum(inner < v) for v in cur])
    k = len(edges) - 1
    pr = np.clip(np.bincount(rb, minlength=k) / len(ref), 1e-6, 1)
    pc = np.clip(np.bincount(cb, minlength=k) / len(cur), 1e-6, 1)
    return float(np.sum((pc - pr) * np.log(pc / pr)))


def test_numeric_psi_behaviour(spark):
    ref = spark.createDataFrame([(float(v),) for v in [0, 0, 1, 1, 2, 2, 3, 3]], "x double")
    same = D.numeric_psi(ref, ref, ["x"]).first().score
    shifted = spark.createDataFrame([(float(v) + 10,) for v in [0, 0, 1, 1, 2, 2, 3, 3]], "x double")
    moved = D.numeric_psi(ref, shifted, ["x"]).first().score
    assert same < 0.05 and moved > same


def test_numeric_psi_matches_numpy(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=500).round(2), (rng.normal(size=400) + 0.3).round(2)
    ref = spark.createDataFrame([(float(v),) for v in a], "x double")
    cur = spark.createDataFrame([(float(v),) for v in b], "x double")
    got = D.numeric_psi(ref, cur, ["x"]).first()
    assert got.score == pytest.approx(_np_psi(a, b), abs=1e-9)
    assert (got.n_ref, got.n_cur) == (500, 400)


def test_categorical_psi(spark):
    ref = spark.createDataFrame([(c,) for c in "AABBB"], "c string")
    cur = spark.createDataFrame([(c,) for c in "ACCCC"], "c string")
    assert D.categorical_psi(ref, cur, ["c"]).first().score > 0.1


def test_drift_table_and_summary(spark):
    ref = spark.createDataFrame([(i, "a" if i % 2 else "b", i % 2) for i in range(6)],
                                "feat_num int, feat_cat string, y int")
    cur = spark.createDataFrame([(i + 3, "a", i % 2) for i in range(6)],
                                "feat_num int, feat_cat string, y int")
    t = D.drift_table(ref, cur, exclude={"y"})
    rows = {r.feature: r for r in t.collect()}
    assert set(rows) == {"feat_num", "feat_cat"}
    assert rows["feat_num"].kind == "numeric_psi" and rows["feat_cat"].kind == "categorical_psi"
    assert all(r.status in ("ok", "warn", "alert") for r in rows.values())
    s = D.drift_summary(t).first()
    assert s.n_features == 2 and s.max_feature == max(rows.values(), key=lambda r: r.score).feature


def test_drift_by_period_previous_and_fixed(spark):
    rows = [(p, float(v + p), "x" if v % 2 else "y") for p in (1, 2, 3) for v in range(20)]
    panel = spark.createDataFrame(rows, "p int, v double, c string")
    prev = D.drift_by_period(panel, "p").collect()
    assert {r.p for r in prev} == {2, 3}
    fixed = D.drift_by_period(panel, "p", reference=1).collect()
    assert {r.p for r in fixed} == {2, 3}
    f3 = [r.score for r in fixed if r.p == 3 and r.feature == "v"][0]
    p3 = [r.score for r in prev if r.p == 3 and r.feature == "v"][0]
    assert f3 > p3  # period 3 is further from period 1 than from period 2


def test_sort_drift_order(spark):
    t = spark.createDataFrame([("a", 0.1, 1), ("b", 0.3, 0), ("c", 0.1, 0)], "feature string, score double, position int")
    assert [r.feature for r in D.sort_drift(t).collect()] == ["b", "c", "a"]
