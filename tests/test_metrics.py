import numpy as np
import pytest

from sparkpanel.operators import metrics as M


def _brute_auc(y, s):
    pos = [si for yi, si in zip(y, s) if yi == 1]
    neg = [si for yi, si in zip(y, s) if yi == 0]
    tot = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def _df(spark, y, s, grp=None):
    rows = [(int(a), float(b), (grp[i] if grp else "g")) for i, (a, b) in enumerate(zip(y, s))]
    return spark.createDataFrame(rows, "y int, score double, grp string")


def test_auc_matches_brute_force_with_ties(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400), 2)  # many ties
    grp = ["a" if i % 3 else "b" for i in range(400)]
    df = _df(spark, y, s, grp)
    got = {r.grp: r.roc_auc for r in M.roc_auc(df, by=["grp"], n_ranges=5).collect()}
    for g in ("a", "b"):
        idx = [i for i in range(400) if grp[i] == g]
        assert got[g] == pytest.approx(_brute_auc(y[idx], s[idx]), abs=1e-12)
    one_class = spark.createDataFrame([(1, 0.3), (1, 0.5)], "y int, score double")
    assert M.roc_auc(one_class).first().roc_auc is None


def test_metrics_at_threshold(spark):
    y = [1, 0, 1, 1, 0, 0]
    s = [0.9, 0.8, 0.4, 0.6, 0.1, 0.3]
    m = M.metrics_at(_df(spark, y, s), threshold=0.5).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (2, 1, 1, 2)
    assert m.precision == pytest.approx(2 / 3) and m.recall == pytest.approx(2 / 3)
    assert m.f1 == pytest.approx(2 / 3) and m.accuracy == pytest.approx(4 / 6)
    assert m.roc_auc == pytest.approx(_brute_auc(y, s))
    cm = M.confusion_matrix(M.with_labels(_df(spark, y, s), "score", 0.5)).first()
    assert cm.matrix == [[2, 1], [1, 2]]


def test_sweep_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300)
    s = rng.random(300)
    sw = {r.threshold: r for r in M.threshold_sweep(_df(spark, y, s)).collect()}
    for t in M.TUNING_GRID:
        pred = s >= t
        tp = int(((pred == 1) & (y == 1)).sum())
        fp = int(((pred == 1) & (y == 0)).sum())
        assert (sw[t].tp, sw[t].fp) == (tp, fp)


def test_pick_threshold_rules(spark):
    # constant score: every threshold ties -> larger one (0.95); F1 objective
    df = _df(spark, [1, 0, 1], [1.0, 1.0, 1.0])
    assert M.pick_threshold(df, objective="f1", min_precision=None).first().threshold == 0.95
    # nothing reaches precision 0.9 -> fallback 0.5 with NULL rates
    df2 = _df(spark, [0, 1, 0, 0], [0.9, 0.8, 0.7, 0.6])
    r = M.pick_threshold(df2, objective="recall", min_precision=0.9).first()
    assert r.threshold == 0.5 and r.score is None
    # Ties keep the smaller threshold
    c = M.choose_threshold_max_f1(_df(spark, [1, 0], [1.0, 0.0])).first()
    assert c.threshold == pytest.approx(0.05) and c.f1 == 1.0


def test_float_grid():
    g = M.float_step_grid()
    assert len(g) == 91 and g[1] == 0.060000000000000005
