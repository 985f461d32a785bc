"""The split-into-ranges path used for huge groups gives exactly the same
results as the single-range path, on the real test tables."""

import pytest

from sparkpanel.operators import drift as D
from sparkpanel.operators import metrics as M
from sparkpanel.operators import ranking as RK
from sparkpanel.plans import q_drift, q_metrics

SF = "/root/testdata/sf0.001"


def test_psi_with_many_ranges_equals_single_range(spark, monkeypatch):
    ref, cur = q_drift._sides(spark, SF)
    one = {r.feature: r.score for r in D.numeric_psi(ref, cur, q_drift.NUM).collect()}
    monkeypatch.setattr(RK, "ROWS_PER_RANGE", 25)  # every feature now spans many ranges
    many = {r.feature: r.score for r in D.numeric_psi(ref, cur, q_drift.NUM).collect()}
    assert set(one) == set(many)
    for f in one:
        assert many[f] == pytest.approx(one[f], abs=1e-12)


def test_auc_with_many_ranges_equals_single_range(spark):
    df = q_metrics.scored(spark, SF)
    a = {r.grp: r.roc_auc for r in M.roc_auc(df, by=["grp"], n_ranges=1).collect()}
    b = {r.grp: r.roc_auc for r in M.roc_auc(df, by=["grp"], n_ranges=40).collect()}
    assert a.keys() == b.keys() and all(b[k] == pytest.approx(a[k], abs=1e-12) for k in a)
