"""The one-job "all periods" operators agree with the per-pair operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkpanel.operators import drift as D
from sparkpanel.operators import pairs as P
from sparkpanel.operators import quality as Q


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(21)
    rows = []
    for ano in (2020, 2021, 2022, 2023):
        for i in rng.choice(40, size=25, replace=False):
            rows.append((f"id{i}", ano, float(rng.normal() + ano - 2020), "abc"[i % 3], int(rng.choice([10, 5, 10]))))
    return spark.createDataFrame(rows, "ra string, ano int, x double, c string, ian int")


def test_all_pairs_equals_each_temporal_pair(spark, panel):
    allp = P.all_pairs(panel, id_col="ra")
    for t in (2020, 2021, 2022):
        one = P.temporal_pair(panel.where(F.col("ano") == t), panel.where(F.col("ano") == t + 1), t, t + 1)
        a = sorted(tuple(r) for r in allp.where(F.col("year_t") == t).collect())
        b = sorted(tuple(r) for r in one.select(*allp.columns).collect())
        assert a == b and len(a) > 0


def test_coverage_by_period_equals_pairwise(spark, panel):
    by = {r.year_t: (r.n_t, r.n_t1, r.n_common) for r in Q.coverage_by_period(panel, "ra").collect()}
    for t in (2020, 2021, 2022):
        r = Q.coverage_report(panel.where(F.col("ano") == t), panel.where(F.col("ano") == t + 1), "ra").first()
        assert by[t] == (r.n_t, r.n_t1, r.n_common)


def test_drift_by_period_equals_pairwise(spark, panel):
    feats = panel.select("ano", "x", "c")
    prev = {(r.ano, r.feature): r.score for r in D.drift_by_period(feats, "ano").collect()}
    fixed = {(r.ano, r.feature): r.score for r in D.drift_by_period(feats, "ano", reference=2020).collect()}
    for t in (2021, 2022, 2023):
        cur = feats.where(F.col("ano") == t).drop("ano")
        for ref_year, got in ((t - 1, prev), (2020, fixed)):
            ref = feats.where(F.col("ano") == ref_year).drop("ano")
            one = {r.feature: r.score for r in D.drift_table(ref, cur).collect()}
            for f in ("x", "c"):
                assert got[(t, f)] == pytest.approx(one[f], abs=1e-12)
