import math

import pytest

from sparkpanel.operators import drift as D


def _rows(spark, rows):
    return spark.createDataFrame(rows, "p int, x double, w long, c string")


REF = [(1, 1.0, 1, "a"), (1, 2.0, 2, "b"), (1, 2.0, None, None), (1, None, 4, "__na__"), (1, 5.0, 5, "a"),
       (None, 1.0, 1, "a"), (2, 7.0, None, "z"), (2, math.inf, None, "z"), (2, -0.0, None, None)]
CUR = [(1, 2.0, 2, None), (1, 6.0, None, "b"), (1, None, 9, "__na__"), (None, 3.0, 1, "a"), (2, 8.0, 3, "q"),
       (3, 1.0, 1, "a")]


def _joins(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bins_are_found_before_the_rows_are_unpivoted(spark):
    """The numeric step joined every unpivoted value with its feature's edges."""
    ref = _rows(spark, REF).drop("p")
    edges = [("x", [1.0, 2.0])]
    schema = spark.createDataFrame([], "feature string, inner array<double>").schema
    held = spark.createDataFrame(edges, schema).collect()
    codes = D._bin_codes(ref, [], ["x", "w"], held, schema, [], 10)
    assert "Join" not in _joins(codes)
    got = sorted(r.code for r in codes.collect())
    # x: bins 0, 1, 1, 2 and more, one NULL; w has no edges: 12 + 11, and 12 + 10 for NULL
    assert got == sorted([0, 1, 1, 10, 2, 0, 2, 2, 0] + [23, 23, 22, 23, 23, 23, 22, 22, 22])


def test_category_counts_are_shuffled_once(spark):
    """Totals and cells each scanned both sides: their columns differed, so no exchange was shared."""
    ref, cur = _rows(spark, REF), _rows(spark, CUR)
    out = D.categorical_psi(ref, cur, ["c"])
    out.collect()
    plan = _joins(out)
    assert "ReusedExchange" in plan.split("== Initial Plan ==")[0]
    row = out.first()
    assert (row.n_ref, row.n_cur) == (7, 5)
    pr = {"a": 3 / 9, "b": 1 / 9, D.NA: 3 / 9, "z": 2 / 9, "q": 1e-6}
    pc = {"a": 2 / 6, "b": 1 / 6, D.NA: 2 / 6, "z": 1e-6, "q": 1 / 6}
    assert row.score == pytest.approx(sum((pc[k] - pr[k]) * math.log(pc[k] / pr[k]) for k in pr), abs=1e-12)


@pytest.mark.parametrize("by, ref_by", [([], None), (["p"], None), (["p"], [])])
def test_counts_of_odd_rows(spark, by, ref_by):
    ref, cur = _rows(spark, REF), _rows(spark, CUR)
    table = D.drift_table(ref, cur, by=by, ref_by=ref_by, exclude={"p"})
    got = {(r["p"] if by else None, r.feature): (r.n_ref, r.n_cur) for r in table.collect()}
    for (p, feature), (n_ref, n_cur) in got.items():
        at = {"x": 1, "w": 2, "c": 3}[feature]
        mine = [r for r in CUR if not by or r[0] == p]
        theirs = [r for r in REF if not by or ref_by == [] or r[0] == p]
        assert n_cur == sum(r[at] is not None for r in mine), (p, feature)
        assert n_ref == sum(r[at] is not None for r in theirs), (p, feature)
    assert {f for _, f in got} == {"x", "w", "c"}
