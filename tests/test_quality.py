import pytest

from sparkpanel.functions.names import detect_id_column
from sparkpanel.operators import quality as Q


@pytest.mark.parametrize("cols,expected", [(["ra", "x"], "ra"), (["RA", "x"], "RA"), (["Ra", "x"], "Ra")])
def test_detect_id(cols, expected):
    assert detect_id_column(cols) == expected


def test_detect_id_missing():
    with pytest.raises(ValueError):
        detect_id_column(["x", "y"])


def test_unique_ids(spark):
    with pytest.raises(ValueError, match="NULL"):
        Q.assert_unique_ids(spark.createDataFrame([("1",), (None,), ("3",)], "ra string"), "ra", 2022)
    with pytest.raises(ValueError, match="duplicates"):
        Q.assert_unique_ids(spark.createDataFrame([("1",), ("1",), ("2",)], "ra string"), "ra", 2022)
    with pytest.raises(ValueError, match="does not exist"):
        Q.assert_unique_ids(spark.createDataFrame([("1",)], "x string"), "ra", 2022)


def test_coverage(spark):
    a = spark.createDataFrame([("1",), ("2",), ("3",)], "ra string")
    b = spark.createDataFrame([("3",), ("4",)], "ra string")
    r = Q.assert_common_ids(a, b, "ra", 2022, 2023)
    assert (r["n_t"], r["n_t1"], r["n_common"]) == (3, 2, 1)
    with pytest.raises(ValueError):
        Q.assert_common_ids(spark.createDataFrame([("1",), ("2",)], "ra string"), b, "ra", 2022, 2023)


def test_coverage_by_period_and_stats(spark):
    panel = spark.createDataFrame([("1", 1), ("2", 1), ("2", 2), ("3", 2), ("3", 3)], "ra string, ano int")
    got = sorted(tuple(r) for r in Q.coverage_by_period(panel, "ra", "ano").collect())
    assert got == [(1, 2, 2, 2, 1), (2, 3, 2, 1, 1)]
    df = spark.createDataFrame([(1, None), (0, 2.0), (None, 3.0)], "y int, f double")
    r = Q.basic_stats(df).first()
    assert r.n_rows == 3 and r.n_cols == 2 and abs(r.missing_rate - 2 / 6) < 1e-12
    assert (r.n_y0, r.n_y1, r.n_y_null) == (1, 1, 1) and r.pos_rate == 0.5
    prof = {r.feature: (r.n_nonnull, r.all_null) for r in Q.null_profile(df).collect()}
    assert prof == {"y": (2, False), "f": (2, False)}


def test_pair_input_report_one_job(spark):
    a = spark.createDataFrame([("1",), ("1",), (None,), ("3",)], "ra string")
    b = spark.createDataFrame([("3",), ("4",), ("4",), ("4",)], "ra string")
    r = Q.pair_input_report(a, b, "ra")
    assert (r["null_t"], r["dup_t"], r["null_t1"], r["dup_t1"]) == (1, 1, 0, 2)
    assert (r["n_t"], r["n_t1"], r["n_common"]) == (2, 2, 1)
    with pytest.raises(ValueError, match="NULLs"):
        Q.validate_pair_inputs(a, b, "ra", 2022, 2023)
