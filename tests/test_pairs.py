import pytest
from pyspark.sql import functions as F

from sparkpanel.functions.scalar import target_not_equal
from sparkpanel.operators import pairs as P


def test_target_rule(spark):
    df = spark.createDataFrame([(10.0,), (9.0,), (0.0,), (11.0,), (None,)], "ian double")
    got = [r[0] for r in df.select(target_not_equal("ian", 10)).collect()]
    assert got == [0, 1, 1, 1, 1]


def test_temporal_pair_no_leakage(spark):
    t = spark.createDataFrame([("1", 2022, 1.0), ("2", 2022, 2.0), ("3", 2022, 3.0)],
                              "ra string, ano int, feat_a double")
    t1 = spark.createDataFrame([("1", 10, 5), ("3", 7, 6), ("4", 10, 7)],
                               "ra string, ian int, qualquer_coisa_t1 int")
    out = P.temporal_pair(t, t1, 2022, 2023)
    assert out.columns == ["ra", "year_t", "year_t1", "y", "feat_a"]
    rows = sorted((r.ra, r.y, r.year_t, r.year_t1) for r in out.collect())
    assert rows == [("1", 0, 2022, 2023), ("3", 1, 2022, 2023)]


def test_pair_common_ids_only(spark):
    t = spark.createDataFrame([("1",), ("2",), ("3",)], "ra string")
    t1 = spark.createDataFrame([("2", 10), ("3", 9), ("4", 10)], "ra string, ian int")
    rows = sorted((r.ra, r.y) for r in P.temporal_pair(t, t1, 2022, 2023).collect())
    assert rows == [("2", 0), ("3", 1)]


def test_pair_missing_target_or_id(spark):
    t = spark.createDataFrame([("1", 1)], "ra string, x int")
    with pytest.raises(ValueError):
        P.temporal_pair(t, spark.createDataFrame([("1", 1)], "ra string, z int"), 2022, 2023)
    with pytest.raises(ValueError):
        P.temporal_pair(t, spark.createDataFrame([("1", 10)], "other string, ian int"), 2022, 2023)


def test_pair_rejects_duplicates_and_disjoint(spark):
    t = spark.createDataFrame([("1",), ("1",)], "ra string")
    t1 = spark.createDataFrame([("1", 10)], "ra string, ian int")
    with pytest.raises(ValueError, match="duplicates"):
        P.temporal_pair(t, t1, 2022, 2023)
    with pytest.raises(ValueError, match="common"):
        P.temporal_pair(spark.createDataFrame([("9",)], "ra string"), t1, 2022, 2023)


def test_all_pairs_one_job(spark):
    panel = spark.createDataFrame(
        [("1", 2022, 1.0, 10), ("2", 2022, 2.0, 5), ("1", 2023, 3.0, 10), ("2", 2023, 4.0, 10),
         ("1", 2024, 5.0, 3), ("2", 2024, 6.0, 10)], "ra string, ano int, feat double, ian int")
    out = P.all_pairs(panel, id_col="ra", period_col="ano")
    assert "ano" not in out.columns and "ian" in out.columns  # t-side ian is a feature
    got = sorted((r.year_t, r.year_t1, r.ra, r.y, r.feat) for r in out.collect())
    assert got == [(2022, 2023, "1", 0, 1.0), (2022, 2023, "2", 0, 2.0),
                   (2023, 2024, "1", 1, 3.0), (2023, 2024, "2", 0, 4.0)]
    summary = {(r.year_t, r.n_rows, r.n_pos) for r in P.target_summary(out).collect()}
    assert summary == {(2022, 2, 0), (2023, 2, 1)}


def test_all_pairs_is_deterministic(spark):
    panel = spark.createDataFrame([("1", 2022, 1.0, 10), ("1", 2023, 2.0, 9)],
                                  "ra string, ano int, f double, ian int")
    a = P.all_pairs(panel, id_col="ra").collect()
    b = P.all_pairs(panel, id_col="ra").collect()
    assert a == b
