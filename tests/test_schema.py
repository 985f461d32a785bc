import pytest
from pyspark.sql import types as T

from sparkpanel.operators import schema as S


def test_feature_selection(spark):
    df = spark.createDataFrame([(1, 10, "A", 1.0, "x", 1)],
                               "id long, idade_t long, fase_t string, `nota_t+1` double, `indicador_t+1` string, y int")
    fs = S.select_feature_columns(df, "y")
    assert fs.selected == ["idade_t", "fase_t"]
    assert fs.numeric == ["idade_t"] and fs.categorical == ["fase_t"]
    assert fs.dropped == sorted(["id", "nota_t+1", "indicador_t+1", "y"])


def test_schema_diff_align_and_all_null(spark):
    train = spark.createDataFrame([("1", 1, 1.0, 0, None)], "ra string, y int, feat_a double, feat_b int, ipp double")
    test = spark.createDataFrame([("2", 0, 3.0, 9, 5.0), ("3", 1, 4.0, 8, 6.0)],
                                 "ra string, y int, feat_a double, feat_extra int, ipp double")
    assert S.schema_diff(train, test) == {"missing_in_test": ["feat_b"], "extra_in_test": ["feat_extra"]}
    al = S.align_to_schema(train, test)
    assert al.columns == ["ra", "y", "feat_a", "feat_b", "ipp"]
    rows = al.orderBy("ra").collect()
    assert [r.feat_a for r in rows] == [3.0, 4.0] and all(r.feat_b is None for r in rows)
    assert al.schema["feat_b"].dataType == T.IntegerType()
    tr, te, dead = S.drop_all_null_features(train, al, ["feat_a", "feat_b", "ipp"])
    assert dead == ["ipp"] and "ipp" not in tr.columns and "ipp" not in te.columns


def test_split_xy_and_strict(spark):
    df = spark.createDataFrame([("1", 2022, 2023, 2022, 1.0, 2.0, 1)],
                               "ra string, year_t int, year_t1 int, ano int, feature_a double, feature_b double, y long")
    feats, d = S.split_xy(df)
    assert feats == ["feature_a", "feature_b"] and d.schema["y"].dataType == T.IntegerType()
    assert S.strict_select(df, ["feature_b", "feature_a"]).columns == ["feature_b", "feature_a"]
    with pytest.raises(ValueError, match="missing"):
        S.strict_select(df, ["feature_c"])
    with pytest.raises(ValueError):
        S.split_xy(df.drop("y"))


def test_resolve_features():
    assert len(S.resolve_features("all")) == 32
    assert S.resolve_features("custom", ["idade", "fase", "idade"]) == ["idade", "fase"]
    with pytest.raises(ValueError):
        S.resolve_features("selected")


def test_default_dictionary_covers_the_known_features(spark):
    from sparkpanel.operators import schema as S
    rows = S.feature_dictionary(spark).collect()
    assert tuple(r.feature for r in rows) == S.FEATURE_NAMES and len(rows) == 32
    assert [r.feature for r in rows if r.derived] == ["gap_fase", "pedra_ord", "rec_av_count"]
    asked = spark.createDataFrame([("ida",), ("unknown",)], "feature string")
    got = {r.feature: r.description for r in S.describe_features(asked, S.feature_dictionary(spark)).collect()}
    assert got["ida"].startswith("learning") and got["unknown"] is None
