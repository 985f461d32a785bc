import gzip
import os

import pytest
from pyspark.sql import functions as F

from sparkpanel.operators import registry as RG
from sparkpanel.sources import io


@pytest.fixture
def runs(spark):
    rows = [("20260303_213445", "dummy", 1, 0.5, 0.57), ("20260303_213456", "xgb", 5, 0.84, 0.69),
            ("20260303_213447", "rf", 3, 0.81, 0.51), ("20260303_213500", "xgb", 9, 0.80, 0.70)]
    return (spark.createDataFrame(rows, "run_id string, model string, t int, test_roc_auc double, test_f1 double")
            .withColumn("run_ts", F.timestamp_seconds(F.col("t"))).drop("t")
            .withColumn("model_path", F.concat(F.lit("artifacts/models/model_"), "model", F.lit("_"), "run_id",
                                               F.lit(".joblib"))))


def test_latest_best_leaderboard(runs):
    latest = {r.model: r.run_id for r in RG.latest_per_model(runs).collect()}
    assert latest["xgb"] == "20260303_213500"
    assert RG.best_run(runs).first().run_id == "20260303_213456"
    top = [r.model for r in RG.leaderboard(runs, top_n=2).collect()]
    assert top == ["xgb", "rf"]
    only = RG.leaderboard(runs, model_key="XGBoost").collect()
    assert {r.model for r in only} == {"xgb"}
    with pytest.raises(ValueError):
        RG.leaderboard(runs, sort_by="nope")
    with pytest.raises(ValueError):
        RG.leaderboard(runs, top_n=0)


def test_pointer_resolution(spark):
    ptr = spark.createDataFrame([("  ", "model_tree_20260303_213447.joblib", "/x/models"),
                                 ("/abs/model_rf_20260303_213447.joblib", None, "/x/models/")],
                                "model_path string, artifact_path string, base string")
    out = RG.resolve_pointer(ptr, "base").collect()
    assert out[0].resolved_path == "/x/models/model_tree_20260303_213447.joblib"
    assert out[0].path_run_id == "20260303_213447" and out[0].path_model == "tree"
    assert out[1].resolved_path == "/abs/model_rf_20260303_213447.joblib"


def test_csv_gz_fallback_and_dispatch(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "pairs")
    os.makedirs(d)
    with gzip.open(os.path.join(d, "pair.csv.gz"), "wt") as fh:
        fh.write("x\n1\n2\n")
    got = io.read_first_available(spark, d, "pair")
    assert sorted(r.x for r in got.collect()) == [1, 2]
    with pytest.raises(io.SourceNotFound):
        io.read_first_available(spark, d, "missing")
    with pytest.raises(ValueError):
        io.read_table(spark, os.path.join(d, "pair.json"))
    with pytest.raises(io.SourceNotFound):
        io.read_table(spark, os.path.join(d, "nope.parquet"))


def test_write_partitioned_and_periods(spark, tmpdir_path):
    df = spark.createDataFrame([("1", 2022, 1.0), ("2", 2023, 2.0)], "ra string, ano int, f double")
    out = os.path.join(tmpdir_path, "interim")
    io.write_table(df, out, partition_by=["ano"])
    back = io.read_parquet(spark, out)
    assert back.where(F.col("ano") == 2023).count() == 1
    p1, p2 = os.path.join(tmpdir_path, "a.parquet"), os.path.join(tmpdir_path, "b.parquet")
    io.write_table(df.select("ra", "f"), p1)
    io.write_table(df.select("ra"), p2)
    panel = io.load_periods(spark, {2022: p1, 2023: p2})
    assert panel.where(F.col("ano") == 2023).where(F.col("f").isNull()).count() == 2


def test_record_run_and_trim(spark, runs, tmpdir_path):
    path = os.path.join(tmpdir_path, "runs")
    RG.record_run(path, runs.limit(2))
    RG.record_run(path, runs)
    assert spark.read.parquet(path).count() == 6
    messy = spark.createDataFrame([(1, 2)], "` model ` int, `test_f1 ` int")
    assert RG.trim_columns(messy).columns == ["model", "test_f1"]
    info = RG.model_info(RG.latest_per_model(runs)).collect()
    assert {r.model for r in info} == {"dummy", "xgb", "rf"} and all(r.threshold == 0.5 for r in info)


def test_csv_strings_names_and_na_tokens(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "raw.csv")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write("RA;Ano;ano;Nº Av;Nota\n007;2022;x;NA;  n/a\n008;2022;y;3;7,5\n")
    df = io.read_csv_strings(spark, path)
    assert df.columns == ["ra", "ano", "ano_1", "no_av", "nota"]
    rows = df.orderBy("ra").collect()
    assert rows[0].ra == "007" and rows[0].no_av is None and rows[0].nota is None
    assert rows[1].nota == "7,5"


def test_write_report_json(spark, tmpdir_path):
    from sparkpanel.operators import quality as Q
    df = spark.createDataFrame([(1, 0), (2, 1)], "x int, y int")
    out = os.path.join(tmpdir_path, "report")
    io.write_report(Q.basic_stats(df), out)
    back = spark.read.json(out).first()
    assert back.n_rows == 2 and back.n_cols == 2


def test_resolve_model_default_and_alias(runs):
    latest = RG.latest_per_model(runs)
    assert RG.resolve_model(latest, "XGBoost").first().run_id == "20260303_213500"
    assert RG.resolve_model(latest, None).count() == 0  # default -> tree, not in this table
    assert RG.resolve_model(latest, "Random Forest").first().model == "rf"


def test_gzip_csv_round_trip(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, s string")
    out = os.path.join(tmpdir_path, "pair_csv")
    io.write_table(df, out, fmt="csv", sep=";", compression="gzip")
    assert any(f.endswith(".csv.gz") for f in os.listdir(out))
    back = spark.read.options(header=True, sep=";").csv(out)
    assert sorted((int(r.x), r.s) for r in back.collect()) == [(1, "a"), (2, "b")]
