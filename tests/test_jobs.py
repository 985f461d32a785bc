import os

from pyspark.sql import functions as F

from sparkpanel import jobs


def _csv(path, header, rows):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(";".join(header) + "\n")
        for r in rows:
            fh.write(";".join(str(x) for x in r) + "\n")


def test_build_dataset_end_to_end(spark, tmpdir_path):
    raw = {}
    for year, ians in ((2022, None), (2023, (10, 9, 10)), (2024, (3, 10, 10))):
        p = os.path.join(tmpdir_path, f"raw_{year}.csv")
        if ians is None:  # the first year has no indicator column at all
            _csv(p, ["RA", "Feat"], [(f"{i}", i + year) for i in range(3)])
        else:
            _csv(p, ["RA", "Feat", "IAN"], [(f"{i}", i + year, ian) for i, ian in enumerate(ians)])
        raw[year] = p
    out = os.path.join(tmpdir_path, "out")
    stats = {r.year_t: r for r in jobs.build_dataset(spark, raw, out).collect()}
    assert set(stats) == {2022, 2023} and all(r.n_rows == 3 for r in stats.values())
    p1 = spark.read.parquet(os.path.join(out, "pairs", "pair_2022_2023"))
    assert "ano" not in p1.columns and "ian" not in p1.columns
    assert {r.ra: r.y for r in p1.collect()} == {"0": 0, "1": 1, "2": 0}
    p2 = spark.read.parquet(os.path.join(out, "pairs", "pair_2023_2024"))
    assert "ian" in p2.columns and {r.ra: r.y for r in p2.collect()} == {"0": 1, "1": 0, "2": 0}
    assert spark.read.json(os.path.join(out, "stats")).count() == 2


def test_drift_job(spark, tmpdir_path):
    ref = spark.createDataFrame([(float(i % 10), "a" if i % 2 else "b", 2022) for i in range(200)],
                                "x double, c string, ano int")
    cur = spark.createDataFrame([(float(i % 10) + 4, "a", 2023) for i in range(200)], "x double, c string, ano int")
    rp, cp = os.path.join(tmpdir_path, "ref.parquet"), os.path.join(tmpdir_path, "cur.parquet")
    ref.write.parquet(rp)
    cur.write.parquet(cp)
    out = os.path.join(tmpdir_path, "mon")
    assert jobs.drift_job(spark, rp, cp, out) == "alert"
    feats = spark.read.parquet(os.path.join(out, "drift_features"))
    assert {r.feature for r in feats.collect()} == {"x", "c"}  # 'ano' excluded by default


def test_drift_runs_of_one_second_stay_apart_and_replace_themselves(spark, tmpdir_path):
    df = spark.createDataFrame([(float(i % 10), "a") for i in range(50)], "x double, c string")
    path, out = os.path.join(tmpdir_path, "t.parquet"), os.path.join(tmpdir_path, "mon")
    df.write.parquet(path)
    for _ in range(2):
        jobs.drift_job(spark, path, path, out)
    jobs.drift_job(spark, path, path, out, run_id="mine")
    jobs.drift_job(spark, path, path, out, run_id="mine")
    history = spark.read.parquet(os.path.join(out, "drift_features"))
    assert history.count() == 6 and history.select("run_id").distinct().count() == 3
    summary = spark.read.parquet(os.path.join(out, "drift_summary")).filter("run_id = 'mine'").first()
    assert summary.features_path.endswith("drift_features/run_id=mine") and summary.reference_path == path
    assert jobs.latest_drift(spark, out).count() == 2


def test_train_job_records_its_choice(spark, tmpdir_path):
    import pytest
    from pyspark.ml import PipelineModel
    rows = [(str(i), 1 if i % 5 < 3 else 0, float(i % 7) + 2 * (i % 5 < 3), "SIM" if i % 2 else None, 2022, 2023) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, y int, a double, k string, year_t int, year_t1 int")
    train, test, art = (os.path.join(tmpdir_path, n) for n in ("train.parquet", "test.parquet", "art"))
    df.write.parquet(train)
    df.write.parquet(test)
    row = jobs.train_job(spark, train, test, art, feature_set="selected", variables=["a"]).first()
    assert row.features == ["a"] and row.n == 60 and 0 < row.threshold < 1
    assert PipelineModel.load(row.model_path).transform(df).count() == 60
    runs = spark.read.parquet(os.path.join(art, "runs"))
    assert runs.count() == 1 and jobs.evaluate_job(spark, test, os.path.join(art, "runs"), os.path.join(tmpdir_path, "ev"),
                                                   model_key="logreg").first()["n"] == 60
    with pytest.raises(ValueError):
        jobs.train_job(spark, train, test, art, y="nothing")
