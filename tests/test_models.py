import pytest
from pyspark.sql import functions as F

from sparkpanel.operators import features as FE
from sparkpanel.operators import models as MD


@pytest.fixture(scope="module")
def pairs(spark):
    rows = []
    for i in range(60):
        y = 1 if (i % 5) in (0, 1, 2) else 0
        rows.append((str(i), 2022, 2023, y, float(i % 7) + y, "SIM" if i % 2 else None, float(i % 3) if i % 4 else None))
    return spark.createDataFrame(rows, "ra string, year_t int, year_t1 int, y int, a double, bolsa string, b double")


def test_impute_encode(spark, pairs):
    pre = FE.fit_preprocessor(pairs, ["a", "b"], ["bolsa"])
    assert pre.fills["bolsa"] == "SIM"
    out = FE.transform_features(pairs, pre).select("features").collect()
    assert len(out) == 60 and len({len(r.features) for r in out}) == 1
    assert all(x == x for r in out for x in r.features.toArray())  # no NaN / NULL left
    unseen = spark.createDataFrame([("x", 1.0, "NOVO", 1.0)], "ra string, a double, bolsa string, b double")
    vec = FE.transform_features(unseen, pre).first().features.toArray()
    assert list(vec[2:]) == [0.0]  # unknown category -> all zeros
    with pytest.raises(ValueError, match="missing"):
        FE.transform_features(unseen.drop("bolsa"), pre)


def test_median_is_exact(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    assert FE.fit_constants(df, ["x"], [])["x"] == 2.5


def test_folds_stratified_and_deterministic(spark, pairs):
    f1 = MD.stratified_folds(pairs, "y", "ra", k=5, seed=42, n_ranges=4)
    sizes = {}
    for r in f1.groupBy("y", "fold").count().collect():
        sizes.setdefault(r.y, []).append(r["count"])
    assert all(max(v) - min(v) <= 1 and len(v) == 5 for v in sizes.values())
    a = sorted((r.ra, r.fold) for r in f1.collect())
    b = sorted((r.ra, r.fold) for r in MD.stratified_folds(pairs, "y", "ra", k=5, seed=42, n_ranges=1).collect())
    assert a == b


def test_dummy_and_tree_fit_score(spark, pairs):
    d = MD.fit(pairs, ["a", "b"], ["bolsa"], MD.ModelConfig("dummy"))
    s = MD.predict(d, pairs, 0.5).select("score").distinct().collect()
    assert [r.score for r in s] == [1.0]
    t = MD.fit(pairs, ["a", "b"], ["bolsa"], MD.ModelConfig("tree", dt_max_depth=3))
    scored = MD.predict(t, pairs, 0.5)
    assert scored.where((F.col("score") < 0) | (F.col("score") > 1)).count() == 0
    m = MD.evaluate(t, pairs, 0.5).first()
    assert 0.0 <= m.roc_auc <= 1.0 and m.n == 60
    again = MD.predict(MD.fit(pairs, ["a", "b"], ["bolsa"], MD.ModelConfig("tree", dt_max_depth=3)), pairs)
    assert sorted(r.score for r in scored.collect()) == sorted(r.score for r in again.collect())


def test_run_train_job(spark, pairs):
    test = pairs.drop("b").withColumn("extra", F.lit(1))
    out = {r.split: r for r in MD.run_train(pairs, test, id_col="ra").collect()}
    assert set(out) == {"train", "test"}
    assert out["test"].missing_in_test == "b" and out["test"].extra_in_test == "extra"
    assert 0.05 <= out["train"].threshold <= 0.95


def test_search_space_sample():
    pts = MD.sample_space(MD.param_space("xgb"), 25, 42)
    assert len(pts) == 25 and pts == MD.sample_space(MD.param_space("xgb"), 25, 42)
    assert len(MD.sample_space(MD.param_space("logreg"), 25, 42)) == 10


def test_preprocessor_persist_roundtrip(spark, pairs, tmpdir_path):
    import os
    pre = FE.fit_preprocessor(pairs, ["a", "b"], ["bolsa"])
    path = os.path.join(tmpdir_path, "pre")
    FE.save_preprocessor(pre, path)
    loaded = FE.load_preprocessor(path)
    a = [r.features for r in pre.model.transform(pairs).select("features").collect()]
    b = [r.features for r in loaded.transform(pairs).select("features").collect()]
    assert a == b


def test_tuning_with_folds(spark, pairs):
    cfg = MD.ModelConfig("tree")
    pre = FE.fit_preprocessor(pairs, ["a", "b"], ["bolsa"])
    tuned = MD.tune(pairs, [pre.model], cfg, "y", "ra", MD.TuningConfig(n_iter=2, parallelism=2))
    rows = tuned.candidates.collect()
    assert len(rows) == 2 and tuned.n_fits == 10 and all(r.n_folds == 5 for r in rows)
    assert all(0.0 <= r[m] <= 1.0 for r in rows for m in MD.TUNING_METRICS)
    assert tuned.best_score == max(r.roc_auc for r in rows)
    assert MD.predict(MD.FittedModel("tree", tuned.best_model, []), pairs).count() == pairs.count()
    with pytest.raises(ValueError):
        MD.tune(pairs, [pre.model], cfg, "y", "ra", MD.TuningConfig(refit="speed"))


def test_search_axes_all_change_the_fit():
    for key in MD.MODEL_KEYS:
        points = MD.sample_space(MD.param_space(key))
        settings = [MD.at_point(MD.ModelConfig(key), p) for p in points if key != "dummy"]
        assert len(set(settings)) == len(settings)


def test_depth_beyond_sparks_limit_is_an_error():
    assert MD._depth(None) == 30 and MD._depth(30) == 30
    with pytest.raises(ValueError):
        MD._depth(31)


def test_payload_scoring_equals_direct_scoring(spark, pairs):
    from sparkpanel.operators import scoring as SC
    from pyspark.sql import types as T
    feats = ["a", "b", "bolsa"]
    fm = MD.fit(pairs, ["a", "b"], ["bolsa"], MD.ModelConfig("tree", dt_max_depth=3))
    direct = {r.ra: r.score for r in MD.predict(fm, pairs).collect()}
    payload = F.when(F.col("a") > 3, F.to_json(F.struct(F.struct(*feats).alias("features")))) \
        .otherwise(F.to_json(F.struct(*feats, F.col("year_t"))))
    req = pairs.select("ra", payload.alias("p"))
    g = SC.guard_payloads(req, "p", feats)
    assert g.where(F.col("reject_reason").isNotNull()).count() == 0
    cols = SC.payload_to_columns(g, feats, {"a": T.DoubleType(), "b": T.DoubleType()}, keep=["ra"])
    via_json = {r.ra: r.score for r in MD.predict(fm, cols).collect()}
    assert via_json == direct


def test_compare_records_runs(spark, pairs, tmpdir_path):
    import os
    from pyspark.ml import PipelineModel
    from sparkpanel.operators import registry as RG
    board = MD.compare(pairs, pairs, ["a", "b"], ["bolsa"], models=("dummy", "tree"), id_col="ra",
                       configs={"tree": MD.ModelConfig("tree", dt_max_depth=3)}, artifacts_dir=tmpdir_path)
    assert [r.model for r in board.collect()][0] == "tree"  # higher AUC than the constant model
    runs = spark.read.parquet(os.path.join(tmpdir_path, "runs"))
    latest = {r.model: r for r in RG.latest_per_model(runs).collect()}
    assert set(latest) == {"dummy", "tree"}
    reloaded = PipelineModel.load(latest["tree"].model_path)
    assert reloaded.transform(pairs).count() == 60
    assert latest["tree"].features == ["a", "b", "bolsa"]


def test_forest_same_seed_same_scores(spark, pairs):
    cfg = MD.ModelConfig("rf", rf_trees=10, rf_max_depth=4)
    a = MD.predict(MD.fit(pairs, ["a", "b"], ["bolsa"], cfg), pairs).select("ra", "score").collect()
    b = MD.predict(MD.fit(pairs, ["a", "b"], ["bolsa"], cfg), pairs).select("ra", "score").collect()
    assert sorted(a) == sorted(b)


def test_evaluation_threshold_override(spark):
    from sparkpanel.operators import scoring as SC
    df = spark.createDataFrame([(0.1, 0.2, 0), (0.9, 0.8, 1), (0.3, 0.7, 1), (0.6, 0.1, 0), (0.8, 0.9, 1),
                                (0.2, 0.3, 0)], "f1 double, f2 double, y int")
    fm = MD.fit(df.withColumn("id", F.monotonically_increasing_id()), ["f1", "f2"], [],
                MD.ModelConfig("tree", dt_max_depth=2))
    thr = SC.resolve_threshold(0.4, 0.9)
    assert thr == 0.4
    preds = MD.predict(fm, df, thr).select(F.col("y").alias("y_true"), F.col("score").alias("y_score"),
                                            F.col("pred").alias("y_pred"))
    assert preds.count() == 6 and preds.columns == ["y_true", "y_score", "y_pred"]
    m = MD.evaluate(fm, df, thr).first()
    assert all(0.0 <= x <= 1.0 for x in (m.precision, m.recall, m.f1, m.roc_auc, m.accuracy))


def test_forest_keeps_nodes_and_scores_each_side_once(spark, pairs, monkeypatch):
    assert MD.build_classifier(MD.ModelConfig("rf")).getCacheNodeIds()
    sides, fitted = [], []
    plain, fit_rows = MD.score_with, MD.build_classifier(MD.ModelConfig("rf")).__class__.fit

    def counted(model, df, *more):
        sides.append(df.count())
        return plain(model, df, *more)

    def seen(self, df, *more):
        fitted.append(df.rdd.getNumPartitions())
        return fit_rows(self, df, *more)

    monkeypatch.setattr(MD, "score_with", counted)
    monkeypatch.setattr(MD.RandomForestClassifier, "fit", seen)
    cfg = {"rf": MD.ModelConfig("rf", rf_trees=5, rf_max_depth=4)}
    test = pairs.limit(40)
    row = MD.compare(pairs.repartition(32), test, ["a", "b"], ["bolsa"], models=("rf",), configs=cfg, id_col="ra").first()
    assert sides == [60, 40]  # one pass of the trees over each side
    assert fitted == [2 * spark.sparkContext.defaultParallelism]
    assert row["test_n"] == 40 and 0.0 <= row["test_roc_auc"] <= 1.0 and row["train_roc_auc"] > 0.5
