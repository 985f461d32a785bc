import os
import unicodedata

import pytest
from pyspark.sql import functions as F

from sparkpanel import jobs
from sparkpanel.functions import names as N
from sparkpanel.functions import scalar as X
from sparkpanel.operators import drift as D
from sparkpanel.operators import metrics as M
from sparkpanel.operators import models as MD
from sparkpanel.operators import pairs as P
from sparkpanel.operators import quality as Q
from sparkpanel.operators import ranking as RK
from sparkpanel.operators import registry as RG
from sparkpanel.operators import schema as S
from sparkpanel.sources import io
from sparkpanel.streaming import drift_monitor as DM


def test_accents_over_unicode(spark):
    points = [*range(0x20, 0xD800, 3), *range(0xF900, 0xFB50), *range(0xFE30, 0xFFF0), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F250)]
    texts = [f"x{chr(p)}y{chr(p)}" for p in points] + ["Ή ё ﬁ Ａ ½ ǆ 한글 각 é é", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "s string").select("s", X.strip_accents("s").alias("o")).collect()
    for r in got:
        want = None if r.s is None else "".join(c for c in unicodedata.normalize("NFKD", r.s) if not unicodedata.combining(c))
        assert r.o == want


@pytest.mark.parametrize("raw, want", [
    ("  Nº Av ", "no_av"), ("Ação/2 (x).y-z", "acao_2_x_y_z"), ("__A__b__", "a_b"), ("R$ total", "r_total"), ("½", "12"),
    ("a$b c", "ab_c"), ("...", "")])
def test_column_names(raw, want):
    assert N.normalize_colname(raw) == want


def test_id_columns():
    assert N.detect_id_column(["x", "student_id", "RA"]) == "RA"
    assert N.detect_id_column(["x", "Ra"]) == "Ra"
    with pytest.raises(ValueError):
        N.detect_id_column(["x"])
    assert N.infer_id_columns(["ra", "z", "nome", "id"]) == ["id", "nome", "ra"]


def test_auc_beyond_a_long(spark):
    """Four billion rows a class, as counts by score."""
    n = 4 * 10**9
    table = spark.createDataFrame([(0.2, 0, n, 0), (0.5, n // 2, 0, n), (0.5001, n - n // 2, 0, n)],
                                  "score double, pos long, neg long, neg_below long")
    assert table.agg(M._auc_expr().alias("a")).first()["a"] == pytest.approx(1.0)
    ties = spark.createDataFrame([(0.5, n, n, 0)], "score double, pos long, neg long, neg_below long")
    assert ties.agg(M._auc_expr().alias("a")).first()["a"] == pytest.approx(0.5)


def test_range_index_beyond_one_stride(spark):
    edges = [float(i) for i in range(1, 300)]
    df = spark.createDataFrame([(x / 2,) for x in range(-3, 640)], "v double")
    got = RK.add_range_index(df, F.lit(edges), len(edges), F.col("v"), "i").collect()
    assert all(r.i == sum(e <= r.v for e in edges) for r in got)


def test_ids_pair_as_text(spark):
    a = spark.createDataFrame([("007", "x"), ("7", "y"), (None, "z")], "ra string, f string")
    b = spark.createDataFrame([(7, 10), (None, 3)], "ra long, ian int")
    got = P.temporal_pair(a, b, 1, 2, id_col="ra", validate=False).collect()
    assert [(r.ra, r.y, r.f) for r in got] == [("7", 0, "y")]
    assert [r.ra for r in P.keep_common_ids(a, b, "ra").collect()] == ["7"]


def test_panel_pairs_stop_on_duplicates_and_skip_null_ids(spark):
    panel = spark.createDataFrame([("a", 1, 10), ("a", 2, 5), (None, 1, 1), (None, 2, 1)], "ra string, ano int, ian int")
    assert [(r.ra, r.y) for r in P.all_pairs(panel, id_col="ra").collect()] == [("a", 1)]
    twice = panel.unionByName(spark.createDataFrame([("a", 2, 7)], panel.schema))
    with pytest.raises(ValueError, match="several rows"):
        P.all_pairs(twice, id_col="ra")


def test_nan_is_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, nan, 1), (2.0, nan, 0), (nan, nan, 1)], "a double, b double, y int")
    assert S.all_null_columns(df, ["a", "b"]) == ["b"]
    got = {r.feature: r.n_nonnull for r in Q.null_profile(df).collect()}
    assert got == {"a": 2, "b": 0, "y": 3}
    assert Q.basic_stats(df).first()["missing_rate"] == pytest.approx(4 / 9)
    from sparkpanel.operators import features as FE
    assert {r.feature: r["median"] for r in FE.median_table(df, ["a", "b"]).collect()} == {"a": 1.5, "b": None}
    pre = FE.fit_preprocessor(df, ["a", "b"], [])
    assert [r.features[0] for r in FE.transform_features(df, pre).collect()] == [1.0, 2.0, 1.5]


def test_empty_current_table_is_not_healthy(spark):
    ref = spark.createDataFrame([(float(i), "a" if i % 2 else "b") for i in range(50)], "x double, c string")
    for cur in (ref.limit(0), ref.where("x < 0")):
        table = {r.feature: r for r in D.drift_table(ref, cur).collect()}
        assert table["x"].score == 0.0 and table["x"].n_cur == 0
        assert table["c"].status == "alert"
    assert D.drift_summary(D.drift_table(ref, ref.limit(0))).first()["status"] == "alert"


def test_probabilities_of_nothing_are_uniform(spark):
    df = spark.createDataFrame([("f", 0), ("f", 0), ("g", 1), ("g", 3)], "feature string, n long")
    assert sorted(r.p for r in D.normalize_probs(df).collect()) == [0.25, 0.5, 0.5, 0.75]


def test_quoted_csv(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "q.csv")
    with open(path, "w") as f:
        f.write('RA;Nota;Obs\n007;1,5;"linha um\nlinha dois"\n8;2;"diz ""oi"" ; sim"\n')
    rows = io.read_csv_strings(spark, path).collect()
    assert [tuple(r) for r in rows] == [("007", "1,5", "linha um\nlinha dois"), ("8", "2", 'diz "oi" ; sim')]


def test_csv_types_lose_nothing(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "t.csv")
    with open(path, "w") as f:
        f.write("id,n,x,s\n007,1,1.5,a\n8,-20,2,\n")
    df = io.read_table(spark, path)
    assert [t for _, t in df.dtypes] == ["string", "bigint", "double", "string"]
    assert [tuple(r) for r in df.collect()] == [("007", 1, 1.5, "a"), ("8", -20, 2.0, None)]


def test_jobs_read_each_others_output(spark, tmpdir_path):
    raw = {}
    for year in (2021, 2022):
        raw[year] = os.path.join(tmpdir_path, f"{year}.csv")
        with open(raw[year], "w") as f:
            f.write("RA;IAN;Mat;Data de Nasc\n" + "".join(f"00{i};{10 if i % 3 else 5};{i},5;6/17/20{10 + i}\n" for i in range(9)))
    out = os.path.join(tmpdir_path, "out")
    jobs.build_dataset(spark, raw, out)
    pair = io.read_first_available(spark, f"{out}/pairs", "pair_2021_2022")
    assert pair.count() == 9 and {r.ra for r in pair.select("ra").collect()} == {f"00{i}" for i in range(9)}
    assert sorted(r.idade for r in pair.select("idade").collect()) == [float(2021 - 2010 - i) for i in range(8, -1, -1)]
    train, test = io.load_train_test(spark, f"{out}/pairs/pair_2021_2022", f"{out}/pairs/pair_2021_2022")
    assert train.columns == test.columns
    assert jobs.drift_job(spark, f"{out}/pairs/pair_2021_2022", f"{out}/pairs/pair_2021_2022", f"{out}/drift") == "ok"


def test_recorded_model_scores_at_its_threshold(spark, tmpdir_path):
    rows = [(f"s{i}", 1 if i > 30 else 0, float(i), "a" if i % 2 else "b") for i in range(60)]
    train = spark.createDataFrame(rows, "ra string, y int, a double, c string")
    board = MD.compare(train, train, ["a"], ["c"], models=("dummy", "tree"), id_col="ra", artifacts_dir=tmpdir_path, min_precision=0.5)
    runs = spark.read.parquet(os.path.join(tmpdir_path, "runs"))
    fm, threshold = MD.load_recorded(runs, "decision tree")
    assert fm.key == "tree" and fm.features == ["a", "c"]
    assert threshold == {r.model: r.threshold for r in board.collect()}["tree"]
    train.write.parquet(os.path.join(tmpdir_path, "data.parquet"))
    metrics = jobs.evaluate_job(spark, os.path.join(tmpdir_path, "data.parquet"), os.path.join(tmpdir_path, "runs"),
                                os.path.join(tmpdir_path, "eval")).first()
    assert metrics.roc_auc == 1.0 and metrics.threshold == threshold
    assert spark.read.parquet(os.path.join(tmpdir_path, "eval", "predictions")).columns == ["ra", "y_true", "y_score", "y_pred"]
    assert os.path.isdir(os.path.join(tmpdir_path, "leaderboard"))
    with pytest.raises(LookupError):
        MD.load_recorded(runs, "rf")
    with pytest.raises(ValueError, match="unknown model key"):
        MD.load_recorded(runs, "no such model")


def test_promotions_name_the_model(spark):
    runs = spark.createDataFrame([("rf", "r1", 1), ("rf", "r2", 2), ("tree", "r1", 1), ("tree", "r2", 2)],
                                 "model string, run_id string, run_ts int")
    prom = spark.createDataFrame([("rf", "r1", 9)], "model string, run_id string, promoted_at int")
    got = {r.model: r.run_id for r in RG.promote(runs, prom).collect()}
    assert got == {"rf": "r1", "tree": "r2"}
    with pytest.raises(ValueError):
        RG.promote(runs, prom.drop("model"))


def test_leaderboard_rejects_unknown_models(spark):
    board = spark.createDataFrame([("rf", 0.9)], "model string, test_roc_auc double")
    assert RG.leaderboard(board, model_key="Random Forest").count() == 1
    with pytest.raises(ValueError, match="unknown model key"):
        RG.leaderboard(board, model_key="random forrest")


def test_repeated_batch_leaves_one_report(spark, tmpdir_path):
    ref = spark.createDataFrame([(float(i % 10),) for i in range(100)], "x double")
    feat, summ = (os.path.join(tmpdir_path, d) for d in ("feat", "summ"))
    for batch in (0, 1, 1):
        DM.report_batch(ref, ref, batch, feat, summ)
    assert spark.read.parquet(feat).count() == 2 and spark.read.parquet(summ).count() == 2
    assert [r.batch_id for r in DM.latest_features(spark, feat).collect()] == [1]
