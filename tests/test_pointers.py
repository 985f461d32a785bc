from sparkpanel.operators import registry as RG

FIELDS = "id int, base string, model_path string, path string, latest_model_path string"


def test_first_existing_candidate(spark):
    rows = [(1, "/m", "gone/model_rf_20250101_000000.joblib", "  ", "model_tree_20260101_000000.joblib"),  # next key
            (2, "/m", "here.joblib", None, None),  # against the working folder before the pointer's
            (3, "/m", "only.joblib", None, None),  # against the pointer's folder
            (4, "/m/sub/", "../only.joblib", None, None),
            (5, "m", "/abs/x.joblib", None, "here.joblib"),
            (6, "/m", "gone", None, None), (7, "/m", None, None, None),
            (8, "rel/./a", "b.joblib", None, None)]
    existing = spark.createDataFrame([(p,) for p in (
        "/m/model_tree_20260101_000000.joblib", "/work/here.joblib", "/m/here.joblib", "/m//only.joblib", "/abs/x.joblib",
        "/work/rel/a/b.joblib", "/m/only.joblib")], "path string")
    ptr = spark.createDataFrame(rows, FIELDS)
    out = RG.resolve_existing(ptr, "base", existing, "/work")
    assert out.columns == [*ptr.columns, "resolved_path", "path_run_id", "path_model"]
    got = {r.id: r for r in out.collect()}
    assert {i: r.resolved_path for i, r in got.items()} == {
        1: "/m/model_tree_20260101_000000.joblib", 2: "/work/here.joblib", 3: "/m/only.joblib", 4: "/m/only.joblib",
        5: "/abs/x.joblib", 6: None, 7: None, 8: "/work/rel/a/b.joblib"}
    assert (got[1].path_run_id, got[1].path_model) == ("20260101_000000", "tree")
    assert RG.resolve_existing(ptr.limit(0), "base", existing, "/work").count() == 0
    assert RG.resolve_existing(ptr, "base", existing.limit(0), "/work").where("resolved_path is null").count() == 8


def test_pointers_without_candidates_share_no_key(spark, monkeypatch):
    ptr = spark.range(60).selectExpr("cast(id as int) id", "'/m' base", "if(id % 3 = 0, concat('x', id), null) model_path", "cast(null as string) path")
    joined, real = [], type(ptr).join
    monkeypatch.setattr(type(ptr), "join", lambda self, other, on, how: joined.append((self, on)) or real(self, other, on, how))
    out = RG.resolve_existing(ptr, "base", spark.createDataFrame([("/m/x3",)], "p string"), "/work")
    assert {r.id: r.resolved_path for r in out.collect()} == {i: "/m/x3" if i == 3 else None for i in range(60)}
    (left, key), = joined
    assert left.count() == 20 * 2 + 40 and left.groupBy(key).count().agg({"count": "max"}).first()[0] == 1


def test_model_info_names_the_expected_features(spark):
    latest = spark.createDataFrame([("tree", "/m/t", 0.4, ["a", "b"]), ("rf", "/m/r", None, None)],
                                   "model string, model_path string, threshold double, features array<string>")
    got = {r.model: (r.n_features, r.features) for r in RG.model_info(latest).collect()}
    assert got == {"tree": (2, ["a", "b"]), "rf": (0, [])}
