import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkpanel.operators import drift as D
from sparkpanel.operators import sketches as SK
from sparkpanel.streaming import period_monitor as PM


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(8)
    rows = []
    for p in (1, 2, 3):
        for _ in range(1500):
            rows.append((p, float(rng.normal(p / 4)), None if rng.random() < 0.1 else float(rng.integers(0, 4)), 7.0,
                         [None, "a", "b", f"p{p}"][rng.integers(0, 4)]))
    return spark.createDataFrame(rows, "p int, x double, few double, one double, c string").repartition(5).cache()


def by_key(df):
    return {(r["p"], r["feature"]): r for r in df.collect()}


def test_sketches_come_near_the_exact_report(panel):
    exact = by_key(D.drift_by_period(panel, "p"))
    num, cat = SK.numeric_sketches(panel, ["p"], ["x", "few", "one"]), SK.category_counts(panel, ["p"], ["c"])
    before = lambda df: df.withColumn("p", F.col("p") + 1)
    got = by_key(SK.numeric_drift(before(num), num, ["p"])) | by_key(SK.category_drift(before(cat), cat, ["p"]))
    assert got.keys() == exact.keys()
    for key, r in got.items():
        assert (r["n_ref"], r["n_cur"]) == (exact[key]["n_ref"], exact[key]["n_cur"])
        assert abs(r["score"] - exact[key]["score"]) < (1e-9 if key[1] == "c" else 0.02)


def test_parts_of_a_period_merge(panel):
    half = panel.withColumn("part", F.pmod(F.xxhash64("x"), F.lit(2)))
    whole, parts = SK.numeric_sketches(panel, ["p"], ["x"]), SK.numeric_sketches(half, ["p", "part"], ["x"])
    merged = by_key(SK.merged_sketches(parts.drop("part"), ["p"]))
    assert {k: r["n"] for k, r in merged.items()} == {k: r["n"] for k, r in by_key(whole).items()}
    got = by_key(SK.numeric_drift(whole, SK.merged_sketches(parts.drop("part"), ["p"]), ["p"]))
    assert all(r["score"] < 0.01 for r in got.values())
    cats = SK.merged_counts(SK.category_counts(half, ["p", "part"], ["c"]).drop("part"), ["p"])
    assert cats.exceptAll(SK.category_counts(panel, ["p"], ["c"])).isEmpty()


@pytest.mark.parametrize("files,per_batch", [(1, None), (7, 2), (4, 1)])
def test_any_split_into_batches_gives_the_report_of_the_whole(spark, panel, tmpdir_path, files, per_batch):
    reference = panel.filter("p = 1").drop("p")
    arriving = panel.filter("p > 1").select("x", "few", "one", "c", "p")
    source = os.path.join(tmpdir_path, "in")
    arriving.repartition(files, F.xxhash64("x", "few")).write.parquet(source)  # periods are mixed in every file
    query, cells = PM.start(spark, reference, source, os.path.join(tmpdir_path, "ck"), os.path.join(tmpdir_path, "counts"), "p",
                            max_files_per_trigger=per_batch)
    query.awaitTermination(180)
    got = by_key(PM.period_report(spark, reference, cells, os.path.join(tmpdir_path, "counts"), "p"))
    want = by_key(D.drift_by_period(panel, "p", reference=1))
    assert got.keys() == want.keys()
    for key, r in got.items():
        w = want[key]
        assert (r["kind"], r["status"], r["n_ref"], r["n_cur"]) == (w["kind"], w["status"], w["n_ref"], w["n_cur"])
        assert r["score"] == pytest.approx(w["score"], abs=1e-9)
