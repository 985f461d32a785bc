import os

from pyspark.sql import functions as F

from sparkpanel.streaming import drift_monitor as DM


def test_drift_monitor_available_now(spark, tmpdir_path):
    ref = spark.createDataFrame([(float(i % 10), "a" if i % 2 else "b") for i in range(100)], "x double, c string")
    src = os.path.join(tmpdir_path, "incoming")
    spark.createDataFrame([(float(i % 10) + 5, "a") for i in range(50)], "x double, c string") \
        .write.parquet(os.path.join(src, "day=1"))
    q = DM.start_monitor(spark, ref, src + "/*", os.path.join(tmpdir_path, "ckpt"),
                         os.path.join(tmpdir_path, "feat"), os.path.join(tmpdir_path, "summ"))
    q.awaitTermination(120)
    feats = spark.read.parquet(os.path.join(tmpdir_path, "feat"))
    assert {r.feature for r in feats.collect()} == {"x", "c"}
    summ = spark.read.parquet(os.path.join(tmpdir_path, "summ")).first()
    assert summ.status == "alert" and summ.n_features == 2
    assert DM.latest_features(spark, os.path.join(tmpdir_path, "feat")).count() == 2
