"""End-to-end jobs composed from the operators (the reference's entry points).

``build_dataset``: raw ``;`` CSV per period -> cleaned period tables (the
interim layer, which also cuts the lineage) -> one pair table per
consecutive period pair -> one-row stats report per pair.

``drift_job``: reference table vs current table -> per-feature PSI rows and
a summary added to history tables partitioned by ``run_id``; returns the
overall status (the reference exits with code 2 on alert).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import drift as D
from .operators import pairs as P
from .operators import quality as Q
from .operators.clean import CleanConfig, clean_period
from .sources import io


def build_dataset(spark: SparkSession, raw: Mapping[int, str], out_dir: str, *, sep: str = ";",
                  encoding: str = "utf-8", id_col: str = "ra", target_col: str = "ian",
                  target_value=10, cfg: CleanConfig = CleanConfig(), fmt: str = "parquet",
                  multi_line: bool | str = "split") -> DataFrame:
    """Clean every period (each keeps its own schema, as the yearly files
    differ), write it to ``interim/<period>``, pair each period with the next
    one (J1 with the id checks), write ``pairs/pair_<t>_<t+1>`` and return the
    stats report (also written as JSON under ``out_dir/stats``).  The loop is
    over the handful of input periods; every step inside is a Spark job.
    ``multi_line`` as in ``io.read_csv_strings``."""
    base = out_dir.rstrip("/")
    years = sorted(int(y) for y in raw)
    if not years:
        raise ValueError("no input periods")
    interim = {}
    for year in years:
        cleaned = clean_period(io.read_csv_strings(spark, raw[year], sep=sep, encoding=encoding,
                                                   multi_line=multi_line), year, cfg)
        io.write_table(cleaned, f"{base}/interim/{year}")
        interim[year] = io.read_parquet(spark, f"{base}/interim/{year}")   # lineage cut
    stats = None
    for t in years:
        if t + 1 not in interim:
            continue
        pair = P.temporal_pair(interim[t], interim[t + 1], t, t + 1, id_col=id_col, target_col=target_col,
                               target_value=target_value, drop_feature_cols=(cfg.period_col,))
        path = f"{base}/pairs/pair_{t}_{t + 1}" + (".csv" if fmt == "csv" else "")
        io.write_table(pair, path, fmt=fmt)
        written = io.read_parquet(spark, path) if fmt == "parquet" else pair
        if Q.check_pair_table(written, period_col=cfg.period_col).first()["n_bad_target"]:
            raise ValueError("target outside {0, 1}")
        one = Q.basic_stats(written, "y").select(F.lit(t).alias("year_t"), F.lit(t + 1).alias("year_t1"), "*")
        stats = one if stats is None else stats.unionByName(one)
    if stats is None:
        raise ValueError("no consecutive periods to pair")
    stats = spark.createDataFrame(stats.collect(), stats.schema)  # one row per pair
    io.write_report(stats, f"{base}/stats")
    return stats


def drift_job(spark: SparkSession, reference_path: str, current_path: str, output_dir: str, *,
              warn: float = D.WARN, alert: float = D.ALERT,
              exclude: Iterable[str] = D.DEFAULT_EXCLUDE, multi_line: bool | str = "split",
              run_id: str | None = None) -> str:
    """Compare two tables, add the feature rows and the summary (D5: with stamp, report paths and the
    compared tables) to history tables (S10) and return ``ok`` / ``warn`` / ``alert``.

    A run is one ``run_id`` partition of the history, written over: a run that is started again under its id
    replaces itself.  Ids default to the time and a random part, so two runs of one second stay apart."""
    ref = io.read_table(spark, reference_path, multi_line=multi_line)
    cur = io.read_table(spark, current_path, multi_line=multi_line)
    base = output_dir.rstrip("/")
    run_ts = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")).first()[0]
    run_id = run_id or f"{run_ts}_{uuid.uuid4().hex[:8]}"
    paths = {name: f"{base}/{name}/run_id={run_id}" for name in ("drift_features", "drift_summary")}
    D.drift_table(ref, cur, warn, alert, exclude).withColumn("run_ts", F.lit(run_ts)).write.mode("overwrite") \
        .parquet(paths["drift_features"])
    table = spark.read.parquet(paths["drift_features"]).drop("run_ts")
    summary = D.drift_summary(table, warn, alert).withColumns({
        "run_ts": F.lit(run_ts), "reference_path": F.lit(reference_path), "current_path": F.lit(current_path),
        "features_path": F.lit(paths["drift_features"]), "summary_path": F.lit(paths["drift_summary"])})
    summary.write.mode("overwrite").parquet(paths["drift_summary"])
    return spark.read.parquet(paths["drift_summary"]).first()["status"]


def latest_drift(spark: SparkSession, output_dir: str) -> DataFrame:
    """The feature rows of the newest run (by stamp, then id)."""
    base = output_dir.rstrip("/")
    runs = spark.read.parquet(f"{base}/drift_summary").select("run_ts", F.col("run_id").cast("string").alias("run_id"))
    newest = runs.agg(F.max(F.struct("run_ts", "run_id")).alias("r")).select(F.col("r.run_id").alias("run_id"))
    return spark.read.parquet(f"{base}/drift_features").withColumn("run_id", F.col("run_id").cast("string")).join(
        newest, "run_id", "left_semi")  # one row


def train_job(spark: SparkSession, train_path: str, test_path: str, artifacts_dir: str, *, cfg=None,
              feature_set: str = "all", variables: Iterable[str] | None = None, threshold: float | None = None,
              y: str = "y", id_col: str = "id", meta: Iterable[str] = ("year_t", "year_t1"),
              multi_line: bool | str = "split") -> DataFrame:
    """Fit the chosen model on one pair table with the chosen features (all that both tables share, or a
    list), take the given threshold or the best one on the train rows, save the model, record the run and
    return its row: model, features, threshold and the metrics on the test table."""
    from .operators import metrics as M
    from .operators import models as MD
    from .operators import registry as RG
    from .operators import schema as S
    cfg = cfg or MD.ModelConfig("logreg")
    train, test = io.load_train_test(spark, train_path, test_path, multi_line=multi_line)
    if y not in train.columns:
        raise ValueError(f"dataset lacks target column '{y}'")
    keep = (id_col, *meta, y)
    known = [c for c in train.columns if c not in keep and c in test.columns]
    features = [c for c in S.resolve_features(feature_set, list(variables or []) or None, known) if c in known]
    if not features:
        raise ValueError("none of the features is in both tables")
    numeric, categorical = S.feature_kinds(train, features)
    fm = MD.fit(train, numeric, categorical, cfg, y, id_col)
    at = float(threshold) if threshold is not None else MD.pick_on_train(fm, train, y)
    run_ts = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")).first()[0]
    path = f"{artifacts_dir.rstrip('/')}/model_{cfg.name}_{run_ts}_{uuid.uuid4().hex[:8]}"
    fm.model.write().save(path)
    got = M.metrics_at(MD.predict(fm, test, at), y, "score", at).select(
        F.lit(cfg.name).alias("model"), F.lit(f"{run_ts}_{path[-8:]}").alias("run_id"), F.lit(path).alias("model_path"),
        F.array(*[F.lit(c) for c in features]).alias("features"), "*", F.current_timestamp().alias("run_ts"))
    got = spark.createDataFrame(got.collect(), got.schema)  # one row
    RG.record_run(f"{artifacts_dir.rstrip('/')}/runs", got)
    return got


def evaluate_job(spark: SparkSession, dataset_path: str, runs_path: str, output_dir: str, *,
                 model_key: str | None = None, threshold: float | None = None, y: str = "y",
                 multi_line: bool | str = "split") -> DataFrame:
    """Score a pair table with the newest recorded run of a model, at its recorded threshold
    unless one is given; write ``predictions`` and ``metrics`` and return the metrics row."""
    from .operators import metrics as M
    from .operators import models as MD
    fm, recorded = MD.load_recorded(spark.read.parquet(runs_path), model_key)
    at = recorded if threshold is None else float(threshold)
    data = io.read_table(spark, dataset_path, multi_line=multi_line)
    if y not in data.columns:
        raise ValueError(f"dataset lacks target column '{y}'")
    base = output_dir.rstrip("/")
    scored = MD.predict(fm, data, at)
    keys = [c for c in data.columns if c not in {*fm.features, y}]
    io.write_table(scored.select(*keys, F.col(y).alias("y_true"), F.col("score").alias("y_score"),
                                 F.col("pred").alias("y_pred")), f"{base}/predictions")
    written = io.read_parquet(spark, f"{base}/predictions")
    metrics = M.metrics_at(written, "y_true", "y_score", at).withColumn("model", F.lit(fm.key))
    metrics = spark.createDataFrame(metrics.collect(), metrics.schema)  # one row
    io.write_report(metrics, f"{base}/metrics")
    return metrics
