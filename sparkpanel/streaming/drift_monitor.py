"""Scheduled drift monitoring as a Structured Streaming job.

The reference runs its drift report once a day from a scheduler.  Here each
newly arrived batch of the current table (files landing in a folder, one
folder per period or day) is compared with a fixed reference table inside
``foreachBatch``; the per-feature rows and the summary go to two history
tables partitioned by ``batch_id``.  ``Trigger.AvailableNow`` gives the
daily-batch behaviour (process what has arrived, then stop).  Spark may run a
batch again after a failure; a batch overwrites its own partition, so a
repeated one leaves one report.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift as D


def _put(df: DataFrame, path: str) -> None:
    """Write a batch's partition, or replace it if the batch runs again."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def report_batch(reference: DataFrame, batch: DataFrame, batch_id: int, features_path: str,
                 summary_path: str, warn: float = D.WARN, alert: float = D.ALERT,
                 exclude: Iterable[str] = D.DEFAULT_EXCLUDE) -> None:
    """D4+D5+D6 for one micro-batch; both outputs share one ``run_ts``."""
    if batch.isEmpty():
        return
    stamp = F.lit(spark_stamp(batch.sparkSession))
    # the per-feature table feeds two writes; keep it for the batch only
    table = D.drift_table(reference, batch, warn, alert, exclude).persist()
    try:
        _put(table.withColumns({"batch_id": F.lit(int(batch_id)), "run_ts": stamp}), features_path)
        summary = D.drift_summary(table, warn, alert)
        _put(summary.withColumns({"batch_id": F.lit(int(batch_id)), "run_ts": stamp}), summary_path)
    finally:
        table.unpersist()


def spark_stamp(spark: SparkSession) -> str:
    """One run stamp per batch, taken from the session clock."""
    return spark.range(1).select(F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")).first()[0]


def start_monitor(spark: SparkSession, reference: DataFrame, source_dir: str, checkpoint: str,
                  features_path: str, summary_path: str, fmt: str = "parquet",
                  warn: float = D.WARN, alert: float = D.ALERT,
                  exclude: Iterable[str] = D.DEFAULT_EXCLUDE, available_now: bool = True,
                  max_files_per_trigger: int | None = None):
    """Start the monitor over files arriving in ``source_dir`` (schema taken
    from the reference table).  Returns the ``StreamingQuery``.

    The reference is materialised once (``checkpoint`` into the session's
    ``spark.checkpoint.dir``), so every micro-batch reads the stored rows
    instead of re-running the reference's lineage."""
    from ..session import checkpoint_dir
    checkpoint_dir(spark)
    reference = reference.checkpoint(eager=True)
    reader = spark.readStream.schema(reference.schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    stream = reader.load(source_dir)
    writer = (stream.writeStream
              .foreachBatch(lambda df, bid: report_batch(reference, df, bid, features_path, summary_path,
                                                         warn, alert, exclude))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 day")
    return writer.start()


def latest_features(spark: SparkSession, features_path: str) -> DataFrame:
    """S10 'latest' view: the rows of the newest report (by stamp, then batch: stamps have seconds)."""
    history = spark.read.parquet(features_path)
    newest = history.agg(F.max(F.struct("run_ts", "batch_id")).alias("n")).select("n.run_ts", "n.batch_id")
    return history.join(newest, ["run_ts", "batch_id"], "left_semi")
