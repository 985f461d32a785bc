"""Drift per period over a stream, whatever batches a period arrives in.

The reference fixes each numeric column's bins and each column's shares once.
The stream keeps a running count by (period, feature, cell), a cell being a
bin or a category: Structured Streaming's state, of the size of its
result, with no watermark, so a late file still counts for its period.  Every
trigger writes the counts that changed (a batch run again replaces its own
partition), and ``report`` makes each period's drift from the newest counts.
A period's report after its last file is the report of the whole period,
however the files were cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.scalar import band, to_double
from ..operators import drift as D
from ..operators.ranking import exact_quantiles
from ..operators.schema import q


class Cells:
    """How the reference's columns are cut into cells: inner edges by numeric column, and the other columns."""

    def __init__(self, edges: dict[str, list[float] | None], categorical: list[str], order: list[str]):
        self.edges, self.categorical, self.order = edges, categorical, order

    @classmethod
    def of(cls, reference: DataFrame, exclude: Iterable[str] = D.DEFAULT_EXCLUDE, bins: int = 10) -> Cells:
        order, num, cat = D.split_kinds(reference, reference, set(exclude))
        edges: dict[str, list[float] | None] = {c: None for c in num}
        if num:
            found = exact_quantiles(D._long(reference, [], num, True), ["feature"], "v", D.decile_probs(bins))
            for r in found.collect():  # one row a column
                e = sorted(set(r["q"]))
                edges[r["feature"]] = e[1:-1] if len(e) >= 2 else None
        return cls(edges, cat, order)

    def counted(self, df: DataFrame, by: list[str]) -> DataFrame:
        """(by..., feature, cell, n, known): the rows of each cell; numeric NULLs have the cell NULL."""
        def entry(feature: str, cell: Column, known: Column) -> Column:
            return F.struct(F.lit(feature).alias("feature"), cell.cast("string").alias("cell"), known.cast("long").alias("known"))

        entries = []
        for c, inner in self.edges.items():
            v = to_double(q(c))
            bin_ = sum(((F.lit(float(e)) < v).cast("int") for e in inner or []), F.lit(0))
            entries.append(entry(c, F.when(v.isNotNull(), bin_), v.isNotNull()))
        for c in self.categorical:
            entries.append(entry(c, F.coalesce(q(c).cast("string"), F.lit(D.NA)), q(c).isNotNull()))
        cells = df.select(*[q(k) for k in by], F.explode(F.array(*entries)).alias("x"))
        return cells.groupBy(*by, F.col("x.feature").alias("feature"), F.col("x.cell").alias("cell")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("x.known").alias("known"))


def report(ref_counts: DataFrame, counts: DataFrame, cells: Cells, period: str, warn: float = D.WARN,
           alert: float = D.ALERT) -> DataFrame:
    """The drift rows of every period (as ``drift.drift_table``) from the counts of both sides."""
    keys = [period, "feature"]
    cur = counts.groupBy(*keys).agg(F.sum("n").alias("t_cur"), F.sum("known").alias("n_cur"))
    ref = ref_counts.groupBy("feature").agg(F.sum("n").alias("t_ref"), F.sum("known").alias("n_ref"))
    # one row for each period and feature, and for each of them the cells of both sides
    frame = cur.join(ref, "feature", "left").fillna(0, ["t_ref", "n_ref"])
    both = (frame.select(*keys).join(ref_counts.select("feature", "cell"), "feature")
            .unionByName(counts.select(*keys, "cell")).filter("cell is not null").distinct())
    numeric = F.col("feature").isin(list(cells.edges))
    placed = (both.join(frame, keys)
              .join(ref_counts.select("feature", "cell", F.col("n").alias("c_ref")), ["feature", "cell"], "left")
              .join(counts.select(*keys, "cell", F.col("n").alias("c_cur")), [*keys, "cell"], "left"))
    total_ref, total_cur = (F.when(numeric, F.col(f"n_{s}")).otherwise(F.col(f"t_{s}")) for s in ("ref", "cur"))
    term = D._psi_term(D._prob(F.coalesce("c_ref", F.lit(0)), total_ref), D._prob(F.coalesce("c_cur", F.lit(0)), total_cur))
    psi = placed.groupBy(*keys).agg(F.sum(term).alias("psi"))
    flat = [c for c, e in cells.edges.items() if e is None]
    empty = numeric & ((F.col("n_ref") == 0) | (F.col("n_cur") == 0) | F.col("feature").isin(flat))
    score = F.when(empty, 0.0).otherwise(F.coalesce("psi", F.lit(0.0)))
    place = F.create_map(*[x for i, c in enumerate(cells.order) for x in (F.lit(c), F.lit(i))])
    return (frame.join(psi, keys, "left").withColumn("score", score)
            .select(period, "feature", F.when(numeric, "numeric_psi").otherwise("categorical_psi").alias("kind"), "score",
                    band("score", warn, alert).alias("status"), F.col("n_ref").cast("long").alias("n_ref"),
                    F.col("n_cur").cast("long").alias("n_cur"), place[F.col("feature")].alias("position")))


def start(spark: SparkSession, reference: DataFrame, source_dir: str, checkpoint: str, counts_path: str, period: str,
          exclude: Iterable[str] = D.DEFAULT_EXCLUDE, fmt: str = "parquet", max_files_per_trigger: int | None = None,
          available_now: bool = True):
    """Start counting the files of ``source_dir`` (columns of the reference and ``period``); returns the
    ``StreamingQuery`` and the cells."""
    cells = Cells.of(reference, {*exclude, period})
    schema = reference.schema
    if period not in reference.columns:
        schema = T.StructType([*schema.fields, T.StructField(period, T.IntegerType())])
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    counted = cells.counted(reader.load(source_dir), [period])

    def put(df: DataFrame, batch_id: int) -> None:
        (df.withColumn("batch_id", F.lit(int(batch_id))).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(counts_path))

    writer = counted.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 day")
    return writer.start(), cells


def newest_counts(spark: SparkSession, counts_path: str, period: str) -> DataFrame:
    """The last written count of every cell."""
    keys = [period, "feature", "cell"]
    last = Window.partitionBy(*keys).orderBy(F.desc("batch_id"))
    return (spark.read.parquet(counts_path).withColumn("_at", F.row_number().over(last)).filter("_at = 1")
            .drop("_at", "batch_id"))


def period_report(spark: SparkSession, reference: DataFrame, cells: Cells, counts_path: str, period: str,
                  warn: float = D.WARN, alert: float = D.ALERT) -> DataFrame:
    """Drift of every period that has arrived so far."""
    return report(cells.counted(reference, []), newest_counts(spark, counts_path, period), cells, period, warn, alert)
