"""Row blocks for iterative fits.

``pyspark.ml`` starts several small jobs for every step of a fit.  The fits of
``boosting`` and ``logistic`` need one sum over all rows a step, so the rows
are packed once into blocks of numpy arrays (``BLOCK_ROWS`` rows each), kept
by Spark in memory and on disk, and every step is one pass with one tree
reduction.  Nothing row-sized reaches the driver: a step returns sums of the
size of the model.  Blocks are rebuilt from their source when an executor is
lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 15


def matrix_of(column: pa.Array) -> np.ndarray:
    """A list-of-doubles column whose rows are equally long, as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def packed(df: DataFrame, features: Column, numbers: Sequence[tuple[str, Column]], key: Column | None = None,
           encode: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """One row a block: n, the feature matrix (as float64, or what ``encode`` makes of it) and the number
    columns as raw bytes, and the rows' keys."""
    cols = [vector_to_array(features).alias("x"), *[c.cast("double").alias(n) for n, c in numbers]]
    names, keyed = [n for n, _ in numbers], key is not None
    if keyed:
        cols.append(key.cast("long").alias("key"))
    schema = "n long, x binary, " + "".join(f"{n} binary, " for n in names) + "key binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch.column("x"))
            x = np.ascontiguousarray(x if encode is None else encode(x))
            out = [pa.array([batch.num_rows], pa.int64()), pa.array([x.tobytes()], pa.binary())]
            for n in names:
                out.append(pa.array([batch.column(n).to_numpy(zero_copy_only=False).astype("<f8").tobytes()], pa.binary()))
            keys = batch.column("key").to_numpy(zero_copy_only=False).astype("<i8").tobytes() if keyed else b""
            yield pa.RecordBatch.from_arrays([*out, pa.array([keys], pa.binary())], names=["n", "x", *names, "key"])

    return df.select(*cols).mapInArrow(run, schema)


def block_rdd(blocks: DataFrame, make: Callable[[dict], object], target_rows: int = 1 << 17, spread: int | None = None) -> RDD:
    """The blocks as Python objects, persisted; partitions are sized from the data.  With ``spread``, more blocks than
    one partition takes are dealt evenly to at least that many partitions."""
    rows = int(blocks.agg(F.sum("n")).first()[0] or 0)
    parts = max(1, -(-rows // target_rows))
    if spread and parts > 1:
        parts = max(parts, spread)
        blocks = blocks.repartition(parts)
    rdd = blocks.rdd.map(lambda r: make(r.asDict()))
    if parts < rdd.getNumPartitions():
        rdd = rdd.coalesce(parts)
    return rdd.persist(StorageLevel.MEMORY_AND_DISK)


def summed(rdd: RDD, step: Callable[..., np.ndarray | tuple | None], depth: int = 2, whole: bool = False):
    """The sum of ``step(block)`` (an array, or a tuple of arrays) over all blocks; ``None`` without blocks.
    With ``whole``, of ``step(index, blocks)`` over the partitions."""
    def inside(blocks):
        total = None
        for b in blocks:
            total = _add(total, step(b))
        yield total

    parts = rdd.mapPartitionsWithIndex(lambda i, blocks: [step(i, blocks)]) if whole else rdd.mapPartitions(inside)
    if rdd.getNumPartitions() <= 16:
        found = parts.collect()  # one sum for each of a few partitions
        total = None
        for x in found:
            total = _add(total, x)
        return total
    return parts.treeReduce(_add, depth)


def _add(a, b):
    if a is None or b is None:
        return b if a is None else a
    if isinstance(a, tuple):
        return tuple(x + y for x, y in zip(a, b))
    return a + b
