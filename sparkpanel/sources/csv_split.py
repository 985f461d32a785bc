"""Large CSV files with quoted line breaks, read in splits.

A reader that allows line breaks inside quotes has to start at the top of a
file, so Spark's ``multiLine`` reads each file in one task.  Here every split of
a file counts the quotes of its physical lines; the sum over the splits
before it tells whether a split begins inside a quoted field; then each split
puts its own records together.  A record that reaches over the end of a split
travels as one fragment a split, keyed by where it begins, and is joined from its fragments.

Quotes belong to quoted fields (a doubled quote inside them counts twice, so it
changes nothing).  A file that holds a quote elsewhere (``5" pipe``) breaks that
rule; ``well_formed`` finds such records, and ``sources.io`` then reads it in one task.
Lines end at ``\\n`` or ``\\r\\n``; inside quotes, too, ``\\r\\n`` becomes ``\\n``, as in Spark's own reader.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ``opens``/``closes``: whether the record begins / ends in this piece.
PIECES = "file string, block long, seq long, opens boolean, closes boolean, text string"


def physical_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where the split begins) and the text of each line, in order within a split."""
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.col("value")))


def split_states(lines: DataFrame) -> DataFrame:
    """One row a split: whether it begins inside a quoted field, and whether it is its file's first."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    sums = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("file", "block", F.coalesce(F.sum("odd").over(before) % 2 == 1, F.lit(False)).alias("inside"),
                       F.col("block").eqNullSafe(F.min("block").over(Window.partitionBy("file"))).alias("first"))


def pieces(lines: DataFrame, states: DataFrame) -> DataFrame:
    """Whole records and the fragments at the splits' ends, in order within a split."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seq, held, opens, inside = None, 0, [], True, False

        def fragment(text: str, begins: bool, ends: bool, number: int) -> pa.RecordBatch:
            values = [[at[0]], [at[1]], [number], [begins], [ends], [text]]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)],
                                              names=[c.split()[0] for c in PIECES.split(", ")])

        for batch in batches:
            files, blocks = batch.column("file").to_pylist(), batch.column("block").to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(blocks[1:] != blocks[:-1]) + 1
            edge = sorted({0, *edge.tolist(), *[i for i in range(1, len(files)) if files[i] != files[i - 1]], len(files)})
            for a, b in zip(edge[:-1], edge[1:]):
                key = (files[a], int(blocks[a]))
                if key != at:
                    if held:
                        yield fragment("\n".join(held), opens, False, seq)
                    at, seq, held = key, 0, []
                    inside = bool(batch.column("inside")[a].as_py())
                    opens = not inside
                value = batch.column("value").slice(a, b - a)
                odd = pc.count_substring(value, '"').to_numpy(zero_copy_only=False) % 2
                state = (np.cumsum(odd) + inside) % 2 == 1  # inside a quoted field after each line
                ends = np.flatnonzero(~state)
                if len(ends) == b - a and not held and opens:  # one record a line
                    yield _records(key, seq, value)
                    seq += b - a
                    continue
                texts = value.to_pylist()
                out, begin = [], 0
                for end in ends.tolist():
                    line = "\n".join([*held, *texts[begin:end + 1]]) if held else "\n".join(texts[begin:end + 1])
                    if opens:
                        out.append(line)
                    else:
                        yield fragment(line, False, True, seq)
                        seq += 1
                    held, opens, begin = [], True, end + 1
                if out:
                    yield _records(key, seq, pa.array(out, pa.string()))
                    seq += len(out)
                held += texts[begin:]
                inside = bool(state[-1])
        if held:
            yield fragment("\n".join(held), opens, False, seq)

    def _records(key, seq, value):
        n = len(value)
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(np.arange(seq, seq + n)),
             pa.array([True] * n), pa.array([True] * n), value.cast(pa.string())],
            names=[c.split()[0] for c in PIECES.split(", ")])

    marked = lines.join(F.broadcast(states), ["file", "block"])  # one row a split
    return marked.select("file", "block", "inside", "value").mapInArrow(run, PIECES)


def records(spark: SparkSession, path: str) -> DataFrame:
    """text of each record of the files, without their first records (the headers) and without empty lines."""
    lines = physical_lines(spark, path)
    states = split_states(lines)
    states = spark.createDataFrame(states.collect(), states.schema)  # one row a split
    parts = pieces(lines, states)
    whole = parts.filter("opens AND closes")
    # fragments: at most two a split; a record's pieces share the number of records begun before them
    begun = Window.partitionBy("file").orderBy("block", "seq").rowsBetween(Window.unboundedPreceding, 0)
    joined = (parts.filter("NOT (opens AND closes)").withColumn("record", F.sum(F.col("opens").cast("long")).over(begun))
              .groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "text"))).alias("p"))
              .select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["seq"].alias("seq"),
                      F.array_join(F.col("p")["text"], "\n").alias("text")))
    every = whole.select("file", "block", "seq", "text").unionByName(joined)
    first = F.col("first") & (F.col("seq") == 0)
    text = F.regexp_replace("text", "\r(?=\n)|\r\\z", "")
    return (every.join(F.broadcast(states.select("file", "block", "first")), ["file", "block"])
            .filter(~first).select(text.alias("text")).filter(F.col("text") != ""))


def well_formed(text: Column, sep: str) -> Column:
    """Whether every quote of a record opens or closes a field, or is doubled inside one."""
    s = re.escape(sep)
    field = rf'(?:"(?:[^"]|"")*+"|[^"{s}]*+)'
    return ~text.contains('"') | text.rlike(rf"^{field}(?:{s}{field})*+$")
