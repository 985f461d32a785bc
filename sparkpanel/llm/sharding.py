"""Reproducible sharding by a Feistel permutation of global row numbers (operator 11).

Rows are numbered 0 .. n - 1 by doc_id (null first), then by a hash of the
text.  A keyed Feistel network permutes the numbers: a number is a pair
(left, right) of a grid of ``height x width`` cells with at most
``sqrt(n)`` cells more than rows, and each round adds a hash of one half to
the other.  A number that lands beyond n walks on along its cycle until it is
below n.  Place p of the permuted order is slot ``p div shards`` of shard
``p mod shards``, so shard sizes differ by one row at most, slots have no
gaps, and shard and slot follow from the row number, n, the seed and the
number of shards alone; ``Permutation`` computes both ways without a job.

Everything runs as DataFrame functions.  The law is ``rows``; the method forms
no groups, so equal texts are dealt like any other rows.

Null text: 0 bytes (size 16, crc32 0); empty and blank texts are texts like
others; a very long text is read once, by its own task, and never shuffled.
Null doc_ids come first.  Ties (one doc_id on several rows) follow the text's
hash; rows equal in both are interchangeable, and each has its own place.
An empty table gives no rows.  Extra columns don't reach ``shard`` and travel
inside one struct through ``write_shards``, so their names can't clash.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

SHARDS = 40
SEED = 20
ROUNDS = 8


def grid(n: int) -> tuple[int, int]:
    """(height, width) with height * width >= n and less than height cells to spare."""
    height = max(1, math.isqrt(max(0, n - 1)) + 1)
    return height, max(1, -(-n // height))


class Permutation:
    """The permutation of 0 .. n - 1 in plain Python, for looking up single rows and places."""

    def __init__(self, n: int, seed: int = SEED):
        self.n, self.seed = n, seed
        self.height, self.width = grid(n)

    def _added(self, half: int, turn: int) -> int:
        import xxhash
        first = xxhash.xxh64_intdigest(struct.pack("<q", self.seed * ROUNDS + turn), 42)
        return (xxhash.xxh64_intdigest(struct.pack("<q", half), first) + (1 << 63)) % (1 << 64) - (1 << 63)

    def forward(self, number: int) -> int:
        """The place of a row number."""
        while True:
            left, right = divmod(number, self.width)
            for turn in range(ROUNDS):
                if turn % 2 == 0:
                    left = (left + self._added(right, turn)) % self.height
                else:
                    right = (right + self._added(left, turn)) % self.width
            number = left * self.width + right
            if number < self.n:
                return number

    def backward(self, place: int) -> int:
        """The row number at a place: the rounds undone in reverse order."""
        while True:
            left, right = divmod(place, self.width)
            for turn in reversed(range(ROUNDS)):
                if turn % 2 == 0:
                    left = (left - self._added(right, turn)) % self.height
                else:
                    right = (right - self._added(left, turn)) % self.width
            place = left * self.width + right
            if place < self.n:
                return place


def step(rows: DataFrame, column: str, n: int, seed: int) -> DataFrame:
    """Apply the network once to a column of numbers; one projection a round keeps the code linear."""
    height, width = grid(n)
    others = [c for c in rows.columns if c != column]
    out = rows.select(*others, F.expr(f"`{column}` div {width}L").alias("left"),
                      F.pmod(F.col(column), F.lit(width)).alias("right"))
    for turn in range(ROUNDS):
        key = F.lit(seed * ROUNDS + turn).cast("long")
        left, right = F.col("left"), F.col("right")
        if turn % 2 == 0:
            left = F.pmod(left + F.pmod(F.xxhash64(key, right), F.lit(height).cast("long")), F.lit(height).cast("long"))
        else:
            right = F.pmod(right + F.pmod(F.xxhash64(key, left), F.lit(width).cast("long")), F.lit(width).cast("long"))
        out = out.select(*others, left.alias("left"), right.alias("right"))
    return out.select(*others, (F.col("left") * F.lit(width).cast("long") + F.col("right")).alias(column))


def numbered(rows: DataFrame, *order: Column) -> tuple[DataFrame, int]:
    """A written copy of the rows with ``number`` (0, 1, ... in the given order), and how many there are.

    A range shuffle and a sort within partitions; each row's place in its partition plus the rows of the
    partitions before it.  Rows equal in the order are split by their place in the written input, so a
    doc_id on a third of all rows still spreads over partitions.
    """
    spark = rows.sparkSession
    keys = [*order, F.col("own")]
    # row numbers of a written table are the same when a lost task runs again; rows that differ in them alone
    # are interchangeable
    own = shared.keep(rows, "rows").withColumn("own", F.monotonically_increasing_id())
    cut = shared.keep(own.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("own")
                      .withColumn("number", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("number", 33)
    starts, total = [], 0
    for r in cut.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row for each written partition
        starts.append((r["part"], total))
        total += r["count"]
    if not total:
        return cut, 0
    first = spark.createDataFrame(starts, "part long, first long")
    place = F.col("first") + F.col("number").bitwiseAND(F.lit((1 << 33) - 1))
    return (cut.withColumn("part", part).join(F.broadcast(first), "part")
            .withColumn("number", place).drop("part", "first")), total


def permuted(rows: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """``number`` (0 .. n - 1) replaced by ``place``, its image under the permutation."""
    once = step(rows.withColumnRenamed("number", "place"), "place", n, seed)
    height, width = grid(n)
    if height * width == n:
        return once
    # numbers that left the range: fewer than sqrt(n) + 1, the spare cells of the grid
    walk = shared.keep(once.filter(F.col("place") >= n).select(F.col("place").alias("spare"), F.col("place").alias("to")),
                       "spare")
    ended = []
    while not walk.isEmpty():
        moved = shared.keep(step(walk, "to", n, seed), "walk")
        ended.append(moved.filter(F.col("to") < n))
        walk = moved.filter(F.col("to") >= n)
    if not ended:
        return once
    ways = ended[0]
    for more in ended[1:]:
        ways = ways.unionByName(more)
    others = [c for c in once.columns if c != "place"]
    return (once.join(F.broadcast(ways), F.col("place") == F.col("spare"), "left")  # at most sqrt(n) + 1 rows of 16 bytes
            .select(*others, F.coalesce("to", "place").alias("place")))


def dealt(rows: DataFrame, shards: int) -> DataFrame:
    return (rows.withColumn("shard", F.pmod(F.col("place"), F.lit(shards)).cast("int"))
            .withColumn("slot", F.expr(f"place div {shards}L")).drop("place"))


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 16), text_crc32, law, shard, slot and grown_shard (null) of every row."""
    text = F.encode("text", "UTF-8")
    rows = shared.doc_text(docs).select("doc_id", (F.octet_length("text").cast("long") + 16).alias("size"),
                                        F.crc32(text).alias("text_crc32"), F.xxhash64("text").alias("text_hash"))
    rows, n = numbered(rows, F.col("doc_id"), F.col("text_hash"))
    return (dealt(permuted(rows.drop("text_hash"), n, seed), shards)
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard")))


def write_shards(docs: DataFrame, out: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Write the rows with all their columns under ``out``: struct ``row`` and slot, one folder a shard,
    each file sorted by slot.  Places are those of ``shard``."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    rows, n = numbered(rows, F.col("doc_id"), F.col("text_hash"))
    (dealt(permuted(rows.drop("text_hash", "doc_id"), n, seed), shards)
     .repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(out))
