"""Token-ID / binary output with Elias-Fano document boundaries (operator 3).

``write_ids`` encodes every whole text and writes one folder of shards.  A
shard is one row of a Parquet file: the concatenated ids as little-endian
integers (2 bytes if the vocabulary fits), the doc_ids, and the boundaries
``0, n_1, n_1 + n_2, ...`` in Elias-Fano form: the low ``l`` bits of each value
packed side by side, the high parts in unary, and the place of every 64th set
bit of the unary part, from which ``select`` finds any boundary by looking at
one short stretch.  That takes about ``2 + log2(ids / documents)`` bits a
document and no 64-bit table.  Shards follow ascending doc_id (null first,
equal doc_ids by text): a range shuffle and a sort within partitions, each
partition cut into shards of ``SHARD_IDS`` ids (one document is never cut).
Tasks are short against the words of a language, so a worker keeps the words
it has met from task to task (``KEPT_BYTES`` at most) until it reads ids.

Null, empty and blank texts hold the end id alone.  An empty
table gives an empty folder.  Repeated rows are separate documents.  A very long text is encoded at
once and may be a shard of its own.  Only doc_id and text are read, so extra columns can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, tokens
from .arrays import give_back, raw_texts

SHARD_IDS = 4_000_000
SAMPLE = 64
STRETCH = 64  # samples that one step of select_many reads
ENCODE_BYTES = 1 << 20
KEPT_BYTES = 256 << 20  # of words that a worker remembers from one task of write_ids to the next

SHARDS = ("part int, shard int, ids_before long, n_docs int, n_ids long, id_bytes int, doc_ids array<long>, "
          "low_bits int, low binary, high binary, places binary, ids binary")


class EliasFano:
    """A non-decreasing sequence from 0 to ``top`` in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, places: bytes):
        self.n, self.low_bits, self.low, self.high, self.places = n, low_bits, low, high, places

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, top = len(values), int(values[-1])
        bits = max(0, int(math.floor(math.log2(max(1, top / n)))))
        low = np.packbits(((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        return cls(n, bits, low.tobytes(), np.packbits(high, bitorder="little").tobytes(),
                   ones[::SAMPLE].astype("<u4").tobytes())

    def _low(self, i: np.ndarray) -> np.ndarray:
        out, low = np.zeros(len(i), np.int64), np.frombuffer(self.low, np.uint8)
        for b in range(self.low_bits):
            at = i * self.low_bits + b
            out |= ((low[at >> 3] >> (at & 7)) & 1).astype(np.int64) << b
        return out

    def select(self, i: int) -> int:
        """Value i: from the sampled place before it, count set bits up to it."""
        place = int(np.frombuffer(self.places, "<u4")[i // SAMPLE])
        skip, byte = i % SAMPLE, place >> 3
        word, left = self.high[byte] >> (place & 7) << (place & 7), skip + 1
        while (ones := word.bit_count()) < left:
            left, byte = left - ones, byte + 1
            word = self.high[byte]
        for _ in range(left - 1):
            word &= word - 1
        at = byte * 8 + (word & -word).bit_length() - 1
        return (at - i) << self.low_bits | int(self._low(np.array([i]))[0])

    def select_many(self, i: np.ndarray) -> np.ndarray:
        """Values at ascending places ``i``: each from the sampled place before it, as ``select`` does, a few
        samples' stretch of the unary part at a time."""
        i = np.asarray(i, np.int64)
        places, high = np.frombuffer(self.places, "<u4").astype(np.int64), np.frombuffer(self.high, np.uint8)
        sample, out, at = i // SAMPLE, np.zeros(len(i), np.int64), 0
        while at < len(i):
            first = sample[at]
            to = int(np.searchsorted(sample, first + STRETCH, side="left"))
            begin = places[first]
            end = places[first + STRETCH] + 1 if first + STRETCH < len(places) else len(high) * 8
            bits = np.unpackbits(high[begin >> 3:(end + 7) >> 3], bitorder="little")[begin & 7:]
            ones = np.flatnonzero(bits) + begin
            out[at:to] = ones[i[at:to] - first * SAMPLE]
            at = to
        return (out - i) << self.low_bits | self._low(i)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))
        i = np.arange(self.n)
        return (ones[:self.n] - i) << self.low_bits | self._low(i)


def encoded(batches: Iterator[pa.RecordBatch], path: str,
            kept: int = 0) -> Iterator[tuple[pa.RecordBatch, int, list[bytes]]]:
    """(batch, first row, ids of some rows) over all rows, about ENCODE_BYTES of text at a time.  With ``kept``
    the words met stay in the worker for its next task, in at most so many bytes; else they are freed."""
    enc = tokens.encoder(path)
    enc.room = kept
    try:
        for batch in batches:
            data, offsets = raw_texts(batch.column("text"))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + ENCODE_BYTES, side="right")) - 1)
                j = min(j, batch.num_rows)
                yield batch, i, enc.encode_many([data[a:b].tobytes() for a, b in zip(offsets[i:j], offsets[i + 1:j + 1])])
                i = j
    finally:
        if not kept:
            enc.forget()  # workers outlive tasks
        give_back()


def _shard(part: int, shard: int, before: int, ids: list[bytes], doc_ids: list, width: int) -> pa.RecordBatch:
    sizes = np.array([len(x) // width for x in ids], np.int64)
    ends = EliasFano.of(np.concatenate([[0], np.cumsum(sizes)]))
    values = (part, shard, before, len(ids), int(sizes.sum()), width, doc_ids, ends.low_bits, ends.low, ends.high,
              ends.places, b"".join(ids))
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()),
             pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    names = [x.split()[0] for x in SHARDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)


def write_ids(docs: DataFrame, out: str, vocabulary: str, end_id: int, shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of all documents, each followed by ``end_id``, as shards under ``out``."""
    def run(batches):
        part, dtype = TaskContext.get().partitionId(), tokens.encoder(vocabulary).dtype
        end = np.array([end_id], dtype).tobytes()
        shard, before, n, ids, doc_ids = 0, 0, 0, [], []
        for batch, first, found in encoded(batches, vocabulary, KEPT_BYTES):
            keys = batch.column("doc_id").slice(first, len(found)).to_pylist()
            for key, x in zip(keys, found):
                m = len(x) // dtype.itemsize + 1
                if ids and n + m > shard_ids:
                    yield _shard(part, shard, before, ids, doc_ids, dtype.itemsize)
                    shard, before, n, ids, doc_ids = shard + 1, before + n, 0, [], []
                ids.append(x + end)
                doc_ids.append(key)
                n += m
        if ids:
            yield _shard(part, shard, before, ids, doc_ids, dtype.itemsize)

    tie = F.xxhash64("text")
    ordered = shared.doc_text(docs).repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    ordered.mapInArrow(run, SHARDS).write.option("compression", "zstd").parquet(out)


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, id_bytes and ids of each written document."""
    shards = spark.read.schema(SHARDS).parquet(out)
    # one row for each written partition; the running sum gives where it starts in the whole array
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    starts, total = [], 0
    for row in parts:
        starts.append((row["part"], total))
        total += row["n"]
    base = spark.createDataFrame(starts, "part int, part_start long")

    def run(batches):
        tokens.forget_all()  # a worker that wrote may read
        for batch in batches:
            for r in batch.to_pylist():
                ends = EliasFano(r["n_docs"] + 1, r["low_bits"], r["low"], r["high"], r["places"])
                ends = ends.select_many(np.arange(r["n_docs"] + 1))
                w, ids, at = r["id_bytes"], memoryview(r["ids"]), r["part_start"] + r["ids_before"]
                yield pa.RecordBatch.from_arrays([
                    pa.array(r["doc_ids"], pa.int64()), pa.array(at + ends[:-1], pa.int64()),
                    pa.array(np.diff(ends), pa.int64()), pa.array([w] * r["n_docs"], pa.int32()),
                    pa.array([bytes(ids[a * w:b * w]) for a, b in zip(ends[:-1], ends[1:])], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "id_bytes", "ids"])

    return (shards.join(F.broadcast(base), "part")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, id_bytes int, ids binary"))


def document_at(shard: dict, i: int) -> np.ndarray:
    """Ids of document i of one shard row, by two selects."""
    ends = EliasFano(shard["n_docs"] + 1, shard["low_bits"], shard["low"], shard["high"], shard["places"])
    a, b, w = ends.select(i), ends.select(i + 1), shard["id_bytes"]
    return np.frombuffer(shard["ids"][a * w:b * w], f"<u{w}")


def id_table(docs: DataFrame, out: str, vocabulary: str, end_id: int) -> DataFrame:
    """Write, read back, and return doc_id, start, n_tokens and the crc32 of the ids as unsigned 32-bit integers."""
    write_ids(docs, out, vocabulary, end_id)

    def run(batches):
        import zlib
        for batch in batches:
            sums = [zlib.crc32(np.frombuffer(x, f"<u{w}").astype("<u4"))
                    for x, w in zip(batch.column("ids").to_pylist(), batch.column("id_bytes").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"),
                                              pa.array(sums, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_ids(docs.sparkSession, out).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
