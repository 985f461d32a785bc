"""Exact deduplication with composable polynomial fingerprints (operator 10).

A text is cut into chunks.  Each chunk's hash is a polynomial in the chunk's
32-bit letters modulo 2**61 - 1, for two bases; the chunks of a text are hashed
side by side and combined by ``H(AB) = H(A) * r**len(B) + H(B)``, so a huge
text needs no single pass over it and chunk hashes from different tasks can be
joined by ``combine``.  Rows with equal length and fingerprints are then
compared chunk by chunk: per group and chunk number the least and the greatest
chunk must be equal.  Spark keeps only those two while it reads (before the
shuffle too), so no group is gathered anywhere.  Groups found unequal are split by
SHA-256 and compared again.

Texts are equal when identical after no change; null counts as empty.  Of
equal texts the row with the largest doc_id stays (null is least; of repeated
rows with that doc_id, one).  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .arrays import raw_texts

PRIME = (1 << 61) - 1
BASES = (1_498_236_401_274_837_229, 914_077_153_680_290_413)
CHUNK = 1 << 16  # bytes, a multiple of 4
BLOCK = 1 << 21  # bytes hashed at a time
KEY = ["fp1", "fp2", "n_bytes"]

_M31, _M30, _P = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1), np.uint64(PRIME)
_tables: dict[int, np.ndarray] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1 without 128-bit integers."""
    au, ad, bu, bd = a >> np.uint64(31), a & _M31, b >> np.uint64(31), b & _M31
    mid = ad * bu + au * bd
    return _fold(au * bu * np.uint64(2) + (mid >> np.uint64(30)) + ((mid & _M30) << np.uint64(31)) + ad * bd)


def _powers(base: int) -> np.ndarray:
    if base not in _tables:
        out, x = np.empty(CHUNK // 4, np.uint64), 1
        for i in range(len(out)):
            out[i], x = x, x * base % PRIME
        _tables[base] = out
    return _tables[base]


def combine(left: tuple[int, int], right: tuple[int, int], base: int) -> tuple[int, int]:
    """(hash, letters) of two neighbours joined; the left one is whole letters."""
    return (left[0] * pow(base, right[1], PRIME) + right[0]) % PRIME, left[1] + right[1]


def chunk_hashes(parts: list[np.ndarray], base: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, letters) of byte chunks, each zero-filled to whole letters."""
    sizes = np.array([len(p) for p in parts], np.int64)
    letters = (sizes + 3) // 4
    ends = np.cumsum(letters)
    buffer = np.zeros(int(ends[-1]) * 4, np.uint8)
    for p, end, n in zip(parts, ends, letters):
        at = int(end - n) * 4
        buffer[at:at + len(p)] = p
    x = buffer.view("<u4").astype(np.uint64)
    full = letters > 0
    if not full.any():
        return np.zeros(len(parts), np.uint64), letters
    back = np.repeat(ends, letters) - 1 - np.arange(len(x))
    terms = multiply(x, _powers(base)[back])
    at = (ends - letters)[full]
    high = _fold(np.add.reduceat(terms >> np.uint64(31), at))
    low = np.add.reduceat(terms & _M31, at)
    out = np.zeros(len(parts), np.uint64)
    out[full] = _fold(multiply(high, np.full(len(high), 1 << 31, np.uint64)) + _fold(low))
    return out, letters


def fingerprints(column: pa.Array, bases: tuple[int, ...] = BASES, limit: int = PRIME) -> list[tuple[int, ...]]:
    """The fingerprints of every text (``limit`` below PRIME weakens them, for tests)."""
    data, offsets = raw_texts(column)
    state = [[(0, 0)] * len(bases) for _ in range(len(offsets) - 1)]
    rows: list[int] = []
    parts: list[np.ndarray] = []

    def flush() -> None:
        for k, base in enumerate(bases if parts else ()):
            for row, h, n in zip(rows, *[x.tolist() for x in chunk_hashes(parts, base)]):
                state[row][k] = combine(state[row][k], (h, n), base) if state[row][k][1] else (h, n)
        rows.clear()
        parts.clear()

    held = 0
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for at in range(a, b, CHUNK):
            rows.append(row)
            parts.append(data[at:min(b, at + CHUNK)])
            held += len(parts[-1])
            if held >= BLOCK:
                flush()
                held = 0
    flush()
    return [tuple(h % limit for h, _ in s) for s in state]


def fingerprint_table(docs: DataFrame, limit: int = PRIME) -> DataFrame:
    """doc_id, fp1, fp2, n_bytes, text_sha256 and text_hash of every row."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                text = batch.column("text").slice(at, 1024)
                data, offsets = raw_texts(text)
                fps = fingerprints(text, limit=limit)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(at, 1024),
                    *[pa.array([f[k] for f in fps], pa.int64()) for k in range(2)],
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])]),
                    batch.column("text_hash").slice(at, 1024)],
                    names=["doc_id", "fp1", "fp2", "n_bytes", "text_sha256", "text_hash"])

    hashed = shared.doc_text(docs).withColumn("text_hash", shared.text_hash(F.col("text")))
    return hashed.mapInArrow(run, "doc_id long, fp1 long, fp2 long, n_bytes long, text_sha256 string, text_hash long")


def unequal_groups(docs: DataFrame, keys: DataFrame, limit: int = PRIME, by_sha: bool = False) -> DataFrame:
    """Keys of groups in which some chunk differs between rows."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(shared.bitmap(keys, "fp1"))
    key = [*KEY, "variant"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                text = batch.column("text").slice(at, 256)
                data, offsets = raw_texts(text)
                rows = []
                found = fingerprints(text, limit=limit)
                twice = shared.in_bitmap(bits.value, np.array([f[0] for f in found], np.int64))
                for (a, b), (f1, f2), hit in zip(zip(offsets[:-1].tolist(), offsets[1:].tolist()), found, twice):
                    if hit:
                        variant = hashlib.sha256(data[a:b]).hexdigest() if by_sha else ""
                        rows += [(f1, f2, b - a, variant, i, data[c:min(b, c + CHUNK)].tobytes())
                                 for i, c in enumerate(range(a, b, CHUNK))]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows), (*[pa.int64()] * 3, pa.string(), pa.int32(),
                                                                     pa.binary()))],
                        names=[*key, "chunk_no", "chunk"])

    chunks = shared.doc_text(docs).mapInArrow(
        run, "fp1 long, fp2 long, n_bytes long, variant string, chunk_no int, chunk binary")
    return (chunks.groupBy(*key, "chunk_no").agg((F.min("chunk") != F.max("chunk")).alias("differs"))
            .filter("differs").select(*key).distinct())


def deduplicate(docs: DataFrame, limit: int = PRIME) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, text_hash of every row."""
    prints = shared.keep(fingerprint_table(docs, limit), "fingerprints")
    rows = prints.withColumn("row", F.monotonically_increasing_id()).withColumn("variant", F.lit(""))
    key = [*KEY, "variant"]

    def repeated(of: DataFrame) -> DataFrame:
        return of.groupBy(*key).agg(F.count(F.lit(1)).alias("group_size"),
                                    F.max(F.struct("doc_id", "row")).alias("last")).filter("group_size > 1")

    bad = shared.keep(unequal_groups(docs, repeated(rows), limit), "unequal")
    if not bad.isEmpty():
        rows = (rows.drop("variant").join(bad.select(*KEY, F.lit(True).alias("bad")), KEY, "left")
                .withColumn("variant", F.when(F.col("bad"), F.col("text_sha256")).otherwise("")).drop("bad"))
        again = repeated(rows).filter("variant != ''")
        split = unequal_groups(docs, again, limit, by_sha=True).join(again.select(*key), key, "left_semi")
        if not split.isEmpty():
            raise RuntimeError("different texts share fingerprints and SHA-256")
    joined = shared.salted_join(rows, repeated(rows), key, F.col("row"))  # a group may hold a third of all rows
    alone = F.col("group_size").isNull()
    return joined.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"),
                         F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                         (alone | (F.col("last.row") == F.col("row"))).alias("kept"), "text_sha256", "text_hash")


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
