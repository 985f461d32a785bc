"""Packing by first-fit decreasing with a tournament tree (operator 7).

Each document's ids (with its end id) are cut at multiples of the sequence
length; only the last piece of a document can be shorter.  Pieces are dealt to
randomised groups of about ``GROUP_PIECES`` (a hash of doc_id, place and row
number, so copies of one document spread out), and each group is packed on its
own: longest piece first, into the first sequence with room.  A tournament
tree over the free space of the sequences finds that sequence in log time.

Null, empty and blank texts are documents of the end id alone; null doc_ids are kept.  Repeated rows are
separate documents.  Pieces of equal length (ties) go in the order of their hash.  A very long text
becomes many pieces of several groups.  An empty table gives no pieces.  Only doc_id and text are
read, so extra columns can't clash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, tokens
from .token_output import encoded

GROUP_PIECES = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = PIECES + ", sequence_id long, offset long"


class Tournament:
    """Free space of up to ``n`` bins; each inner node holds the larger of its two."""

    def __init__(self, n: int, size: int):
        self.half = 1 << max(0, n - 1).bit_length()
        self.room = [size] * (2 * self.half)

    def take(self, need: int) -> tuple[int, int]:
        """(first bin with room, place in use before), and use ``need`` of it."""
        room, at = self.room, 1
        while at < self.half:
            at *= 2
            if room[at] < need:
                at += 1
        left = room[at]
        room[at] = left - need
        found = at - self.half
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
        return found, left


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; pieces of equal length keep their order."""
    tree = Tournament(len(lengths), size)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        bins[i], left = tree.take(n)
        offsets[i] = size - left
    return bins, offsets


def pieces(docs: DataFrame, vocabulary: str, end_id: int, size: int, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents (with their ids as little-endian bytes, if kept)."""
    def run(batches):
        dtype = tokens.encoder(vocabulary).dtype
        end = np.array([end_id], "<u4")
        for batch, first, found in encoded(batches, vocabulary):
            keys = batch.column("doc_id").slice(first, len(found))
            owner, start, length, crc, total, kept = [], [], [], [], [], []
            for i, x in enumerate(found):
                ids = np.concatenate([np.frombuffer(x, dtype).astype("<u4"), end])
                for a in range(0, len(ids), size):
                    part = ids[a:a + size]
                    owner.append(i)
                    start.append(a)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
                    total.append(len(ids))
                    if keep_ids:
                        kept.append(part.tobytes())
            cols = [keys.take(pa.array(owner, pa.int64())),
                    *[pa.array(c, pa.int64()) for c in (start, length, crc, total)]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                cols, names = [*cols, pa.array(kept, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return shared.doc_text(docs).mapInArrow(run, PIECES + ", ids binary" * keep_ids)


def pack(docs: DataFrame, vocabulary: str, end_id: int, size: int = 2048, group_pieces: int = GROUP_PIECES,
         keep_ids: bool = False) -> DataFrame:
    """Place every piece: its columns with sequence_id and offset."""
    cut = shared.keep(pieces(docs, vocabulary, end_id, size, keep_ids), "pieces")
    groups = max(1, -(-cut.count() // group_pieces))
    own = F.xxhash64("doc_id", "start", F.monotonically_increasing_id())  # row numbers of a written table are stable
    dealt = cut.withColumn("group", F.pmod(own, F.lit(groups)).cast("long")).withColumn("turn", own)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("turn", kind="stable")
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), size)
        return group.drop(columns=["group", "turn"]).assign(
            sequence_id=group["group"].to_numpy() * (1 << 32) + bins, offset=offsets)

    schema = PIECES + ", ids binary" * keep_ids + ", sequence_id long, offset long"
    return dealt.groupBy("group").applyInPandas(run, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, length and the ids of each packed sequence (from ``pack`` with kept ids)."""
    return (placed.groupBy("sequence_id")
            .agg(F.sum("length").alias("length"),
                 F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
            .select("sequence_id", "length",
                    F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids")))
