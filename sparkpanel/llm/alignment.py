"""Alignment of two tokenizers over the same texts (operator 13).

Side A encodes space + text with a byte-level BPE of the ``tokenizers``
library, side B the text with a ``sentencepiece`` model that adds the space.
Both sides' tokens become byte ranges of space + text.  Per batch, and keyed by
document, ``pandas.merge_asof`` finds for each token start the other side's
covering token, in both directions; the union of the two gives all overlaps.
Where the covering token starts at the same byte, both sides have an end: such
offsets cut the tokens into groups, and every overlap lies in one group.
The links of a group are all its A-B token pairs.

Neither side joins over a single space between ASCII letters or digits (the
piece vocabulary is checked for that), and both have an end there.  So the
documents of a batch are cut at these spaces, each distinct stretch is encoded
and aligned once, as a document of its own, and a document's result is put together from its stretches.

``groups`` returns the groups themselves.  ``summary`` counts, for each pair
of ids, the documents that hold it linked, and gives each document the
sum of its links' counts and the number of links whose count is the highest
of their A id.  The first pass writes each document's distinct pairs; counts
are summed within batches before they are shuffled.  Counts of the ``HEAVY``
most frequent pairs are looked up in a broadcast array of that size; all other
pairs meet their counts in a join, so no vocabulary is too large.

Texts null, empty, or whose joined token bytes on either side differ from
space + text (the piece model rewrites some signs) have no tokens: zeros and
an empty digest.  A very long text is a batch of its own, and its words are held once.
Repeated rows count as documents of their own.  Ties (several pairs
with the highest count) all count as best.  Null doc_ids are kept.  An empty
table gives no rows.  Only doc_id and text are read, so extra columns can't clash.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .arrays import give_back, raw_texts
from .selection import kth_largest

BATCH_BYTES = 1 << 21
PART = 1 << 20
HEAVY = 1 << 19
JOINED = 1024  # stretches that are encoded as one text
_PLAIN = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
#: The pre-tokenizer of byte-level BPE files, and its pattern.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OTHER = re.compile("[^\\x20-\\x7e\\t\\n\\r\u00c0-\u017f]")  # signs on whose kind two libraries might differ
_CUT = re.compile("(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")

GROUPS = "doc_id long, group long, start long, end long, a array<int>, b array<int>"
DOCS = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "pairs binary, times binary")


def _byte_of_letter() -> dict[str, int]:
    """Byte-level BPE's letters: printable Latin-1 stands for itself, the other bytes follow from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """One tokenizer: the ids of texts and the bytes of each id."""

    def __init__(self, table: list[bytes]):
        self.table = table
        self.lengths = np.array([len(x) for x in table], np.int64)
        variants = [[f"{i}{mark}".encode() for i in range(len(table))] for mark in (",", "|" if self.first else ";")]
        self.digits = variants[0] + variants[1]  # id as text with the sign after it

    first = True

    def ids(self, parts: list[str]) -> list[list[int]]:
        raise NotImplementedError


class ByteSide(Side):
    """A byte-level BPE file.  Texts of common Latin signs are encoded from the file's vocabulary by the faster
    ``tiktoken`` where ids are merge ranks (checked); all others by ``tokenizers``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings are plain text
        letters = _byte_of_letter()
        vocabulary = self.library.get_vocab(True)
        table = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            table[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        super().__init__(table)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.quick = None
        known = spec["model"]["vocab"]
        merges = ["".join(m) if not isinstance(m, str) else m.replace(" ", "", 1) for m in spec["model"]["merges"]]
        if (spec["normalizer"] is None and spec["pre_tokenizer"] == BYTE_LEVEL and len(known) >= 256 + len(merges)
                and all(len(t) == 1 for t, i in known.items() if i < 256)
                and all(known.get(m) == 256 + i for i, m in enumerate(merges))):
            import tiktoken
            ranks = {table[i]: i for i in range(256 + len(merges))}
            self.quick = tiktoken.Encoding("ranks", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, parts: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = [None] * len(parts)
        rest = []
        for i, x in enumerate(parts):
            if self.quick is None or _OTHER.search(x):
                rest.append(i)
            else:
                out[i] = self.quick.encode_ordinary(" " + x)
        for i, e in zip(rest, self.library.encode_batch_fast([" " + parts[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out


class PieceSide(Side):
    first = False

    def __init__(self, path: str):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{path}: a piece reaches over a space, so long texts can't be cut there")
        super().__init__([bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode()
                          for i, p in enumerate(pieces)])

    def ids(self, parts: list[str]) -> list[list[int]]:
        return self.library.encode(parts, num_threads=1)


_sides: dict[tuple[str, str], tuple[Side, Side]] = {}


def sides(path_a: str, path_b: str) -> tuple[Side, Side]:
    """This worker's two tokenizers."""
    if (path_a, path_b) not in _sides:
        _sides[path_a, path_b] = ByteSide(path_a), PieceSide(path_b)
    return _sides[path_a, path_b]


def parts_of(text: str, part: int = PART) -> list[str]:
    """The text cut at some single spaces (which go), so that each part is encoded with a space before it."""
    out, at = [], 0
    while len(text) - at > part and (cut := _CUT.search(text, at + part)):
        out.append(text[at:cut.start()])
        at = cut.end()
    return [*out, text[at:]]


def spread(first: np.ndarray, size: np.ndarray, use: np.ndarray) -> np.ndarray:
    """The places first[u] .. first[u] + size[u] of each u in ``use``, one after another."""
    n = size[use]
    return np.repeat(first[use] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def distinct_pairs(owner: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, pair, summed times) by owner and pair."""
    key = (owner << 40) | pair
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first] >> 40, key[first] & ((1 << 40) - 1), np.add.reduceat(times, first) if len(first) else times


def encoded(texts: list[str], side: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, how many of them each text has, whether they cover it) of some texts.

    Texts that begin and end with an ASCII letter or digit are joined by spaces, ``JOINED`` at a time, and
    parted again at their bytes; where that fails (the piece model rewrote a sign), each is encoded alone.
    """
    ids, counts, covered = [], np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    todo = [texts[i:i + JOINED] for i in range(0, len(texts), JOINED)]
    joined = [" ".join(x) for x in todo]
    for n, (group, text, found) in enumerate(zip(todo, joined, side.ids(joined))):
        first = n * JOINED
        own = np.array(found, np.int64)
        size = np.array([len(x) if x.isascii() else len(x.encode()) for x in group], np.int64) + 1
        ends = np.cumsum(side.lengths[own])
        at = np.searchsorted(ends, np.cumsum(size))
        if len(own) and at[-1] == len(ends) - 1 and (ends[at] == np.cumsum(size)).all() \
                and b"".join(map(side.table.__getitem__, found)) == b" " + text.encode():
            ids.append(own)
            counts[first:first + len(group)] = np.diff(np.concatenate([[-1], at]))
            covered[first:first + len(group)] = True
            continue
        own, size, good = alone(group, side)
        ids.append(own)
        counts[first:first + len(group)], covered[first:first + len(group)] = size, good
    return np.concatenate([np.zeros(0, np.int64), *ids]), counts, covered


def alone(texts: list[str], side: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``encoded``, each text by itself."""
    found = side.ids(texts) if texts else []
    covered = np.array([b"".join(map(side.table.__getitem__, x)) == b" " + t.encode() for t, x in zip(texts, found)], bool)
    found = [x if good else [] for x, good in zip(found, covered)]
    return (np.fromiter(chain.from_iterable(found), np.int64), np.array([len(x) for x in found], np.int64), covered)


class Stretches:
    """Aligned tokens of distinct stretches of texts, the joinable ones first (``place`` says where each went);
    ``ok`` marks those that both sides cover."""

    def __init__(self, texts: list[str], a: Side, b: Side):
        self.n, self.a, self.b = len(texts), a, b
        plain = [t[0] in _PLAIN and t[-1] in _PLAIN and not _OTHER.search(t) for t in texts]
        inner, outer = [i for i, x in enumerate(plain) if x], [i for i, x in enumerate(plain) if not x]
        self.place = np.empty(self.n, np.int64)
        self.place[inner + outer] = np.arange(self.n)
        halves = []
        for side in (a, b):
            x, y = encoded([texts[i] for i in inner], side), alone([texts[i] for i in outer], side)
            halves.append([np.concatenate([u, v]) for u, v in zip(x, y)])
        self.ok = halves[0][2] & halves[1][2]
        kept = []
        for ids, n, _ in halves:
            keep = np.repeat(self.ok, n)
            kept.append((ids[keep], np.where(self.ok, n, 0)))
        (self.ids_a, self.n_a), (self.ids_b, self.n_b) = kept
        self.of_a, self.of_b = np.repeat(np.arange(self.n), self.n_a), np.repeat(np.arange(self.n), self.n_b)
        self._align()

    def _align(self) -> None:
        len_a, len_b = self.a.lengths[self.ids_a], self.b.lengths[self.ids_b]
        # byte offsets over all stretches: both sides cover the same bytes of each
        self.start_a, self.start_b = np.cumsum(len_a) - len_a, np.cumsum(len_b) - len_b
        one = pd.DataFrame({"doc": self.of_a, "start": self.start_a, "token_a": np.arange(len(len_a)), "from_a": self.start_a})
        two = pd.DataFrame({"doc": self.of_b, "start": self.start_b, "token_b": np.arange(len(len_b)), "from_b": self.start_b})
        cover_a = pd.merge_asof(one[["doc", "start", "token_a"]], two, on="start", by="doc")
        cover_b = pd.merge_asof(two[["doc", "start", "token_b"]], one, on="start", by="doc")
        cut_a = cover_a["from_b"].to_numpy() == self.start_a  # an end of both sides lies before this token
        cut_b = cover_b["from_a"].to_numpy() == self.start_b
        self.group_a, self.group_b = np.cumsum(cut_a) - 1, np.cumsum(cut_b) - 1
        self.n_groups = int(self.group_a[-1]) + 1 if len(self.group_a) else 0
        self.overlaps = (np.concatenate([cover_a["token_a"].to_numpy(np.int64), cover_b["token_a"].to_numpy(np.int64)]),
                         np.concatenate([cover_a["token_b"].to_numpy(np.int64), cover_b["token_b"].to_numpy(np.int64)]))
        if not (self.group_a[self.overlaps[0]] == self.group_b[self.overlaps[1]]).all():
            raise AssertionError("an overlap reaches over a group's end")
        self.size_a = np.bincount(self.group_a, minlength=self.n_groups)
        self.size_b = np.bincount(self.group_b, minlength=self.n_groups)
        self.first_a, self.first_b = np.cumsum(self.size_a) - self.size_a, np.cumsum(self.size_b) - self.size_b
        self.group_of = self.of_a[self.first_a] if self.n_groups else np.zeros(0, np.int64)
        self.groups = np.bincount(self.group_of, minlength=self.n)
        self.first_group = np.cumsum(self.groups) - self.groups
        self.links = np.zeros(self.n, np.int64)
        np.add.at(self.links, self.group_of, self.size_a * self.size_b)

    def lines(self) -> list[bytes]:
        """Each stretch's groups as ``a1,a2|b1;a3|b2,b3``."""
        na, nb = len(self.ids_a), len(self.ids_b)
        line = np.empty(na + nb, np.int64)
        last_a, last_b = np.zeros(na, np.int64), np.zeros(nb, np.int64)
        last_a[self.first_a + self.size_a - 1] = 1
        last_b[self.first_b + self.size_b - 1] = 1
        line[np.arange(na) + self.first_b[self.group_a]] = self.ids_a + last_a * len(self.a.table)
        at_b = np.arange(nb) + self.first_a[self.group_b] + self.size_a[self.group_b]
        line[at_b] = len(self.a.digits) + self.ids_b + last_b * len(self.b.table)
        words = list(map((self.a.digits + self.b.digits).__getitem__, line.tolist()))
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return [b"".join(words[x:y])[:-1] for x, y in zip([0, *ends], ends)]

    def linked(self, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(stretch, pair, times): distinct pairs of some stretches, with their links; about ``most`` links at a time.

        A pair is A's id times the size of B's vocabulary plus B's id.  Ids that a large group repeats are
        counted before pairs are formed, so it costs its distinct pairs.
        """
        per_group = self.size_a * self.size_b
        small = per_group <= most
        total = np.concatenate([[0], np.cumsum(np.where(small, per_group, 0))])
        at = 0
        while at < self.n_groups:  # groups at .. to
            to = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
            to = min(to, self.n_groups)
            g = np.arange(at, to)[small[at:to]]
            if len(g):
                tokens = spread(self.first_a, self.size_a, g)
                right = spread(self.first_b, self.size_b, self.group_a[tokens])
                left = np.repeat(tokens, self.size_b[self.group_a[tokens]])
                yield distinct_pairs(self.of_a[left], self._pair(self.ids_a[left], self.ids_b[right]), np.ones(len(left), np.int64))
            for big in np.arange(at, to)[~small[at:to]]:
                a, n = np.unique(self.ids_a[self.first_a[big]:self.first_a[big] + self.size_a[big]], return_counts=True)
                b, m = np.unique(self.ids_b[self.first_b[big]:self.first_b[big] + self.size_b[big]], return_counts=True)
                for x, k in zip(a, n):
                    yield np.full(len(b), self.group_of[big]), self._pair(x, b), k * m
            at = to

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a * len(self.b.table) + b

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stretch, pair, times) of all distinct pairs, by stretch and pair."""
        found = list(self.linked())
        if len(found) == 1:
            return found[0]
        none = np.zeros(0, np.int64)
        return distinct_pairs(*[np.concatenate([f[i] for f in found] or [none]) for i in range(3)])


class Batch:
    """Some texts as sequences of distinct stretches: a word is encoded and aligned once a batch."""

    def __init__(self, texts: list[str], a: Side, b: Side):
        self.n, known = len(texts), {}
        uses = []
        for t in texts:
            own = [np.zeros(0, np.int64)]
            for part in parts_of(t) if t else ():
                own.append(np.array([known.setdefault(x, len(known)) for x in _CUT.split(part)], np.int64))
            uses.append(np.concatenate(own))
        self.stretches = Stretches(list(known), a, b)
        uses = [self.stretches.place[u] for u in uses]
        self.uses = [u if len(u) and self.stretches.ok[u].all() else np.zeros(0, np.int64) for u in uses]
        self.use = np.concatenate([np.zeros(0, np.int64), *self.uses])
        self.owner = np.repeat(np.arange(self.n), [len(u) for u in self.uses])

    def total(self, each: np.ndarray) -> np.ndarray:
        """Sum over each text of a number of its stretches."""
        ends = np.cumsum([0, *[len(u) for u in self.uses]])
        return np.diff(np.concatenate([[0], np.cumsum(each[self.use])])[ends])

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups as ``a1,a2|b1;a3|b2,b3``; '' without tokens."""
        line = self.stretches.lines()
        return [hashlib.sha256(b";".join(map(line.__getitem__, u.tolist()))).hexdigest() if len(u) else "" for u in self.uses]

    def pairs(self, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(text, pairs, times): the distinct pairs of each text in order, about ``most`` at a time."""
        of, pair, times = self.stretches.pairs()
        size = np.bincount(of, minlength=self.stretches.n)
        first = np.cumsum(size) - size
        counts = self.total(size)
        ends, at = np.cumsum([0, *[len(u) for u in self.uses]]), 0
        total = np.concatenate([[0], np.cumsum(counts)])
        while at < self.n:
            to = min(self.n, max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1))
            use, owner = self.use[ends[at]:ends[to]], self.owner[ends[at]:ends[to]]
            where = spread(first, size, use)
            text, p, n = distinct_pairs(np.repeat(owner, size[use]), pair[where], times[where])
            cut = np.searchsorted(text, np.arange(at, to + 1))
            for i in range(at, to):
                yield i, p[cut[i - at]:cut[i - at + 1]], n[cut[i - at]:cut[i - at + 1]]
            at = to


def batches_of(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[tuple[pa.Array, Batch]]:
    """(doc_ids, aligned texts) of about BATCH_BYTES of text at a time."""
    a, b = sides(path_a, path_b)
    for batch in batches:
        data, offsets = raw_texts(batch.column("text"))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BATCH_BYTES, side="right")) - 1)
            j = min(j, batch.num_rows)
            texts = [data[x:y].tobytes().decode() for x, y in zip(offsets[i:j], offsets[i + 1:j + 1])]
            yield batch.column("doc_id").slice(i, j - i), Batch(texts, a, b)
            i = j
        give_back()


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The groups of every document: place, byte range in space + text, A ids and B ids in order."""
    def run(batches):
        for keys, x in batches_of(batches, path_a, path_b):
            s = x.stretches
            g = spread(s.first_group, s.groups, x.use)
            doc = np.repeat(x.owner, s.groups[x.use])
            a, b = spread(s.first_a, s.size_a, g), spread(s.first_b, s.size_b, g)
            size_a, size_b = s.size_a[g], s.size_b[g]
            ends = np.cumsum(s.a.lengths[s.ids_a[a]])[np.cumsum(size_a) - 1] if len(g) else np.zeros(0, np.int64)
            begins = np.concatenate([[0], ends[:-1]]) if len(g) else ends
            first = np.searchsorted(doc, doc, side="left")  # each row's document's first group

            def lists(ids, size):
                return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(ids, pa.int32()))

            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(doc)), pa.array(np.arange(len(g)) - first), pa.array(begins - begins[first]),
                 pa.array(ends - begins[first]), lists(s.ids_a[a], size_a), lists(s.ids_b[b], size_b)],
                names=["doc_id", "group", "start", "end", "a", "b"])

    return shared.doc_text(docs).mapInArrow(run, GROUPS)


def measured(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Token, group and link numbers, the digest, and the distinct pairs with their links (little-endian
    longs and unsigned 32-bit numbers) of every document."""
    def run(batches):
        for keys, x in batches_of(batches, path_a, path_b):
            s = x.stretches
            pairs, times = [], []
            for _, p, n in x.pairs():
                pairs.append(p.astype("<i8").tobytes())
                times.append(n.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [keys, *[pa.array(x.total(n)) for n in (s.n_a, s.n_b, s.groups, s.links)], pa.array(x.digests(), pa.string()),
                 pa.array(pairs, pa.binary()), pa.array(times, pa.binary())],
                names=[c.split()[0] for c in DOCS.split(", ")])

    return shared.doc_text(docs).mapInArrow(run, DOCS)


def numbers(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, where each row's begin and end) of a binary column of fixed-width numbers."""
    data, offsets = raw_texts(column)
    return (np.frombuffer(data[offsets[0]:offsets[-1]].tobytes(), dtype).astype(np.int64),
            (offsets - offsets[0]) // np.dtype(dtype).itemsize)


def pair_counts(found: DataFrame) -> DataFrame:
    """pair and n: how many documents hold it linked; batches are counted before the shuffle."""
    def run(batches):
        for batch in batches:
            pair, n = np.unique(numbers(batch.column("pairs"), "<i8")[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], names=["pair", "n"])

    return found.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def summary(docs: DataFrame, path_a: str, path_b: str, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    spark = docs.sparkSession
    size_b = len(sides(path_a, path_b)[1].table)
    found = shared.keep(measured(docs, path_a, path_b), "aligned")
    counts = shared.keep(pair_counts(found), "pairs")
    best = counts.groupBy(F.expr(f"pair div {size_b}L").alias("a")).agg(F.max("n").alias("best"))  # one row for an id of A
    limit = kth_largest(counts, "n", heavy + 1) if counts.count() > heavy else 0.0
    top = counts.filter(F.col("n") > limit).toPandas().sort_values("pair")  # at most `heavy` rows
    tops = best.toPandas()
    highest = np.zeros(int(tops["a"].max()) + 1 if len(tops) else 1, np.int64)
    highest[tops["a"].to_numpy(np.int64)] = tops["best"].to_numpy(np.int64)
    held = spark.sparkContext.broadcast((top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64), highest))

    def run(batches):
        key, count, most = held.value
        for batch in batches:
            (pair, ends), (times, _) = numbers(batch.column("pairs"), "<i8"), numbers(batch.column("times"), "<u4")
            at = np.minimum(np.searchsorted(key, pair), max(0, len(key) - 1))
            known = key[at] == pair if len(key) else np.zeros(len(pair), bool)
            n = np.where(known, count[at] if len(count) else 0, 0)
            is_best = known & (n == most[pair // size_b])
            total, bests = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends]) for x in (n * times, is_best * times)]
            rest = np.flatnonzero(~known)
            cut = np.searchsorted(rest, ends).astype(np.int32)
            kept = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x[rest], pa.int64())) for x in (pair, times)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")],
                 pa.array(bests), pa.array(total), *kept],
                names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum",
                       "pair", "times"])

    rows = found.withColumn("row", F.monotonically_increasing_id())
    part = rows.mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
                                "groups_sha256 string, n_best long, count_sum long, pair array<long>, times array<long>")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if not limit:  # every pair has been looked up
        return part.select(*names)
    part = shared.keep(part, "looked_up")
    # the other pairs are rarer than each of the `heavy` ones; AQE splits what is still uneven
    rare = (part.select("row", F.explode(F.arrays_zip("pair", "times")).alias("x")).select("row", "x.pair", "x.times")
            .join(counts, "pair").join(F.broadcast(best), F.expr(f"pair div {size_b}L") == F.col("a"))
            .groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("more"),
                                F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("more_best")))
    out = part.join(rare, "row", "left")
    return (out.withColumn("count_sum", F.col("count_sum") + F.coalesce("more", F.lit(0)))
            .withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).select(*names))
