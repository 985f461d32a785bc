"""Secret scan with inferred formats (operator 6).

Base patterns find assigned values, access ids and long hex runs.  Their
values label credentials of two formats (``assign``, ``access``); from at most
``SAMPLE`` distinct values of at most ``LONGEST`` signs of each (chosen by hash, the
documented bound) a probabilistic automaton is inferred: a prefix tree over character kinds whose
states are merged while their end and transition frequencies agree under the
Hoeffding bound (ALERGIA).  Every run of credential characters in every text
is then scored by its likelihood under the best automaton against a first-order
model of all distinct ordinary runs; runs above ``LOG_ODDS`` that touch no base span are
added as ``format`` spans.  Base spans always stay.

Offsets are code points, end exclusive.  Null, empty and blank texts have no
spans and the SHA-256 of the empty string; null doc_ids are kept; a very long
text is scanned in one slice of its own, in time near-linear in its length.  Ties: spans of one start go by kind as
listed; of values and merges with equal numbers the lesser comes first.  Repeated
rows get equal rows, and their values count once.  An empty table gives no rows; without labelled values nothing is added.
Only doc_id and text are read, so extra columns can't clash.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .arrays import Slice, slices

KINDS = ("assign", "access", "hex", "format")
SAMPLE = 400  # distinct labelled values of each format
LONGEST = 128  # signs of a value in that sample (all values are found and scored)
SHORTEST = 12
ALPHA = 0.05
LOG_ODDS = 12.0
FLOOR = math.log(1e-4)

_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")

#: Character kinds: digits, a-f, g-z, capitals, and each sign by itself.
SIZES = (10, 6, 20, 26, 1, 1, 1, 1, 1, 1)
_KIND = np.full(256, -1, np.int8)
for _i, _chars in enumerate((b"0123456789", b"abcdef", b"ghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                             b"+", b"/", b"_", b".", b"=", b"-")):
    _KIND[list(_chars)] = _i
_RUN = _KIND >= 0
_HEX = (_KIND == 0) | (_KIND == 1)


def runs(s: Slice, member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of maximal runs of member bytes within one text, ``least`` long or longer."""
    inside = member[s.data]
    edge = np.zeros(len(inside) + 1, bool)
    edge[s.offsets] = True
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]])))
    end = np.flatnonzero(inside & (edge[1:] | np.concatenate([~inside[1:], [True]]))) + 1
    long = end - start >= least
    return start[long], end[long]


def base_spans(s: Slice) -> list[tuple[int, str, int, int, bytes]]:
    """(text, kind, start, end, labelled value) of the base matches, in bytes of the slice."""
    out = []
    buffer = s.data.tobytes()
    lowered = buffer.lower()
    for i, (a, b) in enumerate(zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist())):
        if any(lowered.find(w, a, b) >= 0 for w in _WORDS):
            text = buffer[a:b]
            out += [(i, "assign", a + m.start(), a + m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
        if buffer.find(b"AKIA", a, b) >= 0:
            text = buffer[a:b]
            out += [(i, "access", a + m.start(), a + m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    start, end = runs(s, _HEX, 16)
    doc = np.searchsorted(s.offsets, start, side="right") - 1
    return out + [(i, "hex", a, b, b"") for i, a, b in zip(doc.tolist(), start.tolist(), end.tolist())]


def untouched(base: list[tuple[int, str, int, int, bytes]], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which runs share no byte with a base span: of the spans that begin before a run's end, the furthest
    end must not lie beyond its start.  Sorted once, so a text full of both costs no pairs."""
    if not base or not len(start):
        return np.ones(len(start), bool)
    spans = np.array(sorted((a, b) for _, _, a, b, _ in base), np.int64)
    furthest = np.concatenate([[-1], np.maximum.accumulate(spans[:, 1])])
    return furthest[np.searchsorted(spans[:, 0], end, side="left")] <= start


class Automaton:
    """States as {kind: (next state, log probability)} and log probabilities of ending."""

    def __init__(self, moves: list[dict[int, tuple[int, float]]], stops: list[float]):
        self.moves, self.stops = moves, stops

    def log_likelihood(self, kinds: list[int]) -> float:
        """Log probability of the kinds, then of the characters given the kinds (uniform)."""
        state, total = 0, 0.0
        for k in kinds:
            state, p = self.moves[state].get(k, (state, FLOOR))
            total += p
        return total + self.stops[state] - sum(_LOG_SIZE[k] for k in kinds)


_LOG_SIZE = [math.log(n) for n in SIZES]


def infer(values: list[bytes], alpha: float = ALPHA) -> Automaton:
    """A deterministic probabilistic automaton of the values' formats by state merging."""
    ends, passes, edges = [0], [0], [{}]
    for v in sorted(values):  # the prefix tree
        at = 0
        passes[0] += 1
        for k in _KIND[np.frombuffer(v, np.uint8)].tolist():
            if k not in edges[at]:
                edges[at][k] = len(edges)
                edges.append({})
                ends.append(0)
                passes.append(0)
            at = edges[at][k]
            passes[at] += 1
        ends[at] += 1
    weight = [{k: passes[n] for k, n in e.items()} for e in edges]
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(x: int, n: int, y: int, m: int) -> bool:
        return bool(n and m) and abs(x / n - y / m) > bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if differ(ends[a], passes[a], ends[b], passes[b]):
                return False
            for k in edges[a].keys() | edges[b].keys():
                if differ(weight[a].get(k, 0), passes[a], weight[b].get(k, 0), passes[b]):
                    return False
                if k in edges[a] and k in edges[b] and edges[b][k] != b:
                    todo.append((edges[a][k], edges[b][k]))
        return True

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            ends[a] += ends[b]
            passes[a] += passes[b]
            for k, n in edges[b].items():
                weight[a][k] = weight[a].get(k, 0) + weight[b][k]
                if k in edges[a]:
                    todo.append((edges[a][k], n))
                else:
                    edges[a][k] = n

    final = [0]
    while True:
        known = set(final)
        frontier = [(a, k, n) for a in final for k, n in sorted(edges[a].items()) if n not in known]
        if not frontier:
            break
        a, k, n = max(frontier, key=lambda x: (passes[x[2]], -x[2]))
        for r in final:
            if compatible(r, n):
                edges[a][k] = r
                fold(r, n)
                break
        else:
            final.append(n)
    name = {n: i for i, n in enumerate(final)}
    moves, stops = [], []
    for n in final:
        total = passes[n] + 0.5 * (len(SIZES) + 1)
        moves.append({k: (name[to], math.log((weight[n][k] + 0.5) / total)) for k, to in edges[n].items()})
        stops.append(math.log((ends[n] + 0.5) / total))
    return Automaton(moves, stops)


def transitions(values: pa.Array) -> np.ndarray:
    """How often each kind follows each kind (last row: at the start), row by row."""
    n = len(SIZES)
    counts = np.zeros((n + 1) * n, np.int64)
    for s in slices(values):
        kinds = _KIND[s.data].astype(np.int64)
        before = np.concatenate([[n], kinds[:-1]]) if len(kinds) else kinds
        before[s.offsets[:-1][s.offsets[:-1] < s.offsets[1:]]] = n
        counts += np.bincount(before * n + kinds, minlength=len(counts))
    return counts


def ordinary(found: DataFrame) -> np.ndarray:
    """Log probabilities of each kind after each kind (row -1: at the start), with their characters' share,
    over all distinct values."""
    n = len(SIZES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n + 1) * n, np.int64)
        for batch in batches:
            total += transitions(batch.column("value"))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "n"])

    counts = np.full((n + 1) * n, 0.5)
    for r in found.select("value").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[r["at"]] += r["n"]
    counts = counts.reshape(n + 1, n)
    return np.log(counts / counts.sum(axis=1, keepdims=True)) - np.array(_LOG_SIZE)


class Formats:
    """The automata and the model of ordinary runs."""

    def __init__(self, automata: dict[str, Automaton], plain: np.ndarray):
        self.automata, self.plain = automata, plain
        self._seen: dict[bytes, float] = {}

    def log_odds(self, value: bytes) -> float:
        got = self._seen.get(value)
        if got is None:
            kinds = _KIND[np.frombuffer(value, np.uint8)].tolist()
            before = sum(self.plain[p][k] for p, k in zip([-1, *kinds], kinds))
            got = max((a.log_likelihood(kinds) for a in self.automata.values()), default=-math.inf) - before
            if len(self._seen) > 100_000:
                self._seen.clear()
            self._seen[value] = got
        return got


def learn(docs: DataFrame, sample: int = SAMPLE) -> Formats:
    """Infer the formats from the base matches of all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                base = base_spans(s)
                found = {(kind, v.decode()) for _, kind, _, _, v in base if v and len(v) <= LONGEST}
                start, end = runs(s, _RUN, SHORTEST)
                free = untouched(base, start, end)
                buffer = s.data.tobytes()
                found.update(("plain", buffer[a:b].decode()) for a, b in zip(start[free].tolist(), end[free].tolist()))
                kinds, values = zip(*sorted(found)) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())],
                                                 names=["kind", "value"])

    found = shared.keep(shared.doc_text(docs).select("text").mapInArrow(run, "kind string, value string").distinct(),
                        "credentials")
    values = {kind: [r["value"].encode() for r in found.filter(F.col("kind") == kind)
                     .orderBy(F.xxhash64("value"), "value").limit(sample).collect()]
              for kind in ("assign", "access")}
    return Formats({k: infer(v) for k, v in values.items() if v}, ordinary(found.filter(F.col("kind") == "plain")))


def scan(docs: DataFrame, formats: Formats, log_odds: float = LOG_ODDS) -> DataFrame:
    """doc_id and spans: array of (kind, start, end, log_odds), by start, kind and end, of every row.

    log_odds is that of the run for added spans and null for base spans.
    """
    held = docs.sparkSession.sparkContext.broadcast((formats.automata, formats.plain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Formats(*held.value)
        for batch in batches:
            for s in slices(batch.column("text")):
                base = base_spans(s)
                found = [(i, kind, a, b, None) for i, kind, a, b, _ in base]
                if model.automata:
                    start, end = runs(s, _RUN, SHORTEST)
                    free = untouched(base, start, end)
                    start, end = start[free], end[free]
                    doc = np.searchsorted(s.offsets, start, side="right") - 1
                    for i, a, b in zip(doc.tolist(), start.tolist(), end.tolist()):
                        odds = model.log_odds(s.data[a:b].tobytes())
                        if odds >= log_odds:
                            found.append((i, "format", a, b, odds))
                heads = np.concatenate([[0], np.cumsum((s.data & 0xC0) != 0x80)])
                out: list[list[dict]] = [[] for _ in range(s.n)]
                for i, kind, a, b, odds in sorted(found, key=lambda x: (x[0], x[2], KINDS.index(x[1]), x[3])):
                    first = heads[s.offsets[i]]
                    out[i].append({"kind": kind, "start": int(heads[a] - first), "end": int(heads[b] - first),
                                   "log_odds": odds})
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(s.first, s.n),
                     pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()),
                                                       ("end", pa.int64()), ("log_odds", pa.float64())])))],
                    names=["doc_id", "spans"])

    return shared.doc_text(docs).mapInArrow(
        run, "doc_id long, spans array<struct<kind string, start long, end long, log_odds double>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, base_sha256 and the spans as text."""
    def text(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"),
                                                                     x["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in KINDS],
                        F.sha2(text(F.filter("spans", lambda x: x["kind"] != "format")), 256).alias("base_sha256"),
                        text(F.col("spans")).alias("spans"))


EMPTY_SHA = hashlib.sha256(b"").hexdigest()
