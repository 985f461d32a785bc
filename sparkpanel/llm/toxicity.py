"""Toxicity by a counterfactually regularised classifier (operator 8).

Logistic regression on the hashed words of a text and the beginnings of its
longer words (lower case, each once), each scaled by its smoothed log ratio between toxic and other training
texts, so that a word seen on one side alone counts early.  Words that name groups of people are swapped for the other terms of
their group in the training texts that hold them; the squared change of the
score under each swap is added to the loss, so that the score depends little
on which group a text mentions.  A neutral word is one of the swaps, and every
group term starts with one such pair, so that the mention itself is held down.

The model is fitted on at most ``SAMPLE`` labelled rows (chosen by hash, the
documented bound) whose crc32(doc_id) mod 5 is not 0; rows with remainder 0
are held out.  Inputs of a score are the text's words alone.

Null, empty and blank texts have no words and get the score of the intercept.  A null
doc_id counts as held out.  Without labels of both kinds every score is the
smoothed share of toxic labels (0.5 / 1 without any).  Repeated rows are training rows of their own and get equal
scores; ties of the sample go by hash, then doc_id.  A very long text is a slice of its own.  An empty table
gives no rows.  Only doc_id, text and the label are read, so extra columns can't clash.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkpanel.operators.blocks import summed

from . import importance, shared
from .arrays import Slice, mix, per_text, slices

BUCKETS = 1 << 18
SAMPLE = 16_000
BEGINNINGS = (4, 6)  # bytes
LEAST_TEXTS = 3  # a word of fewer training texts has no weight
RIDGE = 0.3
SWAP_PENALTY = 5.0
STEPS = 60
BLOCK_WORDS = 1 << 19
FIT_TASKS = 3  # of one step of the fit; its rows are bounded

#: Terms that name groups of people, by kind of group; the first is neutral.
GROUPS = (
    ("people", "women", "men", "girls", "boys", "females", "males", "transgender", "nonbinary"),
    ("person", "woman", "man", "girl", "boy", "female", "male"),
    ("believers", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("religious", "muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("people", "gay", "lesbian", "straight", "bisexual", "queer", "homosexual", "heterosexual"),
    ("residents", "immigrants", "refugees", "foreigners", "citizens", "migrants"),
    ("people", "black", "white", "asian", "african", "latino", "hispanic", "arab", "european", "american"),
    ("adults", "elderly", "young", "old", "teenagers", "disabled", "deaf", "blind"),
)


def words(s: Slice, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of the distinct words of each text (runs of letters and digits, ASCII in
    lower case) and of the beginnings of its longer words.  Group terms have no beginnings, so that
    swapping the word swaps all that the score sees of it."""
    start, end, doc = importance.runs(s, {1})
    data = np.where((s.data >= 65) & (s.data <= 90), s.data + np.uint8(32), s.data)
    whole = (mix(s.span_hash(start, end, data), 11) % np.uint64(buckets)).astype(np.int64)
    pairs = [doc * buckets + whole]
    free = ~term_mask(buckets)[whole]
    for seed, first in enumerate(BEGINNINGS, 12):
        long = free & (end - start > first)
        h = mix(s.span_hash(start[long], start[long] + first, data), seed)
        pairs.append(doc[long] * buckets + (h % np.uint64(buckets)).astype(np.int64))
    pairs = np.unique(np.concatenate(pairs))
    return pairs % buckets, pairs // buckets


def bucket_of(terms: list[str], buckets: int = BUCKETS) -> np.ndarray:
    s = next(slices(pa.array(terms)))
    start, end, _ = importance.runs(s, {1})
    return (mix(s.span_hash(start, end), 11) % np.uint64(buckets)).astype(np.int64)


@functools.cache
def term_mask(buckets: int = BUCKETS) -> np.ndarray:
    """Which buckets hold a group term."""
    out = np.zeros(buckets, bool)
    out[np.concatenate([bucket_of(list(g), buckets) for g in GROUPS])] = True
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """label and distinct word buckets of the training rows."""
    chosen = importance.labelled_sample(labels.filter(~held_out(F.col("doc_id"))), "toxic", sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                bucket, doc = words(s)
                ends = np.concatenate([[0], np.cumsum(per_text(doc, s.n))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(s.first, s.n), batch.column("label").slice(s.first, s.n),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bucket, pa.int32()))],
                    names=["doc_id", "label", "words"])

    return (shared.doc_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
            .mapInArrow(run, "doc_id long, label int, words array<int>"))


def swaps(together: np.ndarray, at: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minus word, plus word, weight): each distinct swap of a group term and the number of texts it
    changes.  ``together`` counts the texts that hold two terms (or one, on its diagonal), by their place in ``at``."""
    found: dict[tuple[int, int], float] = {}
    for group in GROUPS:
        own = bucket_of(list(group)).tolist()
        for i, a in enumerate(own):
            for j, b in enumerate(own):
                n = int(together[at[a], at[a]])
                if a == b or (j and not n) or (not i and not n):
                    continue
                found[a, b] = found.get((a, b), 0.0) + max(1, n - int(together[at[a], at[b]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    keys = np.array(list(found), np.int64)
    return keys[:, 0], keys[:, 1], np.array(list(found.values()), float)


class Texts:
    """Some training texts: their words one after another, where each text ends, and its label."""

    def __init__(self, word: np.ndarray, sizes: np.ndarray, y: np.ndarray):
        self.word, self.sizes, self.y, self.n = word, sizes, y, len(y)
        self.text = np.repeat(np.arange(self.n, dtype=np.int32), sizes)

    def by_text(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.text, weights=w[self.word], minlength=self.n)

    def by_word(self, value: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.word, weights=value[self.text], minlength=n)

    def only(self, keep: np.ndarray, column: np.ndarray) -> Texts:
        """The words that are kept, by their place among them."""
        used = keep[self.word]
        return Texts(column[self.word[used]], np.bincount(self.text[used], minlength=self.n), self.y)


def text_blocks(rows: DataFrame) -> RDD:
    """The training rows as persisted blocks of about ``BLOCK_WORDS`` words in a few partitions; their order
    follows from the rows alone."""
    ordered = rows.repartition(F.pmod(F.xxhash64("doc_id", "label"), F.lit(64))).sortWithinPartitions("doc_id", "label")
    kept = shared.keep(ordered, "training")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("words").value_lengths().to_numpy(zero_copy_only=False).astype("<i4")
            i, ends = 0, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            while i < batch.num_rows:
                j = min(batch.num_rows, max(i + 1, int(np.searchsorted(ends, ends[i] + BLOCK_WORDS, side="right")) - 1))
                part = batch.slice(i, j - i)
                word = part.column("words").flatten().to_numpy(zero_copy_only=False).astype("<i4")
                y = part.column("label").to_numpy(zero_copy_only=False).astype("<f8")
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (word, sizes[i:j], y)],
                                                 names=["word", "sizes", "y"])
                i = j

    blocks = kept.select("label", "words").mapInArrow(run, "word binary, sizes binary, y binary")
    rdd = blocks.rdd.map(lambda r: Texts(np.frombuffer(r["word"], "<i4"), np.frombuffer(r["sizes"], "<i4"), np.frombuffer(r["y"], "<f8")))
    return rdd.coalesce(max(1, min(FIT_TASKS, rdd.getNumPartitions()))).persist(StorageLevel.MEMORY_AND_DISK)


def minimise(loss, x: np.ndarray, steps: int = STEPS, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking; ``loss`` gives value and gradient."""
    f, g = loss(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, alphas = -g, []
        for s, y, r in reversed(pairs):
            a = r * (s @ d)
            alphas.append(a)
            d = d - a * y
        if pairs:
            s, y, r = pairs[-1]
            d = d / (r * (y @ y))
        else:
            d = d / max(1.0, np.linalg.norm(g))
        for (s, y, r), a in zip(pairs, reversed(alphas)):
            d = d + s * (a - r * (y @ d))
        step, slope = 1.0, g @ d
        if slope > -1e-9:
            break
        while True:
            new, (f2, g2) = x + step * d, loss(x + step * d)
            if f2 <= f + 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        s, y = new - x, g2 - g
        if s @ y > 1e-12:
            pairs = [*pairs[-memory + 1:], (s, y, 1 / (s @ y))]
        done = abs(f - f2) <= 1e-7 * max(1.0, abs(f))
        x, f, g = new, f2, g2
        if done:
            break
    return x


def fit(rows: DataFrame, swap_penalty: float = SWAP_PENALTY) -> np.ndarray:
    """Word weights by bucket, then the intercept, from at most the sample's rows.

    The rows stay in Spark: the driver holds the weights and, for each step, sums of their size."""
    spark = rows.sparkSession
    rdd = text_blocks(rows)
    terms = np.unique(np.concatenate([bucket_of(list(g)) for g in GROUPS]))
    at = {int(t): i for i, t in enumerate(terms)}

    def count(b: Texts) -> tuple[np.ndarray, ...]:
        used = np.isin(b.word, terms)
        has = np.zeros((b.n, len(terms)))
        has[b.text[used], np.searchsorted(terms, b.word[used])] = 1
        return (np.array([b.n - b.y.sum(), b.y.sum()]), b.by_word(1.0 - b.y, BUCKETS), b.by_word(b.y, BUCKETS), has.T @ has)

    try:
        found = summed(rdd, count)
        out = np.zeros(BUCKETS + 1)
        if found is None or not found[0].all():
            n = np.zeros(2) if found is None else found[0]
            share = (n[1] + 0.5) / (n.sum() + 1)
            out[-1] = np.log(share / (1 - share))
            return out
        (others, toxic), clean_words, toxic_words, together = found
        minus, plus, weight = swaps(together, at)
        keep = clean_words + toxic_words >= LEAST_TEXTS
        keep[minus] = keep[plus] = True
        smooth = [c + 0.5 for c in (toxic_words, clean_words)]
        scale = np.log(smooth[0] / smooth[0].sum()) - np.log(smooth[1] / smooth[1].sum())
        scale[minus] = scale[plus] = 1.0
        scale, column, n = scale[keep], np.cumsum(keep) - 1, int(keep.sum())
        minus, plus = column[minus], column[plus]
        places = spark.sparkContext.broadcast((keep, column.astype(np.int32)))
        whole, rdd = rdd, rdd.map(lambda b: b.only(*places.value)).persist(StorageLevel.MEMORY_AND_DISK)
        rdd.count()
        whole.unpersist()

        def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
            w = x[:-1] * scale
            held = spark.sparkContext.broadcast((w, x[-1]))

            def part(b: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                own, intercept = held.value
                z = b.by_text(own) + intercept
                err = 1 / (1 + np.exp(-z)) - b.y
                return np.array([np.sum(np.logaddexp(0, z) - b.y * z)]), b.by_word(err, n), np.array([err.sum()])

            value, grad, err = summed(rdd, part)
            held.unpersist()
            change = w[plus] - w[minus]
            total = value[0] + 0.5 * RIDGE * (x[:-1] @ x[:-1]) + 0.5 * swap_penalty * weight @ change**2
            pull = swap_penalty * weight * change
            grad = grad + np.bincount(plus, weights=pull, minlength=n) - np.bincount(minus, weights=pull, minlength=n)
            return float(total), np.concatenate([grad * scale + RIDGE * x[:-1], err])

        start = np.zeros(n + 1)
        start[-1] = np.log((toxic + 0.5) / (others + 0.5))
        best = minimise(loss, start)
    finally:
        rdd.unpersist()
    out[:-1][keep], out[-1] = best[:-1] * scale, best[-1]
    return out


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                bucket, doc = words(s)
                z = per_text(doc, s.n, held.value[bucket]) + held.value[-1]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s.first, s.n),
                                                  pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())],
                                                 names=["doc_id", "score"])

    return (shared.doc_text(docs).mapInArrow(run, "doc_id long, score double")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted")))
