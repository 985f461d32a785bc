"""Quality by importance resampling (operator 1).

Two generative models of hashed n-grams (single tokens and pairs of
neighbours; a token is a run of letters and digits or a run of other signs)
give each document the log ratio of its probability under the target text and
under the raw text.  The raw model counts every document.  The target model
counts the good documents in one half of a sample of ``SAMPLE`` labelled rows
(the documented bound), smoothed towards the raw model by ``PRIOR`` counts a bucket, so that
buckets rare in both weigh little.  Adding Gumbel noise to the log ratios and keeping the
k largest draws k documents without replacement with probability proportional
to their importance weight.  k is calibrated: the number of documents whose
weight passes the threshold that best separates the labels of the sample's other half.

Null and empty texts hold no n-gram: log weight null, never drawn.  Equal rows
tie and share their fate; documents tied with the k-th are all kept.  Without
good labels the target is the raw text, so all weights are 0 and all non-empty
documents stay.  Labels that are null don't count, null doc_ids are weighed like others.  A very long
text is a slice of its own.  An empty table gives no rows.  ``resample`` reads doc_id and
text alone, and ``drawn`` carries the columns inside one struct, so extra columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import selection, shared
from .arrays import SPACE, Slice, mix, per_text, slices

BUCKETS = 1 << 17
SAMPLE = 20_000
PRIOR = 16.0
SEED = 20_24

_CLASS = np.full(256, 2, np.uint8)  # 0 space, 1 letters, digits and bytes of non-ASCII characters, 2 other signs
_CLASS[SPACE] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def runs(s: Slice, kinds: set[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the maximal runs of one kind of sign, of the wanted kinds."""
    kind = _CLASS[s.data]
    if not len(kind):
        return (np.zeros(0, np.int64),) * 3
    edge = np.ones(len(kind) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[s.offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    wanted = np.isin(kind[starts], list(kinds))
    starts, ends = starts[wanted], ends[wanted]
    return starts, ends, np.searchsorted(s.offsets, starts, side="right") - 1


def ngrams(s: Slice, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every token and every pair of neighbouring tokens."""
    starts, ends, doc = runs(s, {1, 2})
    one = s.span_hash(starts, ends)
    near = np.flatnonzero(doc[1:] == doc[:-1])
    two = mix(one[near] * np.uint64(0xD6E8FEB86659FD93) + one[near + 1], 7)
    hashes = np.concatenate([one, two])
    return (hashes % np.uint64(buckets)).astype(np.int64), np.concatenate([doc, doc[near]])


def labelled_sample(labels: DataFrame, column: str, n: int = SAMPLE) -> DataFrame:
    """doc_id, label and half (0 or 1) of at most n labelled documents, chosen by a hash; of
    several labels of a document the largest counts."""
    own = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
           .dropna().groupBy("doc_id").agg(F.max("label").alias("label")))
    half = F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(2)).cast("int")
    return own.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(n).withColumn("half", half)


def fit(docs: DataFrame, sample: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log p_target - log p_raw of each bucket; the good documents of half 0 are the target."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, buckets), np.int64)
        for batch in batches:
            good = np.array(batch.column("label").fill_null(0).to_pylist(), np.int64) == 1
            for s in slices(batch.column("text")):
                bucket, doc = ngrams(s, buckets)
                counts[0] += np.bincount(bucket, minlength=buckets)
                counts[1] += np.bincount(bucket[good[s.first + doc]], minlength=buckets)
        at = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *[pa.array(c[at], pa.int64()) for c in counts]],
                                         names=["bucket", "raw", "target"])

    target = sample.filter("half = 0").select("doc_id", "label")
    marked = shared.doc_text(docs).join(F.broadcast(target), "doc_id", "left").select("text", "label")
    got = (marked.mapInArrow(run, "bucket int, raw long, target long").groupBy("bucket")
           .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas())
    counts = np.zeros((2, buckets))
    counts[0, got["bucket"]], counts[1, got["bucket"]] = got["raw"], got["target"]
    if not counts[1].any():
        return np.zeros(buckets)
    expected = counts[0] / counts[0].sum() * counts[1].sum()
    return np.log(counts[1] + PRIOR) - np.log(expected + PRIOR)


def weigh(docs: DataFrame, ratio: np.ndarray, back: list[str]) -> DataFrame:
    """The columns ``back`` of documents with __n_grams and __log_weight (null without n-grams)."""
    held = docs.sparkSession.sparkContext.broadcast(ratio)
    buckets = len(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                bucket, doc = ngrams(s, buckets)
                n, total = per_text(doc, s.n), per_text(doc, s.n, held.value[bucket])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(s.first, s.n) for c in back], pa.array(n, pa.int64()),
                     pa.array(total, pa.float64(), mask=n == 0)], names=[*back, "__n_grams", "__log_weight"])

    schema = T.StructType([*[docs.schema[c] for c in back], T.StructField("__n_grams", T.LongType()),
                           T.StructField("__log_weight", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def gumbel_key(seed: int) -> Column:
    """A row's log weight with the Gumbel noise of its doc_id, weight and seed."""
    u = shared.unit(F.col("doc_id").cast("long"), F.col("__log_weight"), F.col("__n_grams"), seed=seed)
    return F.col("__log_weight") - F.log(-F.log(u))


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The threshold that puts the fewest labelled rows on the wrong side; the middle of the gap it falls in."""
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    wrong = np.concatenate([[0], np.cumsum(g)]) + np.concatenate([np.cumsum((~g)[::-1])[::-1], [0]])
    wrong[1:-1][w[1:] == w[:-1]] = len(w) + 1  # equal weights stay together
    at = int(np.argmin(wrong))
    if at == 0:
        return -np.inf
    return float((w[at - 1] + w[at]) / 2) if at < len(w) else np.inf


def threshold(keyed: DataFrame, sample: DataFrame, k: int | None = None) -> float:
    """The k-th largest key of a written table (k calibrated if not given)."""
    if k is None:
        seen = (keyed.join(F.broadcast(sample.filter("half = 1")), "doc_id").filter("log_weight is not null")
                .select("log_weight", "label").toPandas())  # at most the sample's documents
        cut = best_cut(seen["log_weight"].to_numpy(), seen["label"].to_numpy() == 1)
        k = keyed.filter(F.col("log_weight") >= F.lit(cut)).count()
    return selection.kth_largest(keyed, "gumbel_key", k)


def _resample(docs: DataFrame, labels: DataFrame, k: int | None, seed: int, sample_rows: int) -> tuple[DataFrame, np.ndarray, float]:
    sample = shared.keep(labelled_sample(labels, "quality", sample_rows), "quality_sample")
    ratio = fit(docs, sample)
    scored = weigh(shared.doc_text(docs), ratio, ["doc_id"]).withColumn("gumbel_key", gumbel_key(seed))
    keyed = shared.keep(scored.select("doc_id", F.col("__n_grams").alias("n_grams"),
                                      F.col("__log_weight").alias("log_weight"), "gumbel_key"), "weights")
    return keyed, ratio, threshold(keyed, sample, k)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED,
             sample_rows: int = SAMPLE) -> DataFrame:
    """doc_id, n_grams, log_weight, gumbel_key, kept of every row; k documents are drawn (calibrated if not given)."""
    keyed, _, least = _resample(docs, labels, k, seed, sample_rows)
    return keyed.withColumn("kept", F.coalesce(F.col("gumbel_key") >= F.lit(least), F.lit(False)))


def drawn(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED,
          sample_rows: int = SAMPLE) -> DataFrame:
    """The documents that ``resample`` keeps, with the columns they came with (each row is weighed again: no join)."""
    _, ratio, least = _resample(docs, labels, k, seed, sample_rows)
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return weigh(packed, ratio, ["doc_id", "row"]).filter(gumbel_key(seed) >= F.lit(least)).select("row.*")
