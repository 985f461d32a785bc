"""Near-duplicates by ProbMinHash (operator 5).

A document's weighted shingles are its distinct five-word sequences with their
counts (a text of one to four words is one shingle).  Every shingle sends a
Poisson process of arrivals, at a rate equal to its weight, to random
registers; a register keeps its first arrival, and a shingle stops once its
next arrival is later than the latest first arrival.  Two documents agree in a
register with their probability Jaccard similarity.  ``BANDS`` bands of
``ROWS`` registers put documents into buckets (a pair of similarity 0.8 shares
none with probability 7e-6).

Documents with the same words are one node.  Within a bucket no list of all pairs
is made: nodes are first compared with the bucket's best connected node (by
their registers, where agreement far below 0.8 ends it, then on the texts).
Buckets that still hold several classes are cut into blocks of ``BLOCK``
nodes; each two blocks meet in one task, which compares all nodes of different
classes on their shingles and returns only links that join classes.  So every
pair of every bucket is compared or in one class.  Links have probability
Jaccard of ``SIMILARITY`` or more; classes are connected components, found by
large-star and small-star steps.

Documents without words (null, empty, blank) are linked to none.  Rows with the same
words are always in one class, repeated rows among them; ties for the least doc_id go to the first row read.
Null doc_ids count as the greatest.  A very long text is a slice of its own.  An empty
table gives an empty result.  Only doc_id and text are read, so extra columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .arrays import Slice, mix, powers, slices, window_hash, _BASE, _INVERSE

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 5, 30
REGISTERS = ROWS * BANDS
FIRST_BANDS = 4  # the bands whose buckets are compared whole first
BLOCK = 512  # nodes of a bucket that one task compares with as many others
BLOCK_BYTES = 1 << 25  # of text in such a part, on average (one longer text is a part's least)
SLACK = 5  # standard deviations of the agreement that the register test leaves
SIGNATURE = "row long, doc_id long, text_hash long, k1 long, k2 long, n_words long, registers binary"


def _unit(bits: np.ndarray) -> np.ndarray:
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def shingles(s: Slice, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct shingles of each text of a slice, by text."""
    at, doc = s.windows(SHINGLE)
    h = window_hash(words, at, SHINGLE)
    for k in range(1, SHINGLE):
        short = np.flatnonzero(s.n_words == k)
        h = np.concatenate([h, window_hash(words, s.words_from[short], k)])
        doc = np.concatenate([doc, short])
    key = (doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    return doc[first], h[first], count


def prob_min_hash(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """Registers (n x m, 32-bit) of n documents from their shingles."""
    first = np.full(n * m, np.inf)
    owner = np.zeros(n * m, np.uint32)
    label = (mix(h, 99) >> np.uint64(32)).astype(np.uint32)
    sizes = np.bincount(doc, minlength=n)
    single = sizes[doc] == 1  # one shingle wins every register
    owner.reshape(n, m)[doc[single]] = label[single][:, None]
    live = np.flatnonzero(~single)
    t = np.zeros(len(h))
    step = 0
    while len(live):
        bits = mix(h[live], 1000 + 2 * step)
        t[live] -= np.log(_unit(bits)) / weight[live]
        slot = doc[live] * m + (mix(h[live], 1001 + 2 * step) % np.uint64(m)).astype(np.int64)
        now = t[live]
        early = now < first[slot]
        e, when = slot[early], now[early]
        np.minimum.at(first, e, when)
        won = first[e] == when
        owner[e[won]] = label[live][early][won]
        latest = first.reshape(n, m).max(axis=1) if step < 8 or step % 8 == 0 else latest
        live = live[now < latest[doc[live]]]
        step += 1
    return owner.reshape(n, m)


def sequence_hash(s: Slice, words: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of each text's whole sequence of words."""
    values = mix(words, seed)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(values * powers(_BASE, len(words) + 1)[:len(words)], out=total[1:])
    a, b = s.words_from[:-1], s.words_from[1:]
    return mix((total[b] - total[a]) * powers(_INVERSE, len(words) + 1)[a] + (b - a).astype(np.uint64), seed)


def signatures(docs: DataFrame) -> DataFrame:
    """One row a document: its keys and registers; ``row`` is unique in the written table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for s in slices(batch.column("text")):
                words = s.word_hash()
                doc, h, count = shingles(s, words)
                registers = prob_min_hash(doc, h, count.astype(float), s.n)
                blob = pa.Array.from_buffers(pa.binary(4 * REGISTERS), s.n, [None, pa.py_buffer(registers.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(s.n)), batch.column("doc_id").slice(s.first, s.n),
                     batch.column("text_hash").slice(s.first, s.n),
                     *[pa.array(sequence_hash(s, words, k).view(np.int64)) for k in (21, 22)],
                     pa.array(s.n_words.astype(np.int64)), blob.cast(pa.binary())],
                    names=[x.split()[0] for x in SIGNATURE.split(", ")])
                row += s.n

    return shared.doc_text(docs).withColumn("text_hash", shared.text_hash(F.col("text"))).mapInArrow(run, SIGNATURE)


def agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose registers do not rule out the similarity."""
    least = int(np.floor(REGISTERS * SIMILARITY - SLACK * np.sqrt(REGISTERS * SIMILARITY * (1 - SIMILARITY))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, REGISTERS)
                        for c in ("ra", "rb"))
                same = pa.array((x == y).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(same) for c in ("a", "b")], names=["a", "b"])

    both = (pairs.join(nodes.select(F.col("node").alias("a"), F.col("registers").alias("ra")), "a")
            .join(nodes.select(F.col("node").alias("b"), F.col("registers").alias("rb")), "b"))
    return both.select("a", "b", "ra", "rb").mapInArrow(run, "a long, b long")


def prob_jaccard(ha: np.ndarray, ca: np.ndarray, hb: np.ndarray, cb: np.ndarray) -> float:
    """Probability Jaccard similarity of two weighted sets (hashes distinct within each)."""
    common, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = ca[ia].astype(float), cb[ib].astype(float)
    only_a, only_b = ca.sum() - x.sum(), cb.sum() - y.sum()
    total = 0.0
    kinds, times = np.unique(np.stack([x, y]), axis=1, return_counts=True)
    for (xi, yi), n in zip(kinds.T, times):
        total += n / (np.maximum(kinds[0] / xi, kinds[1] / yi) @ times + only_a / xi + only_b / yi)
    return float(total)


def node_texts(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node and text of the wanted nodes, from one pass over the documents."""
    wanted = shared.keep(nodes.select("node", "k1", "k2").join(wanted.distinct(), "node", "left_semi"), "wanted")
    held = docs.sparkSession.sparkContext.broadcast(shared.bitmap(wanted, "k1"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for s in slices(batch.column("text")):
                words = s.word_hash()
                k1, k2 = (sequence_hash(s, words, k).view(np.int64) for k in (21, 22))
                rows = [i for i in np.flatnonzero(shared.in_bitmap(held.value, k1)).tolist() if k1[i] not in met]
                rows = list({k1[i]: i for i in reversed(rows)}.values())
                met.update(k1[i] for i in rows)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(k1[rows]), pa.array(k2[rows]),
                                                      batch.column("text").slice(s.first, s.n).take(pa.array(rows))],
                                                     names=["k1", "k2", "text"])

    texts = (shared.doc_text(docs).select("text").mapInArrow(find, "k1 long, k2 long, text string")
             .join(wanted, ["k1", "k2"]).groupBy("node").agg(F.first("text").alias("text")))
    return shared.keep(texts, "texts")


def shingle_sets(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, counts) of each text's shingles."""
    out = []
    for s in slices(texts):
        doc, h, count = shingles(s, s.word_hash())
        cut = np.searchsorted(doc, np.arange(s.n + 1))
        out += [(h[a:b], count[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    return out


def similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts' similarity reaches SIMILARITY."""
    texts = node_texts(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))), nodes, docs)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [shingle_sets(part.column(c)) for c in ("ta", "tb")]
                linked = pa.array([prob_jaccard(*x, *y) >= SIMILARITY for x, y in zip(*sets)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(c).filter(linked) for c in ("a", "b")], names=["a", "b"])

    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b"))
    return both.select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long")


def shared_mass(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """[i, j]: the share of text i's weight on shingles that text j has too.  A product of matrices
    over the shingles of two texts or more, a few thousand columns at a time."""
    n = len(sets)
    doc = np.repeat(np.arange(n), [len(h) for h, _ in sets])
    weight = np.concatenate([c / max(c.sum(), 1) for _, c in sets]).astype(np.float32)
    _, column, times = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True, return_counts=True)
    common = times[column] > 1
    doc, weight, column = doc[common], weight[common], (np.cumsum(times > 1) - 1)[column[common]]
    order = np.argsort(column, kind="stable")
    doc, weight, column = doc[order], weight[order], column[order]
    out = np.zeros((n, n), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, [a, a + 4096])
        mass, has = np.zeros((2, n, min(4096, int(column[-1]) + 1 - a)), np.float32)
        mass[doc[lo:hi], column[lo:hi] - a] = weight[lo:hi]
        has[doc[lo:hi], column[lo:hi] - a] = 1
        out += mass @ has.T
    return out


def block_links(group: list[int], sets: list[tuple[np.ndarray, np.ndarray]], apart: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) that join the texts' classes as far as similarity does; ``apart[i, j]`` says which
    pairs are this block's.

    With p and q the shares of two texts' weight on common shingles, 1 / (1/p + 1/q - 1) bounds their
    probability Jaccard from above and equals it where no shingle repeats; only pairs
    whose bound reaches SIMILARITY (less float slack) are compared exactly.
    """
    mass = shared_mass(sets)
    with np.errstate(divide="ignore"):
        bound = 1 / (1 / mass + 1 / mass.T - 1)
    maybe = np.triu(apart & (mass > 0) & (bound >= SIMILARITY - 1e-3), 1)
    parent = {g: g for g in group}

    def top(g: int) -> int:
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    links = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(maybe))):
        a, b = top(group[i]), top(group[j])
        if a != b and prob_jaccard(*sets[i], *sets[j]) >= SIMILARITY:
            parent[a] = b
            links.append((i, j))
    return links


def across(open_: DataFrame, nodes: DataFrame, docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between different classes of a bucket: (bucket, node, class, n) rows.

    A bucket is cut into parts of about ``block`` nodes and ``BLOCK_BYTES`` of text, whichever are fewer, and
    each two parts meet in one task, which holds at most about two parts of texts; it returns no more
    links than join its classes.
    """
    texts = node_texts(open_.select("node"), nodes, docs)
    sizes = texts.select("node", F.octet_length("text").alias("bytes"))
    weight = open_.join(sizes, "node").groupBy("bucket").agg(F.sum("bytes").alias("bytes"))
    open_ = open_.join(weight, "bucket")
    q = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    mine = F.pmod(F.xxhash64("node"), q).cast("int")
    met = (open_.withColumn("part", mine).withColumn("other", F.explode(F.sequence(F.lit(0), q - 1)))
           .select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "class"))

    def run(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        node, group, part = (table[c].to_pylist() for c in ("node", "class", "part"))
        of, kind = np.array(part), np.array(group)
        apart = kind[:, None] != kind[None, :]
        if i != j:
            apart &= of[:, None] != of[None, :]
        found = block_links(group, shingle_sets(table["text"].combine_chunks()), apart)
        return pa.table({"a": pa.array([node[x] for x, _ in found], pa.int64()),
                         "b": pa.array([node[y] for _, y in found], pa.int64())})

    return (met.join(texts, "node").groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")
            .select(*pair(F.col("a"), F.col("b"))).distinct())


def components(links: DataFrame) -> DataFrame:
    """node, class (its component's least node) of every node in links (a, b)."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    edges, before = shared.keep(edges, "edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.filter("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        edges = shared.keep(small, "edges")
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("class"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("class")).distinct()))


def pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def distinct_texts(rows: DataFrame) -> DataFrame:
    """One row for each word sequence: its node (least row), k1, k2, registers and number of copies."""
    return (rows.filter("n_words > 0").groupBy("k1", "k2")
            .agg(F.min("row").alias("node"), F.min_by("registers", "row").alias("registers"), F.count(F.lit(1)).alias("copies")))


def classes(docs: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """node, class of the linked nodes; None without links.

    First each node of a bucket is compared with the bucket's best connected node.  Then, for some
    bands and for all, the buckets that still hold several classes are compared whole.
    """
    own = F.col("node")
    bands = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"), "registers").select(
        "node", "band", F.xxhash64("band", F.substr("registers", F.col("band") * (4 * ROWS) + 1, F.lit(4 * ROWS))).alias("bucket"))
    many = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = shared.keep(bands.join(many, "bucket"), "members")
    # the node with the most company in all its buckets is nearest to the middle of a group of copies
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    reps = (members.join(company, "node").groupBy("bucket")
            .agg(F.max(F.struct(F.col("company"), (-own).alias("least"))).alias("r"))
            .select("bucket", (-F.col("r.least")).alias("rep")))
    pairs = members.join(reps, "bucket").filter("node != rep").select(*pair(own, F.col("rep"))).distinct()
    links = shared.keep(similar(shared.keep(agreeing(pairs, nodes), "close"), nodes, docs), "links")
    found = None if links.isEmpty() else shared.keep(components(links), "classes")
    for upto in (FIRST_BANDS, BANDS):
        labelled = members.filter(F.col("band") < upto).select("bucket", "node", "n")
        labelled = (labelled.withColumn("class", own) if found is None else
                    labelled.join(found, "node", "left").withColumn("class", F.coalesce("class", own)))
        mixed = labelled.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo != hi")
        open_ = shared.keep(labelled.join(mixed.select("bucket"), "bucket", "left_semi"), "open")
        new = shared.keep(across(open_, nodes, docs), "links")
        if not new.isEmpty():
            links = shared.keep(links.unionByName(new), "links")
            found = shared.keep(components(links), "classes")
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the class's least doc_id), class_size, kept (one of each class), text_hash of every row."""
    rows = shared.keep(signatures(docs), "signatures")
    nodes = shared.keep(distinct_texts(rows), "nodes")
    found = classes(docs, nodes)
    slim = rows.select("row", "doc_id", "text_hash", "k1", "k2", "n_words")
    # rows with the same words are one class even if linked to nothing; documents without words stand alone
    named = nodes.select("node", "k1", "k2", "copies")
    named = (named.withColumn("class", F.lit(None).cast("long")) if found is None else named.join(found, "node", "left"))
    named = (named.filter("copies > 1 or class is not null")
             .select("k1", "k2", F.coalesce("class", "node").alias("class")))
    placed = shared.salted_join(slim, named, ["k1", "k2"], F.col("row"))
    placed = placed.withColumn("class", F.when(F.col("n_words") > 0, F.coalesce("class", "row")).otherwise(F.col("row")))
    placed = shared.keep(placed.select("row", "doc_id", "text_hash", "class"), "placed")
    groups = (placed.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least"),
                                          F.count(F.lit(1)).alias("class_size")).filter("class_size > 1"))
    joined = shared.salted_join(placed, groups, ["class"], F.col("row"))
    alone = F.col("class_size").isNull()
    return joined.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("class_id"),
                         F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
                         (alone | (F.col("least.row") == F.col("row"))).alias("kept"), "text_hash")
