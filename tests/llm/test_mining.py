import math
import random
from collections import Counter

import numpy as np
import pytest

from sparkpanel.llm import mining, queries

from .conftest import CLASHING


def brute(rows, is_anchor=lambda i: i % 50 == 0, relabel=True, positives=5, negatives=3):
    """Rows are (vec_id, vector, label); every result as a tuple."""
    good = []
    for vec_id, v, label in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if relabel and vec_id % 7 == 0:
            label = int(math.fmod(label + 1, 10))
        good.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = []
    for n, (vec_id, v, label) in enumerate(good):
        if not is_anchor(vec_id):
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), i, k) for m, (i, w, k) in enumerate(good) if m != n]
        scored.sort(key=lambda x: (-x[0], x[1]))
        for score, i, _ in [x for x in scored if x[2] == label][:positives]:
            hard = [x for x in scored if x[2] != label and 50 * score <= 100 * x[0] <= 95 * score][:negatives]
            out += [(vec_id, i, r, j, score, s) for r, (s, j, _) in enumerate(hard, 1)]
    return Counter(out)


def frame(spark, rows):
    names = [c for c in CLASHING if c != "label"]
    return spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows],
                                 "vec_id long, embedding array<float>, label int, " + ", ".join(f"`{c}` string" for c in names))


def result(df):
    return Counter((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"])
                   for r in df.collect())


def rows_of(n, dims, seed, labels=3, clusters=None):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(clusters or 1)]
    out = []
    for i in range(n):
        c = rng.choice(centres)
        v = [(x if clusters else 0) + rng.gauss(0, 0.2) for x in c]
        out.append((i, v, rng.randrange(labels)))
    return out


def test_hard_rows(spark):
    rows = rows_of(300, 6, 1) + [
        (400, None, 1), (450, [None, 1.0, 1.0, 1.0, 1.0, 1.0], 1), (500, [float("nan")] * 6, 1),
        (550, [float("inf")] + [0.0] * 5, 0), (600, [0.1] * 6, None), (None, [0.1] * 6, 1), (650, [], 1), (700, [0.5], 2),
        (750, [0.0] * 6, 0), (800, [0.3] * 9, 1), (850, [0.2] * 6, -4)]
    assert result(mining.hard_negatives(frame(spark, rows).repartition(3))) == brute(rows)


def test_ties_and_equal_vectors(spark):
    rows = [(i, [0.5, 0.25, -0.125, 0.75], i % 3) for i in range(120)] + [(i, [0.5, 0.2, -0.125, 0.7], i % 2) for i in range(120, 220)]
    assert result(mining.hard_negatives(frame(spark, rows).repartition(4))) == brute(rows)


def test_repeated_rows(spark):
    rows = rows_of(120, 4, 2)
    rows += [rows[50], rows[51], rows[100]]
    assert result(mining.hard_negatives(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("dims,codes,shard_rows,block_rows", [(1, 3, 64, 2), (2, 4, 50, 3), (5, 1, 70, 1000), (16, 8, 33, 4)])
def test_any_shards_blocks_and_codebooks(spark, dims, codes, shard_rows, block_rows):
    rows = rows_of(260, dims, dims, clusters=4)
    index = mining.build(mining.usable(frame(spark, rows)), codes, 100, shard_rows)
    from pyspark.sql import functions as F
    found = mining.mine(index, F.col("vec_id") % 9 == 0, block_rows=block_rows)
    assert result(found) == brute(rows, lambda i: i % 9 == 0, relabel=False)


def test_heap_visits_each_cell_once_in_order_and_bounds_hold(spark):
    rows = rows_of(400, 8, 3, clusters=6)
    index = mining.build(mining.usable(frame(spark, rows)), 5, 200, 10_000)
    shard = mining.Shard(index.rows.toPandas(), index.dims, index.dtype, index.books)
    for q in shard.x[:20]:
        cells = list(shard.cells(q))
        assert sorted(c for _, c in cells) == np.flatnonzero(shard.full.ravel()).tolist()
        assert [b for b, _ in cells] == sorted((b for b, _ in cells), reverse=True)
        for bound, c in cells:
            assert (shard.x[shard.begin[c]:shard.begin[c + 1]] @ q).max() <= bound


def test_certified_stop_saves_work(spark):
    """With tight clusters the heap ends before most rows are scored."""
    rows = rows_of(3000, 8, 4, clusters=40)
    index = mining.build(mining.usable(frame(spark, [(i, [8 * x for x in v], k) for i, v, k in rows])), 16, 3000, 10_000)
    shard = mining.Shard(index.rows.toPandas(), index.dims, index.dtype, index.books)
    seen, visit = [], shard.visit
    shard.visit = lambda q: visited(visit(q, 50), seen)
    for i in range(50):
        shard.positives(shard.row[i], shard.label[i], shard.x[i], 5)
    assert sum(seen) < 0.5 * 50 * 3000


def visited(parts, seen):
    for at, scores, bound in parts:
        seen.append(len(at))
        yield at, scores, bound


@pytest.mark.parametrize("score", [-1001, -1, 0, 1, 2, 19, 20, 21, 1000, 32767])
def test_window(score):
    low, high = mining.window(score)
    assert [s for s in range(-1100, 33000) if 50 * score <= 100 * s <= 95 * score] == list(range(low, high + 1))


def test_scores_are_exact_or_refused():
    assert mining.exact_dtype(64, 256) is np.float32 and mining.exact_dtype(64, 1 << 20) is np.float64
    assert mining.exact_dtype(4, 1 << 29) is np.int64
    with pytest.raises(ArithmeticError):
        mining.exact_dtype(4, 1 << 31)


def test_empty_table(spark):
    out = mining.hard_negatives(frame(spark, [(1, [0.5], 1)]).limit(0))
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert out.isEmpty()


def test_query_over_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"])
            for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    found = result(queries.QUERIES["op12_hard_negatives"](spark, "/root/testdata/sf0.01"))
    assert found == brute(rows) and found
