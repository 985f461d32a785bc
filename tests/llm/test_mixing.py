import random

from pyspark.sql import functions as F

from sparkpanel.llm import mixing, shared

from .brute import word_list
from .conftest import small


def water_fill(sizes, weights, cap=3):
    total, targets, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        share = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / share >= cap * sizes[i]}
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / share
            break
        for i in over:
            targets[i] = cap * sizes[i]
            left -= targets[i]
        open_ -= over
    return targets


def test_targets_and_takes(spark):
    rng = random.Random(8)
    texts, sources = [], []
    for name, n, top in (("a", 300, 40), ("b", 20, 30), ("Z", 200, 200), (None, 100, 60), ("é", 5, 10), ("empty", 3, 0)):
        for _ in range(n):
            texts.append(" ".join(["w"] * (rng.randrange(1, top) if top else 0)))
            sources.append(name)
    got = mixing.mix(small(spark, texts, sources)).collect()
    assert len(got) == len(texts)
    names = sorted({s for s in sources if s is not None}) + [None]
    sizes = {s: sum(len(word_list(t)) for t, o in zip(texts, sources) if o == s) for s in names}
    want = dict(zip(names, water_fill([sizes[s] for s in names], [1 + i % 3 for i in range(len(names))])))
    taken = dict.fromkeys(names, 0)
    for r in got:
        s = sources[r.doc_id]
        assert r.size == len(word_list(texts[r.doc_id])) and r.source_size == sizes[s]
        assert abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[s] += r.taken
    for s in names:
        assert abs(taken[s] - want[s]) <= max(6, 0.02 * want[s]), s
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(small(spark, texts, sources)).collect()))  # reruns agree


def test_rates_solve_the_dual(spark):
    rng = random.Random(1)
    texts = [" ".join(["w"] * rng.randrange(1, 100)) for _ in range(200)]
    sources = [rng.choice("abc") for _ in texts]
    for r in (mixing.mix(small(spark, texts, sources)).withColumn("source", F.element_at(F.array(*map(F.lit, sources)), (F.col("doc_id") + 1).cast("int")))
              .groupBy("source").agg(F.sum(F.col("rate") * F.col("size")).alias("expected"), F.first("target").alias("target"),
                                     F.max("rate").alias("most")).collect()):
        assert abs(r.expected - r.target) < 1e-5 * r.target and r.most <= 3


def test_edges(spark, hard, none):
    got = mixing.mix(hard).collect()
    assert len(got) == hard.count()
    for r in got:
        assert r.taken <= 3 * r.size and (r.size > 0 or r.copies == 1)
    assert mixing.mix(none).collect() == []
    repeated = mixing.repeat(hard)
    assert repeated.columns == hard.columns and repeated.count() == sum(r.copies for r in got)
    assert mixing.repeat(none).collect() == []
    blank = small(spark, ["", None, " "], ["a", None, "b"])
    assert all((r.size, r.target, r.taken) == (0, 0.0, 0) for r in mixing.mix(blank).collect())


def test_number_of_words(spark):
    texts = ["", None, " ", "a", " a", "a ", "\x0ba\x0c\tb\r\nc  d ", "a b", "é x"]
    rows = small(spark, texts).select("text", mixing.n_words(F.col("text")).alias("n")).collect()
    assert [r.n for r in rows] == [len(word_list(r.text)) for r in rows]


def test_places_follow_code_points(spark):
    names = [f"s{i}" for i in range(50)] + ["Z", "é", "\U0001F600", "￮"]
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "source string").repartition(5)
    got = [r.source for r in mixing.numbered(df).orderBy("place").collect()]
    assert got == [*sorted(names), None]
    assert shared.root(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
