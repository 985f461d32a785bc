import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sparkpanel.operators import boosting as B
from sparkpanel.operators import encoding as E
from sparkpanel.operators import models as MD


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = []
    for i in range(400):
        a, b, c = float(rng.integers(0, 12)), float(rng.normal()), float(rng.integers(0, 2))
        p = 1 / (1 + math.exp(-(0.5 * a - 3 + b * c)))
        out.append((i, a, b, c, int(rng.random() < p)))
    df = spark.createDataFrame(out, "id long, a double, b double, c double, y int").repartition(3)
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)


def plain_trees(x, y, w, edges, p):
    """The same boosting by exhaustive loops over one table."""
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    margin, out = np.zeros(len(y)), []

    def worth(g, h):
        return max(abs(g) - p.reg_alpha, 0.0) ** 2 / (h + p.reg_lambda)

    def value(g, h):
        return -p.learning_rate * math.copysign(max(abs(g) - p.reg_alpha, 0.0), g) / (h + p.reg_lambda)

    for _ in range(p.rounds):
        prob = 1 / (1 + np.exp(-margin))
        g, h = (prob - y) * w, prob * (1 - prob) * w
        level = [np.arange(len(y))]
        leaves = []
        for _ in range(p.depth):
            nxt = []
            if p.symmetric:
                best = max(((sum(worth(g[n][bins[f, n] <= b].sum(), h[n][bins[f, n] <= b].sum())
                                 + worth(g[n][bins[f, n] > b].sum(), h[n][bins[f, n] > b].sum())
                                 - worth(g[n].sum(), h[n].sum()) for n in level), -f, -b)
                            for f in range(len(edges)) for b in range(len(edges[f]))))
                choice = [best if best[0] > p.min_gain else None] * len(level)
            else:
                choice = []
                for n in level:
                    found = [(worth(g[m].sum(), h[m].sum()) + worth(g[o].sum(), h[o].sum()) - worth(g[n].sum(), h[n].sum()), -f, -b)
                             for f in range(len(edges)) for b in range(len(edges[f]))
                             for m, o in [(n[bins[f, n] <= b], n[bins[f, n] > b])]
                             if h[m].sum() >= p.min_child_weight and h[o].sum() >= p.min_child_weight]
                    best = max(found, default=None)
                    choice.append(best if best and best[0] > p.min_gain else None)
            for n, c in zip(level, choice):
                if c is None:
                    leaves.append(n)
                else:
                    nxt += [n[bins[-c[1], n] <= -c[2]], n[bins[-c[1], n] > -c[2]]]
            level = nxt
        step = np.zeros(len(y))
        for n in [*leaves, *level]:
            step[n] = value(g[n].sum(), h[n].sum()) if len(n) else 0.0
        margin = margin + step
        out.append(step)
    return margin


@pytest.mark.parametrize("p", [
    B.BoostParams(rounds=5, depth=3, learning_rate=0.3),
    B.BoostParams(rounds=3, depth=2, learning_rate=0.5, reg_lambda=7.0, reg_alpha=0.9),
    B.BoostParams(rounds=3, depth=3, learning_rate=0.3, symmetric=True, min_child_weight=0.0, reg_lambda=3.0)],
    ids=["second order", "penalties", "symmetric"])
def test_trees_equal_plain_boosting(rows, p):
    data = rows.orderBy("id").collect()
    x, y = np.array([r.features.toArray() for r in data]), np.array([float(r.y) for r in data])
    model = B.fit(rows, "features", "y", p)
    edges = B.bin_edges(rows, "features", p.max_bins)
    want = 1 / (1 + np.exp(-plain_trees(x, y, np.ones(len(y)), edges, p)))
    got = [r.probability[1] for r in model.transform(rows).orderBy("id").collect()]
    assert np.allclose(got, want, atol=1e-9)


def test_snapshots_change_nothing(rows, monkeypatch):
    p = B.BoostParams(rounds=7, depth=2, subsample=0.7, colsample=0.67)
    whole = B.fit_trees(rows, "features", "y", p)[0]
    monkeypatch.setattr(B, "SNAPSHOT", 2)
    cut = B.fit_trees(rows, "features", "y", p)[0]
    assert len(whole) == len(cut) == 7
    for a, b in zip(whole, cut):
        assert (a.feature == b.feature).all() and np.allclose(a.value, b.value)


@pytest.mark.parametrize("axis", [{"reg_lambda": 30.0}, {"reg_alpha": 3.0}, {"colsample": 0.34}, {"subsample": 0.5}, {"seed": 7, "subsample": 0.5}])
def test_every_axis_changes_the_fit(rows, axis):
    p = B.BoostParams(rounds=3, depth=2)
    plain, other = [B.fit(rows, "features", "y", q).transform(rows).orderBy("id").select("probability").collect()
                    for q in (p, B.replace(p, **axis))]
    assert plain != other


def test_same_seed_same_trees_on_any_partitions(rows):
    p = B.BoostParams(rounds=4, depth=3, subsample=0.8, colsample=0.7)
    a, b = [B.fit_trees(r, "features", "y", p, key=F.xxhash64("id"))[0] for r in (rows, rows.repartition(7))]
    assert all((x.feature == y.feature).all() and np.allclose(x.value, y.value) for x, y in zip(a, b))


def test_null_labels_empty_tables_and_one_value(spark, rows):
    some = rows.withColumn("y", F.when(F.col("id") % 3 > 0, F.col("y")))
    assert B.fit(some, "features", "y", B.BoostParams(rounds=2, depth=2)).getNumTrees == 2
    none = B.fit(rows.limit(0), "features", "y", B.BoostParams(rounds=2))
    assert none.getNumTrees == 1 and none.trees[0].numNodes == 1
    flat = VectorAssembler(inputCols=["one"], outputCol="features").transform(rows.select("y").withColumn("one", F.lit(1.0)))
    assert B.fit(flat, "features", "y", B.BoostParams(rounds=1, depth=2)).transform(flat).count() == 400


def test_bins_hold_every_value(spark):
    df = VectorAssembler(inputCols=["v"], outputCol="features").transform(spark.range(5000).selectExpr("cast(id as double) v"))
    edges = B.bin_edges(df, "features")
    assert len(edges[0]) == 255 and B.binned(np.array([[-1.0], [0.0], [4999.0], [np.nan]]), edges).tolist() == [[0, 0, 255, 255]]


def brute_ordered(data, seed, smoothing, prior):
    import hashlib
    at = {i: int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:13], 16) for i, _, _ in data}
    out = {}
    for i, c, _ in data:
        before = [y for j, d, y in data if d == c and at[j] < at[i] and y is not None]
        out[i] = (sum(before) + smoothing * prior) / (len(before) + smoothing)
    return out


@pytest.mark.parametrize("range_rows", [1, 13, 10**6])
def test_ordered_statistics(spark, range_rows):
    rng = np.random.default_rng(1)
    data = [(i, [None, "a", "a", "a", "b", "c d"][rng.integers(0, 6)], [None, 0, 1, 1][rng.integers(0, 4)]) for i in range(120)]
    df = spark.createDataFrame(data, "id long, c string, y int")
    known = [y for _, _, y in data if y is not None]
    prior = sum(known) / len(known)
    got = {r.id: r["c__ts"] for r in E.ordered_target_stats(df, ["c"], "y", "id", 42, 2.0, range_rows=range_rows).collect()}
    want = brute_ordered(data, 42, 2.0, prior)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_scoring_statistics_and_unseen_categories(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b'c", 1), (None, 1), (None, None)], "c string, y int")
    stage = E.statistics_stage(df, ["c"], "y", smoothing=1.0)
    got = {r.c: r["c__ts"] for r in stage.transform(spark.createDataFrame([("a",), ("b'c",), (None,), ("new",)], "c string")).collect()}
    assert got == {"a": pytest.approx((1 + 0.75) / 3), "b'c": pytest.approx(1.75 / 2), None: pytest.approx(1.75 / 2), "new": 0.75}


def test_cat_model_is_saved_and_loaded(spark, rows, tmpdir_path):
    train = rows.withColumn("k", F.concat(F.lit("k"), F.col("a").cast("int").cast("string"))).select("id", "b", "k", "y")
    fm = MD.fit(train, ["b"], ["k"], MD.ModelConfig("cat", cat_iterations=10, cat_depth=3))
    fm.model.write().overwrite().save(tmpdir_path + "/m")
    back = PipelineModel.load(tmpdir_path + "/m")
    a, b = [{r.id: r.score for r in MD.score_with(m, train).collect()} for m in (fm.model, back)]
    assert a == b and MD.evaluate(fm, train, 0.5).first().roc_auc > 0.7


def test_rows_do_not_see_their_own_target(rows):
    train = rows.withColumn("k", F.col("id").cast("string")).select("id", "b", "k", "y")  # an id as category tells nothing
    data, stages, num, cat = MD.cat_stages(train, ["b"], ["k"], "y", "id", 42)
    prior = train.agg(F.avg("y")).first()[0]
    assert {round(r[0], 9) for r in data.select("k__imp__ts").collect()} == {round(prior, 9)}


def test_cat_search_prepares_each_fold_alone(rows, monkeypatch):
    train = rows.withColumn("k", F.pmod("id", F.lit(4)).cast("string")).select("id", "b", "k", "y")
    monkeypatch.setattr(MD, "param_space", lambda name: {"iterations": [2, 3], "depth": [2]})
    asked, real = [], MD.cat_stages
    monkeypatch.setattr(MD, "cat_stages", lambda df, *a: asked.append(df.count()) or real(df, *a))
    fm = MD.fit(train, ["b"], ["k"], MD.ModelConfig("cat"), tuning=MD.TuningConfig(n_splits=2, parallelism=1))
    assert sorted(asked)[2:] == [400, 400] and sum(sorted(asked)[:2]) == 400
    assert fm.best_params["depth"] == 2 and MD.predict(fm, train).count() == 400


@pytest.mark.parametrize("p", [B.BoostParams(rounds=7, depth=3, subsample=0.7, colsample=0.67),
                               B.BoostParams(rounds=5, depth=3, symmetric=True, min_child_weight=0.0)], ids=["second order", "symmetric"])
def test_rows_of_one_partition_take_no_job_a_level(rows, monkeypatch, p):
    passes, real = [], B.summed
    monkeypatch.setattr(B, "summed", lambda *a, **k: passes.append(1) or real(*a, **k))
    one = B.fit_trees(rows, "features", "y", p, key=F.xxhash64("id"))[0]
    assert len(one) == p.rounds and not passes
    monkeypatch.setattr(B, "TASK_ROWS", 100)
    monkeypatch.setattr(B, "SNAPSHOT", 2)
    many = B.fit_trees(rows, "features", "y", p, key=F.xxhash64("id"))[0]
    assert len(many) == p.rounds and len(passes) >= p.rounds
    for a, b in zip(one, many):
        assert (a.feature == b.feature).all() and (a.bin == b.bin).all() and np.allclose(a.value, b.value)


@pytest.mark.parametrize("symmetric", [False, True])
def test_many_rows_take_one_job_and_are_made_once(spark, monkeypatch, symmetric):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    df = spark.range(200_000).selectExpr("id", "cast(id % 91 as double) a", "cast(id % 7 < 3 as int) y").mapInArrow(
        count, "id long, a double, y int")
    data = VectorAssembler(inputCols=["a"], outputCol="features").transform(df)
    passes, real = [], B.summed
    monkeypatch.setattr(B, "summed", lambda *a, **k: passes.append(1) or real(*a, **k))
    trees, _ = B.fit_trees(data, "features", "y", B.BoostParams(rounds=2, depth=2, symmetric=symmetric), key=F.col("id"))
    assert len(trees) == 2 and not passes and made.value == 200_000


@pytest.mark.parametrize("p", [B.BoostParams(rounds=6, depth=3, subsample=0.7), B.BoostParams(rounds=6, depth=3, min_child_weight=9.0),
                               B.BoostParams(rounds=6, depth=3, symmetric=True, min_child_weight=0.0)], ids=["sampled", "leaves", "symmetric"])
def test_a_worker_goes_on_from_any_pass_it_has_seen(monkeypatch, p):
    """Sums are the same whether a worker has seen every pass, some of them, or none, and without room for its rows."""
    rng = np.random.default_rng(5)
    n, n_bins, used = 3000, 16, np.arange(3)
    x, y = rng.integers(0, n_bins, (3, n)).astype(np.uint8), (rng.random(n) < 0.4).astype(float)

    def blocks():
        return iter([B.Block({"n": len(some), "x": np.ascontiguousarray(x[:, some]).tobytes(), "y": y[some].tobytes(),
                              "w": np.ones(len(some)).tobytes(), "key": some.astype("<i8").tobytes()})
                     for some in (np.arange(1000), np.arange(1000, n))])

    edges, trees = [np.arange(n_bins - 1.0)] * 3, []
    for round_ in range(p.rounds):
        tree = B.Tree.empty(p.depth)
        for level in range(p.depth):
            asked = (tuple(trees), tree, level, used, n_bins, round_, p)
            sums = B.level_pass(0, blocks(), "always", *asked)
            B._held.pop(("new", 0), None)
            others = [B.level_pass(0, blocks(), "new", *asked)]
            if (3 * round_ + level) % 4 == 1:
                others.append(B.level_pass(0, blocks(), "some", *asked))
            with monkeypatch.context() as m:
                m.setattr(B, "HELD_BYTES", 0)
                m.setattr(B, "_held", B.OrderedDict())
                others.append(B.level_pass(0, blocks(), "full", *asked))
                assert not B._held
            assert all((o == sums).all() for o in others)
            if not B.grow(tree, level, sums, used, edges, p):
                break
        trees.append(tree)
    direct = list(B.boosted(list(blocks()), edges, p))
    assert all((a.feature == b.feature).all() and (a.value == b.value).all() for a, b in zip(trees, direct)) and len(direct) == p.rounds
    assert B.level_pass(1, iter(()), "always", (), B.Tree.empty(p.depth), 0, used, n_bins, 0, p) is None
