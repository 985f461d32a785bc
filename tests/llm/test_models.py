import zlib

import numpy as np
import pyarrow as pa
import pytest

from sparkpanel.llm import importance, selection, shared, toxicity
from sparkpanel.llm.arrays import slices

from .conftest import small

SF = "/root/testdata/sf0.1"


def test_kth_largest(spark):
    rng = np.random.default_rng(2)
    values = [*rng.normal(size=3000).tolist(), *[0.25] * 500, 1e9, -1e9]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 10, 1499, 1500, 1700, len(values)):
        t = selection.kth_largest(df, "v", k)
        want = sum(v >= ordered[k - 1] for v in values)
        assert sum(v >= t for v in values) == want
    assert selection.kth_largest(df, "v", 0) == float("inf")


def brute_ngrams(text):
    import re
    tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+", text.encode())
    return tokens, list(zip(tokens, tokens[1:]))


def test_ngrams():
    texts = ["Hello, world!! hello", "", "a b", "é x#y", "b"]
    s = next(slices(pa.array(texts)))
    bucket, doc = importance.ngrams(s, 1 << 40)
    names = {}
    for i, t in enumerate(texts):
        one, two = brute_ngrams(t)
        own = bucket[doc == i].tolist()
        assert len(own) == len(one) + len(two)
        for gram, b in zip([*one, *two], own):
            assert names.setdefault(gram, b) == b
    assert len(set(names.values())) == len(names)


def test_ratio_is_that_of_counts(spark):
    docs = small(spark, ["good words here", "good words there", "bad bad stuff", "good stuff"])
    sample = spark.createDataFrame([(0, 1, 0), (1, 1, 1), (2, 0, 0), (3, 1, 0)], "doc_id long, label int, half int")
    ratio = importance.fit(docs, sample)
    s = next(slices(pa.array(["good words here", "good words there", "bad bad stuff", "good stuff"])))
    bucket, doc = importance.ngrams(s)
    raw = np.bincount(bucket, minlength=importance.BUCKETS)
    target = np.bincount(bucket[(doc == 0) | (doc == 3)], minlength=importance.BUCKETS)
    expected = raw / raw.sum() * target.sum()
    assert np.allclose(ratio, np.log((target + importance.PRIOR) / (expected + importance.PRIOR)))


def test_resampling_edges(spark, hard, none, labels):
    got = importance.resample(hard, labels).collect()
    assert len(got) == hard.count()
    for r in got:
        if r.n_grams == 0:
            assert r.log_weight is None and not r.kept
    assert sum(r.kept for r in importance.resample(hard, labels, k=3).collect()) >= 3
    assert importance.resample(none, labels).collect() == []
    all_kept = importance.resample(hard, labels.limit(0)).collect()
    assert all(r.kept == (r.n_grams > 0) for r in all_kept)
    stays = importance.drawn(hard, labels)
    assert stays.columns == hard.columns and stays.count() == sum(r.kept for r in got)


def test_gumbel_top_k_draws_by_weight():
    """Top-1 of log weight + Gumbel noise falls on a row in proportion to its weight."""
    rng = np.random.default_rng(0)
    w = np.array([1.0, 2.0, 5.0])
    draws = np.argmax(np.log(w) - np.log(-np.log(rng.random((20_000, 3)))), axis=1)
    assert np.allclose(np.bincount(draws) / 20_000, w / w.sum(), atol=0.02)


@pytest.fixture(scope="module")
def truth(spark):
    return shared.table(spark, SF, "labels").toPandas().set_index("doc_id")


def test_quality_on_labels_not_fitted(spark, truth):
    docs, labels = shared.documents(spark, SF), shared.table(spark, SF, "labels")
    fitted = labels.filter("doc_id % 3 > 0")
    got = importance.resample(docs, fitted).toPandas().set_index("doc_id").join(truth, how="inner")
    new = got[got.index % 3 == 0]
    assert new[new.quality == 1].kept.mean() > 0.99
    assert new[new.quality == 0].kept.mean() < 0.1


def test_toxicity_held_out(spark, truth):
    docs, labels = shared.documents(spark, SF), shared.table(spark, SF, "labels")
    rows = toxicity.training_rows(docs, labels)
    seen = [r.doc_id for r in rows.select("doc_id").collect()]
    assert all(zlib.crc32(str(i).encode()) % 5 for i in seen)
    got = toxicity.score(docs, toxicity.fit(rows)).toPandas().set_index("doc_id")
    assert got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index]).all()
    new = got[got.held_out].join(truth, how="inner")
    assert new[new.toxic == 0].predicted.mean() < 0.01
    assert new[new.toxic == 1].predicted.mean() > 0.75


def toxic_corpus(spark, n=600):
    """Insults with the name of a group in most toxic texts and in few others."""
    rng = np.random.default_rng(4)
    plain = [f"w{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(n):
        words = rng.choice(plain, 12).tolist()
        bad = i % 3 == 0
        if bad:
            words[2] = rng.choice(["insult", "slur", "scorn"])
        if rng.random() < (0.8 if bad else 0.03):
            words[5] = "muslim"
        if not bad and rng.random() < 0.3:
            words[7] = "christian"
        texts.append(" ".join(words))
        labels.append((i, int(bad)))
    return small(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_swaps_hold_down_group_mentions(spark):
    docs, labels = toxic_corpus(spark)
    rows = toxicity.training_rows(docs, labels)
    neutral = small(spark, [f"w{i} w{i + 5} my {g} friend w{i + 9}" for i in range(40) for g in ("muslim", "christian")])
    plain, regular = toxicity.fit(rows, swap_penalty=0.0), toxicity.fit(rows)
    scores = (toxicity.score(neutral, w).toPandas().sort_values("doc_id").score.to_numpy() for w in (plain, regular))
    before, after = (np.log(x / (1 - x)) for x in scores)
    gap = [abs(x[::2] - x[1::2]).mean() for x in (before, after)]
    assert gap[0] > 0.2 and gap[1] < 0.2 * gap[0]
    hits = toxicity.score(docs, regular).toPandas().set_index("doc_id").join(labels.toPandas().set_index("doc_id"))
    assert (hits.predicted == hits.toxic).mean() > 0.97


def test_toxicity_edges(spark, hard, none, labels):
    weights = toxicity.fit(toxicity.training_rows(hard, labels))
    got = toxicity.score(hard, weights).collect()
    assert len(got) == hard.count()
    assert len({r.score for r in got if r.doc_id in (4, 5)}) == 1  # no words: the intercept's score
    assert all(r.held_out for r in got if r.doc_id is None)
    assert toxicity.score(none, weights).collect() == []
    bare = toxicity.fit(toxicity.training_rows(hard, labels.limit(0)))
    assert {r.score for r in toxicity.score(hard, bare).collect()} == {0.5}


def plain_words(texts):
    """Distinct buckets of each text, one text at a time."""
    import pyarrow as pa
    from sparkpanel.llm.arrays import slices
    return [sorted(toxicity.words(next(slices(pa.array([t]))))[0].tolist()) for t in texts]


def plain_objective(words, y, x, scale, minus, plus, weight):
    """Loss and gradient of the regularised classifier by loops."""
    loss = 0.5 * toxicity.RIDGE * sum(v * v for v in x[:-1])
    grad = [toxicity.RIDGE * v for v in x[:-1]] + [0.0]
    for own, label in zip(words, y):
        z = sum(x[k] * scale[k] for k in own) + x[-1]
        loss += (np.log1p(np.exp(-abs(z))) + max(z, 0) - label * z)
        err = 1 / (1 + np.exp(-z)) - label
        for k in own:
            grad[k] += err * scale[k]
        grad[-1] += err
    for a, b, n in zip(minus, plus, weight):
        change = x[b] * scale[b] - x[a] * scale[a]
        loss += 0.5 * toxicity.SWAP_PENALTY * n * change ** 2
        grad[b] += toxicity.SWAP_PENALTY * n * change * scale[b]
        grad[a] -= toxicity.SWAP_PENALTY * n * change * scale[a]
    return loss, np.array(grad)


def test_toxicity_against_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BUCKETS", 1 << 18)
    docs, labels = toxic_corpus(spark, 120)
    rows = toxicity.training_rows(docs, labels)
    weights = toxicity.fit(rows)
    text = {r.doc_id: r.text for r in docs.collect()}
    train = [(text[r.doc_id], r.label) for r in rows.select("doc_id", "label").collect()]
    words, y = plain_words([t for t, _ in train]), [k for _, k in train]
    counts = np.zeros((2, toxicity.BUCKETS))
    for own, k in zip(words, y):
        counts[k][own] += 1
    terms = {g: [int(toxicity.bucket_of([t])[0]) for t in g] for g in toxicity.GROUPS}
    pairs = {}
    for g, own in terms.items():
        for i, a in enumerate(own):
            for j, b in enumerate(own):
                has = [set(w) for w in words if a in w]
                if a != b and (has or j == 0) and (has or i == 0):
                    pairs[a, b] = pairs.get((a, b), 0) + max(1, sum(b not in w for w in has))
    keep = counts.sum(axis=0) >= toxicity.LEAST_TEXTS
    scale = np.log((counts[1] + 0.5) / (counts[1] + 0.5).sum()) - np.log((counts[0] + 0.5) / (counts[0] + 0.5).sum())
    for a, b in pairs:
        keep[[a, b]], scale[[a, b]] = True, 1.0
    scale = np.where(keep, scale, 0.0)
    x = np.append(np.divide(weights[:-1], scale, out=np.zeros(toxicity.BUCKETS), where=scale != 0), weights[-1])
    minus, plus, weight = [a for a, _ in pairs], [b for _, b in pairs], list(pairs.values())
    best, grad = plain_objective(words, y, x, scale, minus, plus, weight)
    start, steep = plain_objective(words, y, np.append(np.zeros(toxicity.BUCKETS), 0.0), scale, minus, plus, weight)
    assert best < start and np.abs(grad).max() < 0.05 * np.abs(steep).max()
    for r in toxicity.score(docs, weights).collect():
        z = sum(weights[k] for k in plain_words([text[r.doc_id]])[0]) + weights[-1]
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9
