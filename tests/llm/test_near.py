import random

import numpy as np
import pyarrow as pa

from sparkpanel.llm import near_dedup as N
from sparkpanel.llm.arrays import slices

from . import brute
from .conftest import small


def varied(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        i = rng.randrange(len(out))
        kind = rng.random() if len(out) > 2 else 0
        if kind < 0.6:
            out[i] = f"n{rng.randrange(10**6)}"
        elif kind < 0.8:
            del out[i]
        else:
            out.insert(i, out[i])
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    texts = []
    for n in (4, 5, 9, 40, 120, 300):
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        texts += [" ".join(varied(rng, base, c)) for c in (0, 0, 1, 2, 4, 8)]
    passage = " ".join(f"p{i}" for i in range(80))  # shared by texts that are otherwise different
    texts += [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(15 + 4 * i)) for i in range(20)]
    return texts + ["a b c a b c a b c a b c a b c a b c", "a b c a b c a b c a b c a b c", "one  two\nthree", "one two three"]


def test_prob_jaccard_is_the_definition():
    rng = random.Random(1)
    for _ in range(100):
        x = {i: rng.randrange(1, 4) for i in rng.sample(range(20), rng.randrange(1, 12))}
        y = {i: rng.randrange(1, 4) for i in rng.sample(range(20), rng.randrange(1, 12))}
        arrays = [np.array(a) for d in (x, y) for a in (list(d), list(d.values()))]
        assert abs(N.prob_jaccard(*arrays) - brute.prob_jaccard(x, y)) < 1e-12


def test_registers_estimate_similarity():
    texts = [t for t in corpus() if len(t.split()) > 8]
    s = next(slices(pa.array(texts)))
    doc, h, count = N.shingles(s, s.word_hash())
    registers = N.prob_min_hash(doc, h, count.astype(float), s.n, 2048)
    sets = [brute.shingle_counts(t) for t in texts]
    for i in range(0, len(texts), 3):
        for j in range(i):
            want = brute.prob_jaccard(sets[i], sets[j])
            assert abs((registers[i] == registers[j]).mean() - want) < 5 * np.sqrt(want * (1 - want) / 2048) + 1e-9


def check(spark, texts):
    got = N.near_duplicates(small(spark, texts)).collect()
    want = brute.classes(texts, N.SIMILARITY)
    sizes = np.bincount(want)
    assert len(got) == len(texts)
    for r in got:
        assert (r.class_id, r.class_size) == (want[r.doc_id], sizes[want[r.doc_id]]), texts[r.doc_id][:80]
        assert r.kept == (r.class_id == r.doc_id)


def test_classes(spark):
    check(spark, corpus())


def test_chained_group_larger_than_its_links(spark):
    """Neighbours are similar, ends are not: all are one class."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(60):
        words = varied(rng, words, 2)
        texts.append(" ".join(words))
    check(spark, texts)


def test_edges(spark, hard, none):
    got = N.near_duplicates(hard).collect()
    assert len(got) == hard.count()
    rows = hard.select("doc_id", "text").collect()
    by_words = {}
    for r in rows:
        if brute.word_list(r.text):
            by_words.setdefault(tuple(brute.word_list(r.text)), []).append(r.doc_id)
    kept = [r for r in got if r.kept]
    blank = [r for r in rows if not brute.word_list(r.text)]
    # equal words are one class; documents without words stand alone; 9 and 10 differ in one word
    assert len(kept) == len(by_words) - 1 + len(blank)
    assert {r.class_id for r in got if r.doc_id in (9, 10)} == {9}
    assert {r.class_id for r in got if r.doc_id in (1, 2)} == {1}
    assert N.near_duplicates(none).collect() == []
