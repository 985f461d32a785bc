import math
import random

import numpy as np

from sparkpanel.llm import secret_scan

from .conftest import small


def test_ordinary_runs_are_counted_over_all_texts(spark):
    """Of the values that label formats one is asked for; the model of ordinary runs still sees every run."""
    rng = random.Random(4)
    plain = sorted({"".join(rng.choice("aghzAZ09+/_.=-") for _ in range(rng.randrange(12, 40))) for _ in range(500)})
    docs = small(spark, [f"é {a} {b}\n{a}" for a, b in zip(plain, plain[1:])] + ["", None]).repartition(5)
    n = len(secret_scan.SIZES)
    counts = np.full((n + 1, n), 0.5)
    for v in plain:
        last = n
        for c in v.encode():
            kind = secret_scan._KIND[c]
            counts[last, kind] += 1
            last = kind
    want = np.log(counts / counts.sum(axis=1, keepdims=True)) - np.array([math.log(x) for x in secret_scan.SIZES])
    got = secret_scan.learn(docs, sample=1)
    assert got.automata == {} and np.allclose(got.plain, want)


def test_no_ordinary_runs(none):
    assert np.isfinite(secret_scan.learn(none).plain).all()
