import hashlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkpanel.llm import exact_dedup as X

from .conftest import small


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, X.PRIME - 1), st.integers(0, X.PRIME - 1)), min_size=1, max_size=20))
def test_multiply(pairs):
    a, b = (np.array(c, np.uint64) for c in zip(*pairs))
    assert X.multiply(a, b).tolist() == [x * y % X.PRIME for x, y in pairs]


def direct(data, base):
    padded = data + b"\0" * (-len(data) % 4)
    h = 0
    for i in range(0, len(padded), 4):
        h = (h * base + int.from_bytes(padded[i:i + 4], "little")) % X.PRIME
    return h


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_fingerprints(texts):
    got = X.fingerprints(pa.array(texts, pa.string()))
    assert got == [tuple(direct(t.encode(), b) for b in X.BASES) for t in texts]


def test_chunks_combine_to_the_whole():
    data = np.random.default_rng(1).integers(1, 127, 3 * X.CHUNK + 77, np.uint8)
    whole = X.fingerprints(pa.array([data.tobytes().decode()]))[0]
    for base, want in zip(X.BASES, whole):
        parts = [X.chunk_hashes([data[i:i + X.CHUNK]], base) for i in range(0, len(data), X.CHUNK)]
        parts = [(int(h[0]), int(n[0])) for h, n in parts]
        left = X.combine(X.combine(parts[0], parts[1], base), X.combine(parts[2], parts[3], base), base)
        right = X.combine(parts[0], X.combine(parts[1], X.combine(parts[2], parts[3], base), base), base)
        assert left == right and left[0] == want == direct(data.tobytes(), base)


def brute(rows):
    groups = {}
    for key, text in rows:
        groups.setdefault(text or "", []).append(key)
    out = []
    for text, keys in groups.items():
        best = max((k for k in keys if k is not None), default=None)
        kept = False
        for k in keys:
            stays = k == best and not kept
            kept |= stays
            out.append((k, best, len(keys), stays, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(map(str, out))


def check(df, limit=X.PRIME):
    got = X.deduplicate(df, limit).drop("text_hash").collect()
    assert sorted(str(tuple(r)) for r in got) == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_deduplicate(hard, none):
    check(hard)
    assert X.deduplicate(none).collect() == []


def test_colliding_fingerprints_are_told_apart(spark):
    """With fingerprints modulo 3 most texts of a length collide; chunks tell them apart."""
    texts = [f"text {i % 25:02d}" for i in range(60)] + ["x" * X.CHUNK + "a", "x" * X.CHUNK + "b", "x" * X.CHUNK + "a"]
    check(small(spark, texts), limit=3)


def test_hot_group(spark):
    check(small(spark, ["the same text"] * 500 + [f"other {i}" for i in range(200)]))
