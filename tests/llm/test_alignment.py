import hashlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkpanel.llm import alignment, queries, tokens

from .conftest import hard_rows, small

A, B = tokens.vocabulary("byte_bpe_50k.json"), tokens.vocabulary("piece_bpe_32k.model")
NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def libraries():
    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=B)
    return one, two


def letters():
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, more = {chr(b): b for b in own}, 256
    for b in range(256):
        if b not in own:
            out[chr(more)] = b
            more += 1
    return out


def token_lists(libraries, text):
    """[(id, bytes)] of both sides from whole-text calls; empty if they don't cover the text."""
    one, two = libraries
    if not text:
        return [], []
    table = letters()
    a = [(i, bytes(table[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in two.encode(text):
        piece = two.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if two.is_byte(i) else piece.replace("▁", " ").encode()))
    want = (" " + text).encode()
    same = b"".join(x for _, x in a) == want == b"".join(x for _, x in b)
    return (a, b) if same else ([], [])


def brute_groups(a, b):
    ends_a, ends_b, at = [], [], 0
    for _, x in a:
        at += len(x)
        ends_a.append(at)
    at = 0
    for _, x in b:
        at += len(x)
        ends_b.append(at)
    out, begin = [], 0
    for end in sorted(set(ends_a) & set(ends_b)):
        out.append(([i for (i, _), e in zip(a, ends_a) if begin < e <= end],
                    [i for (i, _), e in zip(b, ends_b) if begin < e <= end], begin, end))
        begin = end
    return out


def brute(libraries, texts):
    found = [brute_groups(*token_lists(libraries, t)) for t in texts]
    links = [Counter((x, y) for a, b, _, _ in g for x in a for y in b) for g in found]
    count = Counter(p for c in links for p in c)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for g, c in zip(found, links):
        line = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b, _, _ in g)
        out.append((sum(len(a) for a, *_ in g), sum(len(b) for _, b, *_ in g), len(g), sum(c.values()),
                    sum(n for p, n in c.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in c.items()),
                    hashlib.sha256(line.encode()).hexdigest() if line else ""))
    return out


def got(df):
    return Counter((r["doc_id"], *[r[c] for c in NAMES]) for r in df.collect())


def test_hard_rows(libraries, hard):
    rows = [r for r in hard_rows() if not r[1] or len(r[1]) < 60_000]
    want = brute(libraries, [r[1] for r in rows])
    some = hard.filter("text is null or length(text) < 60000")
    assert got(alignment.summary(some, A, B)) == Counter((r[0], *w) for r, w in zip(rows, want))


@pytest.mark.parametrize("heavy", [0, 1, 7, 1 << 19])
def test_rare_pairs_are_joined_whole(libraries, spark, heavy):
    texts = ["The tokenizers disagree, unsurprisingly: internationalisation 12345!", "the the the tokenizers", None, "",
             "unsurprisingly so", "naïve café — “quoted”  two  spaces\n\ttabs", "日本語 text", "<|endoftext|> <s> </s> <unk> <0x41>",
             "▁ underline piece", " leading", "trailing ", "A" * 300, "the the the tokenizers"]
    df = alignment.summary(small(spark, texts).repartition(3), A, B, heavy=heavy)
    assert got(df) == Counter((i, *w) for i, w in enumerate(brute(libraries, texts)))


def test_groups_of_each_document(libraries, spark):
    texts = ["Anblewh sttible athawh thonre", None, "overlapping tokenisation", "é日本 ß"]
    found = defaultdict(list)
    for r in alignment.groups(small(spark, texts), A, B).orderBy("doc_id", "group").collect():
        assert r["group"] == len(found[r["doc_id"]])
        found[r["doc_id"]].append((r["a"], r["b"], r["start"], r["end"]))
    for i, t in enumerate(texts):
        assert found[i] == brute_groups(*token_lists(libraries, t))


def test_long_texts_are_cut_where_neither_side_joins(libraries):
    text = " ".join(f"word{i} don't  2x  {i * 7919}. Zürich-{i}" for i in range(2000))
    parts = alignment.parts_of(text, 500)
    assert len(parts) > 50 and " ".join(parts) == text
    one, two = libraries
    assert [i for p in parts for i in one.encode(" " + p, add_special_tokens=False).ids] == \
        one.encode(" " + text, add_special_tokens=False).ids
    assert [i for p in parts for i in two.encode(p)] == two.encode(text)


def test_a_large_group_costs_its_distinct_pairs():
    a, b = alignment.sides(A, B)
    found = alignment.Stretches(["z" * 999 + "'s", "plain", "plain words"], a, b)
    whole = Counter({(int(t), int(p)): int(n) for t, p, n in zip(*found.pairs())})
    cut = Counter()
    for t, p, n in found.linked(most=5):
        for x in zip(t.tolist(), p.tolist(), n.tolist()):
            cut[x[:2]] += x[2]
    assert whole == cut and sum(whole.values()) == int((found.size_a * found.size_b).sum()) == int(found.links.sum())


def test_texts_in_pieces_have_the_same_pairs():
    a, b = alignment.sides(A, B)
    batch = alignment.Batch([f"some words and wordpieces {i % 3} again and again" for i in range(9)] + ["", "x"], a, b)
    whole = [(i, p.tolist(), n.tolist()) for i, p, n in batch.pairs()]
    assert whole == [(i, p.tolist(), n.tolist()) for i, p, n in batch.pairs(most=3)]
    assert [sum(n) for _, _, n in whole] == batch.total(batch.stretches.links).tolist()


def test_empty_table(none):
    out = alignment.summary(none, A, B)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert out.isEmpty() and alignment.groups(none, A, B).isEmpty()


def test_query_over_whole_table(libraries, spark):
    """The registered query against whole-text library calls on every document."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = brute(libraries, [r["text"] for r in docs])
    df = queries.QUERIES["op13_token_alignment"](spark, "/root/testdata/sf0.001")
    assert got(df) == Counter((r["doc_id"], *w) for r, w in zip(docs, want))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aAbB'sStdlvrem \n\t.,!?<|>endoftx0123éÉßöŽłñ×÷  \u0085 İ日"),
                                           st.characters(blacklist_categories=("Cs",))), max_size=30), max_size=4))
def test_quick_ids_equal_the_librarys(texts):
    a, _ = alignment.sides(A, B)
    assert a.quick is not None
    assert a.ids(texts) == [e.ids for e in a.library.encode_batch([" " + t for t in texts], add_special_tokens=False)]
