import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkpanel.llm import packing, shared, token_output, tokens
from sparkpanel.llm.token_output import EliasFano

PATH = tokens.vocabulary()
LIBRARY = tokens.WordEncoder(PATH).library


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aAbB'sSdD \n\t.,!?<|>endoftx0123éÉßöṉ̃́  "),
                                           st.characters(blacklist_categories=("Cs",))), max_size=40), max_size=5))
def test_word_ids_equal_whole_text_ids(texts):
    enc = tokens.encoder(PATH)
    got = enc.encode_many([t.encode() for t in texts])
    assert [np.frombuffer(g, enc.dtype).tolist() for g in got] == [library_ids(t) for t in texts]


def test_generations_of_words_keep_results(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 1000)
    enc = tokens.WordEncoder(PATH)
    texts = [f"alpha beta w{i} gamma{i % 4}." for i in range(30)]
    for t in texts * 2:
        assert np.frombuffer(enc.encode_many([t.encode()])[0], enc.dtype).tolist() == library_ids(t)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=0, max_size=300))
def test_elias_fano(sizes):
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    ef = EliasFano.of(ends)
    assert ef.all().tolist() == ends.tolist()
    assert [ef.select(i) for i in range(len(ends))] == ends.tolist()
    assert ef.select_many(np.arange(len(ends))).tolist() == ends.tolist()
    assert ef.select_many(np.arange(0, len(ends), 7)).tolist() == ends[::7].tolist()
    n = len(ends)
    assert len(ef.high) * 8 <= 3 * n + 16 and len(ef.low) * 8 <= n * max(1, np.log2(max(2, ends[-1] / n))) + 8


def test_ids_round_trip(spark, hard, none):
    rows = sorted(hard.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0))
    out = shared.fresh(spark, "test-ids")
    got = token_output.id_table(hard, out, PATH, 2).collect()
    want, at = [], 0
    for key, text in rows:
        ids = np.array([*library_ids(text), 2], "<u4")
        want.append((key, len(ids), zlib.crc32(ids)))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    got.sort(key=lambda r: r.start)
    for r, (key, _) in zip(got, rows):
        assert r.start == at and r.doc_id == key
        at += r.n_tokens
    shard = spark.read.parquet(out).first().asDict()
    assert shard["id_bytes"] == 2
    texts = dict(r for r in rows if r.doc_id is not None)
    for i, key in enumerate(shard["doc_ids"]):
        if key is not None:
            assert token_output.document_at(shard, i).tolist() == [*library_ids(texts[key]), 2]
    assert token_output.id_table(none, shared.fresh(spark, "test-ids"), PATH, 2).collect() == []


def test_small_shards(spark, hard):
    out = shared.fresh(spark, "test-shards")
    token_output.write_ids(hard, out, PATH, 2, shard_ids=50)
    assert spark.read.parquet(out).count() > 8
    whole = shared.fresh(spark, "test-shards")
    token_output.write_ids(hard, whole, PATH, 2)
    a, b = (sorted(token_output.read_ids(spark, p).collect(), key=lambda r: r.start) for p in (out, whole))
    assert a == b


def naive_first_fit(lengths, size):
    bins, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        for b, used in enumerate(bins):
            if used + lengths[i] <= size:
                break
        else:
            b, used = len(bins), 0
            bins.append(0)
        out[i] = (b, used)
        bins[b] += lengths[i]
    return [out[i] for i in range(len(lengths))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_tournament_is_first_fit_decreasing(lengths):
    got = packing.first_fit_decreasing(np.array(lengths, np.int64), 64)
    assert list(zip(*[x.tolist() for x in got])) == naive_first_fit(lengths, 64)


def test_packing(spark, hard, none):
    rows = packing.pack(hard, PATH, 1, size=256, group_pieces=40, keep_ids=True)
    got = rows.collect()
    want = sorted((str(r.doc_id), zlib.crc32(np.array([*library_ids(r.text), 1], "<u4"))) for r in hard.select("doc_id", "text").collect())
    docs = {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and r.length * 4 == len(r.ids) and r.offset + r.length <= 256
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    single = [(str(k[0]), zlib.crc32(b"".join(bytes(x.ids) for x in sorted(v, key=lambda x: x.start))))
              for k, v in docs.items() if len({x.start for x in v}) == len(v)]
    assert set(single) <= set(want) and len(single) >= len(hard_distinct(hard)) - 6
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():  # gapless from 0
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(rows).collect()}
    for r in got:
        assert whole[r.sequence_id][4 * r.offset:4 * (r.offset + r.length)] == bytes(r.ids)
    assert packing.pack(none, PATH, 1).collect() == []


def hard_distinct(hard):
    return {(r.doc_id, r.text) for r in hard.select("doc_id", "text").collect()}


def test_word_memory_is_bounded_and_freed(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 200_000)
    enc = tokens.WordEncoder(PATH)
    for i in range(60):
        enc.encode_many([" ".join(f"word{i}x{j}" for j in range(200)).encode()])
        held = sum(tokens.ENTRY_BYTES + len(k) + len(v) for d in (enc.young, enc.old, enc.pieces) for k, v in d.items())
        assert held <= 200_000 + 200 * 400
    enc.forget()
    assert not enc.young and not enc.old and not enc.pieces


def test_tasks_free_their_words(spark, hard):
    def left(batches):
        import pyarrow as pa
        for _ in token_output.encoded(batches, PATH):
            pass
        e = tokens.encoder(PATH)
        yield pa.RecordBatch.from_pydict({"n": [len(e.young) + len(e.old) + len(e.pieces)]})

    assert {r.n for r in shared.doc_text(hard).mapInArrow(left, "n long").collect()} == {0}


def test_words_share_ids_with_their_pieces():
    """A word with marks takes the ids of its bare word, and the other way round; every remembered word is counted."""
    enc = tokens.WordEncoder(tokens.vocabulary())
    asked, plain = [], enc._model_ids
    enc._model_ids = lambda letters: asked.append(letters) or plain(letters)
    texts = [b"harbour harbour, (harbour) quayside;", b"quayside harbour. caf\xc3\xa9, \xc3\x89t\xc3\xa9 <|x|> a\n\nb"]
    whole = tokens.WordEncoder(tokens.vocabulary()).library
    want = [np.array(whole.encode(t.decode(), add_special_tokens=False).ids, enc.dtype).tobytes() for t in texts]
    assert [enc.encode_many([t])[0] for t in texts] == want
    assert asked.count("harbour") == 1 and asked.count("quayside") == 1

    def counted():
        return (sum(tokens.ENTRY_BYTES + len(w) + len(x) for w, x in enc.young.items())
                + sum(tokens.ENTRY_BYTES + len(w) + len(x) for w, x in enc.pieces.items()))

    assert enc.used == counted()
    enc.old, enc.young, enc.pieces, enc.used = enc.young, {}, {}, 0
    assert [enc.encode_many([t])[0] for t in texts] == want
    assert enc.used == counted() and asked.count("harbour") == 1  # words of the old generation count again


def test_words_outlast_a_task_of_the_writer_alone(monkeypatch):
    """Each short task of write_ids learned the common words again."""
    import pyarrow as pa
    from sparkpanel.llm import token_output
    path, asked = tokens.vocabulary(), []
    enc = tokens.encoder(path)
    enc.forget()
    model_ids = enc._model_ids
    monkeypatch.setattr(enc, "_model_ids", lambda s: asked.append(s) or model_ids(s))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some plain words", "plain Words, again"]})

    def ids(kept):
        return [x for _, _, found in token_output.encoded(iter([batch]), path, kept) for x in found]

    first = ids(token_output.KEPT_BYTES)
    learned = len(asked)
    assert learned and ids(token_output.KEPT_BYTES) == first and len(asked) == learned
    assert ids(0) == first and not enc.young and not enc.old  # others free them
    ids(token_output.KEPT_BYTES)
    tokens.forget_all()
    assert not enc.young and not enc.old and not enc.pieces and enc.used == 0
    enc.room = 4 * len(b"plain")  # a full room is emptied in generations
    assert enc.encode_many([b"some plain words"]) and enc.encode_many([b"plain words, again"])
    assert enc.old and enc.encode_many([b"some plain words"])[0] == first[0]
    enc.room = 0
    enc.forget()
