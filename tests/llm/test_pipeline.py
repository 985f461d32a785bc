import duckdb
import pytest

import corpus_pipeline
from sparkpanel.llm import queries, shared

from . import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = shared.documents(spark, SF), []
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.keep(stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs))
    return out


def rows(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_stages(spark, stages):
    names = [n for n, _ in stages]
    assert names == ["quality_classifier", "exact_dedup", "near_dedup", "mixing", "packing"]
    for _, df in stages[:-1]:
        assert df.columns == COLUMNS
    all_rows, kept = rows(shared.documents(spark, SF)), [rows(df) for _, df in stages[:-1]]
    assert set(kept[0]) <= set(all_rows)
    bad = {r.doc_id for r in shared.table(spark, SF, "labels").filter("quality = 0").collect()}
    good = {r.doc_id for r in shared.table(spark, SF, "labels").filter("quality = 1").collect()}
    ids = {r[0] for r in kept[0]}
    assert len(good & ids) >= 0.95 * len(good & {r[0] for r in all_rows}) and len(bad & ids) <= 0.5 * len(bad)
    best = {}
    for r in kept[0]:
        if r[1] not in best or r[0] > best[r[1]][0]:
            best[r[1]] = r
    assert sorted(kept[1]) == sorted(best.values())
    ordered = sorted(kept[1])
    classes = brute.classes([r[1] for r in ordered], 0.8)
    assert sorted(kept[2]) == [r for i, r in enumerate(ordered) if classes[i] == i]
    assert set(kept[3]) <= set(kept[2]) and max(kept[3].count(r) for r in set(kept[3])) <= 3


def test_last_stage_packs_what_is_left(stages):
    from sparkpanel.llm import tokens
    enc = tokens.WordEncoder(tokens.vocabulary()).library
    left = stages[-2][1].select("doc_id", "text").collect()
    want = sum(len(enc.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in left)
    pieces = stages[-1][1].collect()
    assert sum(p.length for p in pieces) == want
    ends = {}
    for p in pieces:
        ends.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in ends.values():
        assert sum(n for _, n in parts) == max(a + n for a, n in parts) <= 2048


def test_edges(spark, hard, none, tmp_path_factory):
    """Clashing columns, nulls and empty tables go through every stage."""
    labels = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{labels}/labels.parquet")
    for docs in (hard, none):
        for name, stage in corpus_pipeline.STAGES:
            out = shared.keep(stage(spark, docs, labels), f"edge-{name}")
            if name != "packing":
                assert out.columns == docs.columns, name
            if name == "exact_dedup":
                texts = {r.text or "" for r in docs.select("text").collect()}
                assert out.count() == len(texts)
            docs = out


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.ORACLE])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(str, got[columns].values.tolist())) == sorted(map(str, want[columns].values.tolist()))


def test_every_operator_has_one_query():
    numbers = [int(n[2:].split("_")[0]) for n in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 14))
