import os
import tempfile
import zlib
from collections import Counter

import pytest

from sparkpanel.llm import queries, sharding

from .conftest import hard_rows, small


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 12, 39, 40, 41, 120, 1000])
def test_permutation_is_one_and_goes_back(n):
    p = sharding.Permutation(n)
    places = [p.forward(i) for i in range(n)]
    assert sorted(places) == list(range(n))
    assert [p.backward(x) for x in places] == list(range(n))


def test_grid_spares_less_than_its_height():
    for n in [*range(1, 2000), 10**9, 10**12 + 7]:
        height, width = sharding.grid(n)
        assert 0 <= height * width - n < height


@pytest.mark.parametrize("n", [1, 2, 3, 5, 41, 250])
def test_column_form_equals_plain_form(spark, n):
    got = {r["number"]: r["place"] for r in sharding.permuted(
        spark.range(n).select("id", "id").toDF("number", "place0").select("number", "place0")
        .withColumnRenamed("place0", "kept"), n).selectExpr("kept as number", "place").collect()}
    p = sharding.Permutation(n)
    assert got == {i: p.forward(i) for i in range(n)}


def check_law(rows, shards):
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values(), default=0) - min((sizes.get(s, 0) for s in range(shards)), default=0) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))


def test_hard_rows(spark, hard):
    rows = sharding.shard(hard).collect()
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _, _ in hard_rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    check_law(rows, 40)
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}
    again = sharding.shard(hard.repartition(7)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_place_follows_from_the_row_number(spark):
    docs = small(spark, [f"text {i}" for i in range(333)])
    p = sharding.Permutation(333, 5)
    for r in sharding.shard(docs.repartition(5), 7, 5).collect():
        assert (r["shard"], r["slot"]) == (p.forward(r["doc_id"]) % 7, p.forward(r["doc_id"]) // 7)
        assert p.backward(r["slot"] * 7 + r["shard"]) == r["doc_id"]


def test_one_doc_id_on_most_rows(spark):
    docs = spark.range(2000).selectExpr("if(id % 3 > 0, 5, id) as doc_id", "if(id % 3 > 1, 'same', cast(id as string)) as text")
    rows = sharding.shard(docs, 40).collect()
    assert len(rows) == 2000
    check_law(rows, 40)


def test_empty_table(none):
    out = sharding.shard(none)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and out.isEmpty()


def test_written_shards_hold_whole_rows_in_place(spark, hard):
    out = os.path.join(tempfile.mkdtemp(prefix="sp-shards-"), "out")
    sharding.write_shards(hard, out, 3)
    back = spark.read.parquet(out)
    assert back.select("row.*").exceptAll(hard).isEmpty() and back.count() == hard.count()
    assert Counter((r["doc_id"], r["shard"], r["slot"]) for r in back.select("row.doc_id", "shard", "slot").collect()) == \
        Counter((r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard(hard, 3).collect())


def test_query_is_native_and_lawful(spark):
    df = queries.QUERIES["op11_feistel_shards"](spark, "/root/testdata/sf0.01")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "MapPartitions"))
    rows = df.collect()
    assert len(rows) == 1000
    check_law(rows, 40)
