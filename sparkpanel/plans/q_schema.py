"""Step 4: schema alignment, all-NULL drop, payload flattening and guards."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import schema as S
from ..operators import scoring as SC
from .catalog import register
from .q_pairs import panel_pairs
from .tables import PAIRS_SQL, table


def _years(pairs):
    """The periods of the panel (a handful), in order."""
    return [r["year_t"] for r in pairs.select("year_t").distinct().orderBy("year_t").collect()]


def _union(frames, empty):
    out = empty
    for f in frames:
        out = f if out is empty else out.unionByName(f)
    return out


@register("align_schema", "WITH " + PAIRS_SQL + """
SELECT id, year_t, year_t1, y, n_orders, CAST(NULL AS BIGINT) AS n_urgent, total_cents,
       CAST(NULL AS DOUBLE) AS avg_price
FROM pairs WHERE year_t > (SELECT min(year_t) FROM pairs)
""")
def align_schema(spark, sf):
    """Each period's differently shaped pair table aligned to the schema of the one before it
    (missing -> typed NULL, extra dropped, train order)."""
    pairs = panel_pairs(spark, sf)
    years = _years(pairs)

    def aligned(t, u):
        train = pairs.where(F.col("year_t") == t)
        other = (pairs.where(F.col("year_t") == u)
                 .select("id", "year_t", "year_t1", "y", "n_orders", "total_cents", (F.col("n_urgent") * 2).alias("extra")))
        return S.align_to_schema(train, other, keep=("id", "year_t", "year_t1", "y"))

    return _union([aligned(t, u) for t, u in zip(years, years[1:])], pairs.limit(0))


@register("drop_all_null", "WITH " + PAIRS_SQL + """
SELECT id, year_t, year_t1, y, n_orders, n_urgent, total_cents, avg_price FROM pairs
WHERE year_t > (SELECT min(year_t) FROM pairs)
""")
def drop_all_null(spark, sf):
    """For each two neighbouring periods, a feature that is NULL on every train row is removed from
    train and test (one ``count(c)`` aggregate over train)."""
    pairs = panel_pairs(spark, sf)
    years = _years(pairs)
    dead = F.when(F.col("n_orders") < 0, F.lit(1.0)).alias("dead")
    live = (F.col("n_orders") * 1.0).alias("dead")

    def kept(t, u):
        train = pairs.where(F.col("year_t") == t).select("*", dead)
        other = pairs.where(F.col("year_t") == u).select("*", live)
        feats = [c for c in train.columns if c not in ("id", "year_t", "year_t1", "y")]
        return S.drop_all_null_features(train, other, feats)[1]

    return _union([kept(t, u) for t, u in zip(years, years[1:])], pairs.limit(0))


EXPECTED = ["custkey", "priority", "ano_pedido"]
LEAK = ("CASE WHEN o_orderpriority = '1-URGENT' THEN ', \"target\": 1' "
        "WHEN o_orderpriority = '2-HIGH' THEN ', \"Nota_T1\": 7' ELSE '' END")
BODY = ("concat('\"custkey\": ', CAST(o_custkey AS STRING), ', \"priority\": \"', o_orderpriority, "
        "'\", \"ano_pedido\": ', CAST(CAST(year(o_orderdate) AS INTEGER) AS STRING), " + LEAK + ")")
PAYLOAD = ("CASE o_orderstatus WHEN 'P' THEN concat('{\"foo\": ', CAST(o_custkey AS STRING), ', \"bar\": \"x\"}') "
           f"WHEN 'F' THEN concat('{{\"features\": {{', {BODY}, '}}, \"model_key\": \"tree\"}}') "
           f"ELSE concat('{{', {BODY}, ', \"model_key\": \"tree\"}}') END")

_FEATS_SQL = f"""WITH p AS (SELECT o_orderkey, {PAYLOAD} AS payload FROM orders),
f AS (SELECT o_orderkey, CASE WHEN json_exists(payload, '$.features') THEN json_extract(payload, '$.features')
                             ELSE json(payload) END AS fj FROM p),
k AS (SELECT o_orderkey, fj, list_filter(json_keys(fj), lambda k: k <> 'model_key') AS keys FROM f),
g AS (SELECT *, list_sort(list_distinct(list_filter(keys, lambda k:
        k IN ('IAN', 'y', 'target', 'defasagem', 'RISCO_DEFASAGEM', 'year_t1', 'year_t+1', 'ano_t1', 'ano_t+1')
        OR regexp_matches(k, '(?i).*t\\+?1.*') OR regexp_matches(k, '(?i).*year_?t1.*')
        OR regexp_matches(k, '(?i).*ano_?t1.*')))) AS forbidden FROM k),
r AS (SELECT *, CASE WHEN len(forbidden) > 0 THEN 'leakage'
                     WHEN len(list_intersect(keys, ['custkey', 'priority', 'ano_pedido'])) = 0 THEN 'no_known_feature'
                END AS reason FROM g)"""


def _guarded(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.expr(PAYLOAD).alias("payload"))
    return SC.guard_payloads(o, "payload", EXPECTED)


@register("payload_flatten", _FEATS_SQL + """
SELECT o_orderkey, TRY_CAST(json_extract_string(fj, '$.custkey') AS BIGINT) AS custkey,
       json_extract_string(fj, '$.priority') AS priority,
       TRY_CAST(json_extract_string(fj, '$.ano_pedido') AS INTEGER) AS ano_pedido
FROM r WHERE reason IS NULL
""")
def payload_flatten(spark, sf):
    """P25+P23+P17: nested or flat JSON payloads -> typed allow-listed
    feature columns (accepted rows)."""
    g = _guarded(spark, sf).where(F.col("reject_reason").isNull())
    return SC.payload_to_columns(g, EXPECTED, {"custkey": T.LongType(), "ano_pedido": T.IntegerType()},
                                 keep=["o_orderkey"])


@register("leakage_guard_rows", _FEATS_SQL + """
SELECT o_orderkey, forbidden FROM r WHERE reason = 'leakage'
""")
def leakage_guard_rows(spark, sf):
    """F8: payload rows rejected for target / t+1 keys, with the keys."""
    g = _guarded(spark, sf)
    return (g.where(F.col("reject_reason") == "leakage")
            .select("o_orderkey", SC.forbidden_keys(F.col("keys")).alias("forbidden")))


@register("unrecognised_rows", _FEATS_SQL + """
SELECT o_orderkey, list_sort(keys) AS keys FROM r WHERE reason = 'no_known_feature'
""")
def unrecognised_rows(spark, sf):
    """payload rows without any recognised feature."""
    g = _guarded(spark, sf)
    return (g.where(F.col("reject_reason") == "no_known_feature")
            .select("o_orderkey", F.array_sort("keys").alias("keys")))
