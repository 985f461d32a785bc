"""Step 3: scalar cleaning functions and the full period cleaning chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import clean as C
from ..operators import schema as S
from .catalog import register
from .tables import PANEL_SQL, orders_panel, table

# DuckDB spellings of T3 / T4 for the oracle.  RE2's \s is ASCII-only, so the
# Unicode white-space set of Java's (?U)\s is listed explicitly.
WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def t3(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'))"


def t4(x: str) -> str:
    return (f"TRY_CAST(regexp_replace(replace(trim(CAST({x} AS VARCHAR)), ',', '.'), "
            f"'[^0-9.\\-]+', '', 'g') AS DOUBLE)")


def nonempty(x: str) -> str:
    return f"CAST(COALESCE({t3(x)} <> '', false) AS BIGINT)"


DIRTY_PRICE = "concat('R$ ', replace(CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING), '.', ','))"


@register("clean_numeric", f"""
SELECT o_orderkey, {DIRTY_PRICE} AS dirty,
       {t4(DIRTY_PRICE)} AS parsed,
       {t4('o_orderpriority')} AS parsed_priority,
       TRY_CAST(regexp_extract(replace(trim(concat('Fase ', o_orderstatus, ' ', CAST(o_custkey AS VARCHAR), ',5 ano')), ',', '.'),
                '-?[0-9]+(\\.[0-9]+)?|-?\\.[0-9]+', 0) AS DOUBLE) AS first_number
FROM orders
""")
def clean_numeric(spark, sf):
    """T4/T5: locale numbers back to doubles (``R$ 1234,56`` -> 1234.56);
    non-numbers -> NULL; the ``first_number`` mode on mixed text."""
    o = table(spark, sf, "orders")
    dirty = F.expr(DIRTY_PRICE)
    mixed = F.concat(F.lit("Fase "), F.col("o_orderstatus"), F.lit(" "),
                     F.col("o_custkey").cast("string"), F.lit(",5 ano"))
    return o.select("o_orderkey", dirty.alias("dirty"),
                    X.coerce_numeric(dirty).alias("parsed"),
                    X.coerce_numeric("o_orderpriority").alias("parsed_priority"),
                    X.coerce_numeric(mixed, mode="first_number").alias("first_number"))


@register("clean_string", f"""
SELECT doc_id, md5({t3('text')}) AS text_md5, length({t3('text')}) AS n_clean,
       length(text) - length({t3('text')}) AS n_removed
FROM documents
""")
def clean_string(spark, sf):
    """T3 over whole documents: collapse white space runs, trim."""
    d = table(spark, sf, "documents")
    c = X.clean_string("text")
    return d.select("doc_id", F.md5(c).alias("text_md5"), F.length(c).cast("long").alias("n_clean"),
                    (F.length("text") - F.length(c)).cast("long").alias("n_removed"))


@register("strip_accents", """
SELECT doc_id, lang, md5(strip_accents(text)) AS text_md5,
       md5(lower(strip_accents(text))) AS lower_md5, length(strip_accents(text)) AS n_chars_plain
FROM documents
""")
def strip_accents(spark, sf):
    """T1+T2 over whole documents (fr/es/de accents)."""
    d = table(spark, sf, "documents")
    plain = d.select("doc_id", "lang", X.strip_accents("text").alias("plain"))
    return plain.select("doc_id", "lang", F.md5("plain").alias("text_md5"),
                        F.md5(F.lower("plain")).alias("lower_md5"), F.length("plain").cast("long").alias("n_chars_plain"))


# Segment -> ordinal for the test binding (MACHINERY is deliberately unknown).
SEGMENT_ORDINAL = {"automobile": 0, "building": 1, "furniture": 2, "household": 3}
DIRTY_SEGMENT = ("CASE WHEN c_acctbal < 0 THEN concat('  ', upper(c_mktsegment), ' ') "
                 "WHEN c_acctbal < 5000 THEN lower(c_mktsegment) "
                 "ELSE replace(replace(c_mktsegment, 'U', 'Ú'), 'E', 'É') END")


@register("ordinal_encode", f"""
SELECT c_custkey, {DIRTY_SEGMENT} AS segment,
       CAST(CASE strip_accents(lower({t3(DIRTY_SEGMENT)}))
         WHEN 'automobile' THEN 0 WHEN 'building' THEN 1 WHEN 'furniture' THEN 2
         WHEN 'household' THEN 3 END AS DOUBLE) AS segment_ord
FROM customer
""")
def ordinal_encode(spark, sf):
    """accent/case/space-insensitive ordinal map; unknown -> NULL."""
    c = table(spark, sf, "customer")
    seg = F.expr(DIRTY_SEGMENT)
    return c.select("c_custkey", seg.alias("segment"),
                    X.ordinal_encode(seg, SEGMENT_ORDINAL).alias("segment_ord"))


@register("coalesce_variants", """
SELECT o_orderkey,
       COALESCE(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END,
                CASE WHEN o_orderstatus <> 'P' THEN lower(o_orderpriority) END,
                concat('p-', o_orderpriority)) AS pedra
FROM orders
""")
def coalesce_variants(spark, sf):
    """Three year-suffixed variants collapse into one column, the
    left-most non-NULL winning; the variants disappear."""
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("pedra_20"),
        F.when(F.col("o_orderstatus") != "P", F.lower("o_orderpriority")).alias("pedra_21"),
        F.concat(F.lit("p-"), F.col("o_orderpriority")).alias("pedra_2022"))
    return S.unify_variants(o, "pedra")


@register("derive_gaps", "WITH " + PANEL_SQL + """,
first AS (SELECT id, MIN(ano) AS ano_ingresso FROM panel GROUP BY id)
SELECT p.id, p.ano, CAST(p.ano - f.ano_ingresso AS DOUBLE) AS tenure,
       CAST(p.ano - (1950 + c.c_nationkey) AS DOUBLE) AS idade,
       CAST(p.n_orders - p.n_urgent AS DOUBLE) AS gap
FROM panel p JOIN first f USING (id) JOIN customer c ON c.c_custkey = p.id
""")
def derive_gaps(spark, sf):
    """Age, tenure and gap as differences of coerced numbers."""
    from pyspark.sql import Window
    panel = orders_panel(spark, sf)
    # entry year = first period of the id (window over its <= #periods rows)
    first = panel.withColumn("ano_ingresso", F.min("ano").over(Window.partitionBy("id")))
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"),
                                               (F.lit(1950) + F.col("c_nationkey")).alias("ano_nasc"))
    j = first.join(cust, "id")
    return j.select("id", "ano",
                    X.diff("ano", "ano_ingresso").alias("tenure"),
                    X.diff("ano", "ano_nasc").alias("idade"),
                    X.diff("n_orders", "n_urgent").alias("gap"))


REC1 = "CASE WHEN o_orderstatus = 'F' THEN '  ' ELSE o_orderstatus END"
REC2 = "NULLIF(o_orderpriority, '5-LOW')"
REC3 = "CASE WHEN o_orderpriority LIKE '1%' THEN concat(chr(9), chr(10)) ELSE 'x' END"


@register("nonempty_count", f"""
SELECT o_orderkey, {nonempty(REC1)} + {nonempty(REC2)} + {nonempty(REC3)} AS rec_av_count
FROM orders
""")
def nonempty_count(spark, sf):
    """Row-wise count of non-blank columns."""
    o = table(spark, sf, "orders")
    return o.select("o_orderkey",
                    X.count_non_empty([F.expr(REC1), F.expr(REC2), F.expr(REC3)]).alias("rec_av_count"))


RAW_KEY = ("CASE event_type WHEN 'view' THEN ' Random-Forest ' WHEN 'click' THEN 'XGBoost' "
           "WHEN 'signup' THEN 'decision_tree' WHEN 'error' THEN 'Árvore de Decisão' "
           "ELSE 'gradient boosting' END")


@register("alias_normalise", f"""
SELECT event_id, {RAW_KEY} AS raw_key,
  CASE WHEN {RAW_KEY} IS NULL THEN 'default'
       WHEN {RAW_KEY} = 'Árvore de Decisão' THEN 'tree'
       WHEN {RAW_KEY} = 'XGBoost' THEN 'xgb'
       ELSE CASE trim(regexp_replace(translate(lower(trim({RAW_KEY})), '_-', '  '), '\\s+', ' ', 'g'))
         WHEN 'random forest' THEN 'rf' WHEN 'xgboost' THEN 'xgb' WHEN 'decision tree' THEN 'tree'
         WHEN 'logistic regression' THEN 'logreg' WHEN 'catboost' THEN 'cat' WHEN 'dummy' THEN 'dummy'
         END END AS model_key
FROM events
""")
def alias_normalise(spark, sf):
    """Display names and aliases -> canonical model key (unknown NULL)."""
    e = table(spark, sf, "events")
    raw = F.expr(RAW_KEY)
    return e.select("event_id", raw.alias("raw_key"), X.normalize_model_key(raw).alias("model_key"))


# Raw, messy period table built from the panel.  Each entry is an expression
# valid in both Spark SQL and DuckDB, and the dirty header it gets.
RAW_PANEL = [
    ("CAST(id AS STRING)", "RA"),
    ("ano", "ano"),
    ("CAST(n_orders AS STRING)", "Fase"),
    ("concat('Fase ', CAST(n_urgent AS STRING))", "Fase Ideal"),
    ("CAST(1990 + n_urgent AS STRING)", "Ano ingresso"),
    ("CAST(1950 + n_orders AS STRING)", "Data de Nasc"),
    ("CASE WHEN n_orders >= 3 THEN 'Ágata' END", "Pedra 20"),
    ("CASE WHEN n_urgent > 0 THEN '  TOPÁZIO ' ELSE 'Quartzo' END", "Pedra 21"),
    ("CAST(total_cents AS STRING)", "INDE 22"),
    ("'x'", "Destaque IPV"),
    ("'y'", "Avaliador1"),
    ("CASE WHEN n_urgent > 0 THEN ' sim ' ELSE '  ' END", "Rec Av1"),
    ("CASE WHEN n_orders > 2 THEN 'Nao' END", "Rec Av2"),
    ("'anon'", "Nome"),
    ("CAST(n_orders - 2 AS STRING)", "Defasagem"),
    ("concat(CAST(CAST(floor(total_cents / 100) AS BIGINT) AS STRING), ',', "
     "lpad(CAST(CAST(total_cents - 100 * floor(total_cents / 100) AS BIGINT) AS STRING), 2, '0'))", "Mat"),
    ("'99'", "Idade 22"),
    ("CAST(CASE WHEN n_orders = 2 THEN 10 ELSE 5 END AS STRING)", "IAN"),
    ("CASE WHEN n_urgent > 0 THEN 'Menina' ELSE ' Menino ' END", "Gênero"),
    ("CAST(n_urgent AS STRING)", "Nº Av"),
]

_RAW_SELECT = ", ".join(f'{e} AS "{n}"' for e, n in RAW_PANEL)
_PEDRA = 'COALESCE("Pedra 20", "Pedra 21")'


@register("clean_panel", "WITH " + PANEL_SQL + f""",
raw AS (SELECT {_RAW_SELECT} FROM panelx)
SELECT {t3('"RA"')} AS ra, ano,
       {t4('"Fase"')} AS fase,
       {t4(t3('"Fase Ideal"'))} AS fase_ideal,
       {t4('"Ano ingresso"')} AS ano_ingresso,
       {t4('"Data de Nasc"')} AS ano_nasc,
       {t3(_PEDRA)} AS pedra,
       {t3('"Rec Av1"')} AS rec_av1, {t3('"Rec Av2"')} AS rec_av2,
       {t4('"Defasagem"')} AS defas, {t4('"Mat"')} AS matem, {t4('"IAN"')} AS ian,
       {t3('"Gênero"')} AS genero, {t4('"Nº Av"')} AS no_av,
       CAST(ano AS DOUBLE) - {t4('"Data de Nasc"')} AS idade,
       CAST(NULL AS DOUBLE) AS ipp,
       CAST(ano AS DOUBLE) - {t4('"Ano ingresso"')} AS tenure,
       {t4('"Fase"')} - {t4(t3('"Fase Ideal"'))} AS gap_fase,
       CAST(CASE strip_accents(lower({t3(t3(_PEDRA))}))
            WHEN 'quartzo' THEN 0 WHEN 'agata' THEN 1 WHEN 'ametista' THEN 2
            WHEN 'topazio' THEN 3 END AS DOUBLE) AS pedra_ord,
       {nonempty(t3('"Rec Av1"'))} + {nonempty(t3('"Rec Av2"'))} AS rec_av_count
FROM raw
""")
def clean_panel(spark, sf):
    """The whole cleaning chain (names, synonyms, variants, drops,
    coercion, engineered features) over a messy panel, one narrow stage."""
    raw = orders_panel(spark, sf).selectExpr(*[f"{e} AS `{n}`" for e, n in RAW_PANEL])
    return C.clean_period(raw, "ano")
