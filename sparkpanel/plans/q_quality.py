"""Step 2: id quality, coverage, common ids, basic stats, null profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from .catalog import register
from .tables import PAIRS_SQL, PANEL_ID, PANEL_PERIOD, orders_panel, table
from .q_pairs import panel_pairs


@register("id_quality", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS ano, COUNT(*) AS n_rows,
       COUNT(*) FILTER (WHERE o_custkey IS NULL) AS n_null_ids,
       COUNT(o_custkey) - COUNT(DISTINCT o_custkey) AS n_duplicate_ids
FROM orders GROUP BY 1
""")
def id_quality(spark, sf):
    """F4+F5 per period on the raw orders (customers repeat within a year,
    so duplicates are expected there)."""
    o = table(spark, sf, "orders").select(F.col("o_custkey"),
                                          F.year("o_orderdate").cast("int").alias("ano"))
    return Q.id_quality(o, "o_custkey", by=["ano"])


@register("id_coverage_by_period", """
WITH k AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS k, CAST(year(o_orderdate) AS INTEGER) AS p FROM orders),
per AS (SELECT p, COUNT(*) AS n FROM k GROUP BY p),
com AS (SELECT a.p, COUNT(*) AS n_common FROM k a JOIN k b ON a.k = b.k AND b.p = a.p + 1 GROUP BY a.p)
SELECT a.p AS year_t, CAST(a.p + 1 AS INTEGER) AS year_t1, a.n AS n_t, b.n AS n_t1,
       COALESCE(c.n_common, 0) AS n_common
FROM per a JOIN per b ON b.p = a.p + 1 LEFT JOIN com c ON c.p = a.p
""")
def id_coverage_by_period(spark, sf):
    """F6/A5 for every consecutive pair of periods in one job."""
    return Q.coverage_by_period(orders_panel(spark, sf), PANEL_ID, PANEL_PERIOD)


@register("common_ids", """
SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id FROM orders WHERE year(o_orderdate) = 1999
INTERSECT
SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id FROM orders WHERE year(o_orderdate) = 2000
""")
def common_ids(spark, sf):
    """Ids present in both periods (as strings)."""
    panel = orders_panel(spark, sf)
    a = panel.where(F.col(PANEL_PERIOD) == 1999)
    b = panel.where(F.col(PANEL_PERIOD) == 2000)
    return Q.common_ids(a, b, PANEL_ID)


@register("coverage_report", """
WITH a AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS k FROM orders WHERE year(o_orderdate) = 1995),
     b AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS k FROM orders WHERE year(o_orderdate) = 1996)
SELECT (SELECT COUNT(*) FROM a) AS n_t, (SELECT COUNT(*) FROM b) AS n_t1,
       (SELECT COUNT(*) FROM a JOIN b USING (k)) AS n_common
""")
def coverage_report(spark, sf):
    """one coverage row for a pair of period tables."""
    panel = orders_panel(spark, sf)
    return Q.coverage_report(panel.where(F.col(PANEL_PERIOD) == 1995),
                             panel.where(F.col(PANEL_PERIOD) == 1996), PANEL_ID)


@register("basic_stats", "WITH " + PAIRS_SQL + """
SELECT year_t, COUNT(*) AS n_rows, 8 AS n_cols,
       round((COUNT(*) FILTER (WHERE id IS NULL) + COUNT(*) FILTER (WHERE year_t IS NULL)
        + COUNT(*) FILTER (WHERE year_t1 IS NULL) + COUNT(*) FILTER (WHERE y IS NULL)
        + COUNT(*) FILTER (WHERE n_orders IS NULL) + COUNT(*) FILTER (WHERE n_urgent IS NULL)
        + COUNT(*) FILTER (WHERE total_cents IS NULL) + COUNT(*) FILTER (WHERE avg_price IS NULL))
        / (COUNT(*) * 8.0), 9) AS missing_rate,
       COUNT(*) FILTER (WHERE y = 0) AS n_y0, COUNT(*) FILTER (WHERE y = 1) AS n_y1,
       COUNT(*) FILTER (WHERE y IS NULL) AS n_y_null,
       round(AVG(CAST(y AS DOUBLE)), 9) AS pos_rate
FROM (SELECT id, year_t, year_t1, y, NULLIF(n_orders, 1) AS n_orders,
             NULLIF(n_urgent, 0) AS n_urgent, total_cents, avg_price FROM pairs) t
GROUP BY year_t
""")
def basic_stats(spark, sf):
    """A1-A4: rows, columns, mean missing rate, target counts, positive
    rate per pair (NULLs injected with NULLIF so the missing rate is real)."""
    pairs = (panel_pairs(spark, sf)
             .withColumn("n_orders", F.nullif("n_orders", F.lit(1)))
             .withColumn("n_urgent", F.nullif("n_urgent", F.lit(0))))
    out = Q.basic_stats(pairs, "y", by=["year_t"])
    return (out.withColumn("missing_rate", F.round("missing_rate", 9))
            .withColumn("pos_rate", F.round("pos_rate", 9)))


@register("null_profile", """
WITH d AS (
  SELECT d.doc_id, d.lang, l.quality, l.toxic, NULLIF(d.source, 'src0') AS source
  FROM documents d LEFT JOIN labels l USING (doc_id)
)
SELECT feature, n_rows, n_nonnull, n_rows - n_nonnull AS n_null, n_nonnull = 0 AS all_null FROM (
  SELECT 'doc_id' AS feature, COUNT(*) AS n_rows, COUNT(doc_id) AS n_nonnull FROM d
  UNION ALL SELECT 'lang', COUNT(*), COUNT(lang) FROM d
  UNION ALL SELECT 'quality', COUNT(*), COUNT(quality) FROM d
  UNION ALL SELECT 'toxic', COUNT(*), COUNT(toxic) FROM d
  UNION ALL SELECT 'source', COUNT(*), COUNT(source) FROM d
) t
""")
def null_profile(spark, sf):
    """Per-column non-null counts from one aggregate (documents left
    join labels gives real NULL labels)."""
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    d = (docs.join(labels, "doc_id", "left")
         .select("doc_id", "lang", "quality", "toxic",
                 F.nullif("source", F.lit("src0")).alias("source")))
    return Q.null_profile(d)


@register("nan_profile", """
SELECT 'l_quantity' AS feature, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE l_quantity >= 10) AS n_nonnull,
       COUNT(*) FILTER (WHERE l_quantity < 10 OR l_quantity IS NULL) AS n_null,
       COUNT(*) FILTER (WHERE l_quantity >= 10) = 0 AS all_null FROM lineitem
UNION ALL SELECT 'l_tax', COUNT(*), COUNT(*) - COUNT(*), COUNT(*), TRUE FROM lineitem
""")
def nan_profile(spark, sf):
    """NaN counts as missing."""
    li = table(spark, sf, "lineitem")
    nan = F.lit(float("nan"))
    return Q.null_profile(li.select(F.when(F.col("l_quantity") >= 10, F.col("l_quantity").cast("double")).otherwise(nan)
                                    .alias("l_quantity"), nan.alias("l_tax")))
