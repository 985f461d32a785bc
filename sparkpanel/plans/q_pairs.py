"""Step 1: temporal pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import target_not_equal
from ..operators import pairs as P
from ..operators import quality as Q
from .catalog import register
from .tables import (PAIRS_SQL, PANEL_ID, PANEL_PERIOD, PANEL_TARGET_VALUE, orders_panel, table)


def panel_pairs(spark, sf):
    panel = orders_panel(spark, sf)
    return P.all_pairs(panel, id_col=PANEL_ID, period_col=PANEL_PERIOD,
                       target=lambda d: target_not_equal(F.col("n_orders"), PANEL_TARGET_VALUE),
                       validate=False)  # the panel is an aggregate by (id, period)


@register("pair_dirty_ids", """
WITH t AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN '0' || o_orderkey
                       ELSE CAST(o_orderkey AS VARCHAR) END AS id, o_orderstatus AS status FROM orders),
t1 AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey END AS id, length(o_orderpriority) AS ian FROM orders)
SELECT t.id, CAST(2020 AS INTEGER) AS year_t, CAST(2021 AS INTEGER) AS year_t1,
       CASE WHEN t1.ian IS NOT DISTINCT FROM 10 THEN 0 ELSE 1 END AS y, t.status
FROM t JOIN t1 ON t.id = CAST(t1.id AS VARCHAR)
""")
def pair_dirty_ids(spark, sf):
    """Ids of different types compare as text; NULL ids pair with nothing."""
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    t = o.select(F.when(key % 7 == 0, None).when(key % 2 == 0, F.concat(F.lit("0"), key.cast("string")))
                 .otherwise(key.cast("string")).alias("id"), F.col("o_orderstatus").alias("status"))
    t1 = o.select(F.when(key % 5 != 0, key).alias("id"), F.length("o_orderpriority").alias("ian"))
    return P.temporal_pair(t, t1, 2020, 2021, id_col="id", validate=False)


@register("pair_all", "WITH " + PAIRS_SQL + " SELECT * FROM pairs")
def pair_all(spark, sf):
    """All consecutive (t, t+1) pairs of the panel in one join."""
    return panel_pairs(spark, sf)


@register("pair_single", """
WITH """ + PAIRS_SQL + """
SELECT id, year_t, year_t1, y, n_orders, n_urgent, total_cents, avg_price
FROM pairs WHERE year_t = 1997
""")
def pair_single(spark, sf):
    """One explicit pair (1997 -> 1998) from two period tables, with the
    reference's validation (unique ids per period, common ids >= 1)."""
    panel = orders_panel(spark, sf)
    t = panel.where(F.col(PANEL_PERIOD) == 1997)
    t1 = (panel.where(F.col(PANEL_PERIOD) == 1998)
          .select(PANEL_ID, PANEL_PERIOD, F.col("n_orders").alias("target_src")))
    return P.temporal_pair(t, t1, 1997, 1998, id_col=PANEL_ID, target_col="target_src",
                           target_value=PANEL_TARGET_VALUE, drop_feature_cols=(PANEL_PERIOD,))


@register("pair_target_rate", "WITH " + PAIRS_SQL + """
SELECT year_t, year_t1, COUNT(*) AS n_rows,
       CAST(SUM(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos,
       CAST(SUM(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg,
       CAST(SUM(CASE WHEN y IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null,
       round(AVG(CAST(y AS DOUBLE)), 9) AS pos_rate
FROM pairs GROUP BY year_t, year_t1
""")
def pair_target_rate(spark, sf):
    """A3+A4 per pair."""
    out = P.target_summary(panel_pairs(spark, sf))
    return out.withColumn("pos_rate", F.round("pos_rate", 9))


@register("pair_target_counts", "WITH " + PAIRS_SQL + """
SELECT year_t, y, COUNT(*) AS n FROM pairs GROUP BY year_t, y
""")
def pair_target_counts(spark, sf):
    """A3: target counts incl. NULL per pair."""
    return P.target_counts(panel_pairs(spark, sf))


@register("pair_check", "WITH " + PAIRS_SQL + """
SELECT COUNT(*) FILTER (WHERE y IS NULL OR y NOT IN (0, 1)) AS n_bad_target,
       COUNT(*) AS n_rows FROM pairs
""")
def pair_check(spark, sf):
    """pair has y, has no period column, y in {0,1}."""
    return Q.check_pair_table(panel_pairs(spark, sf))


@register("keep_common_ids", "WITH " + PAIRS_SQL.split(",\npairs AS")[0] + """
SELECT * FROM panelx a WHERE ano = 1999 AND EXISTS (SELECT 1 FROM panelx b WHERE b.ano = 2000 AND b.id = a.id)
""")
def keep_common_ids(spark, sf):
    """period-t rows whose id also appears in period t+1 (left-semi)."""
    panel = orders_panel(spark, sf)
    return P.keep_common_ids(panel.where(F.col(PANEL_PERIOD) == 1999),
                             panel.where(F.col(PANEL_PERIOD) == 2000), PANEL_ID)
