"""Bindings of the operators to the driver's test tables.

The reference's yearly student tables are not shipped, so its data model is
derived from the TPC-H-style tables: an ``orders`` panel keyed by customer
and order year, dirty strings made from prices and documents, a binary truth
with a score from ``lineitem``, and a run registry from ``events``.  Every
derived table is a lazy plan over the given parquet files, so its size grows
with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import read_parquet

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


# Panel: one row per (customer, order year).  The amount is kept in integer
# cents so every engine sums it exactly.
PANEL_ID = "id"
PANEL_PERIOD = "ano"
PANEL_FEATURES = ("n_orders", "n_urgent", "total_cents", "avg_price")
PANEL_TARGET_VALUE = 2  # y = 0 when the customer places exactly 2 orders in t+1


def orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100)
    p = (o.groupBy(F.col("o_custkey").alias(PANEL_ID),
                   F.year("o_orderdate").cast("int").alias(PANEL_PERIOD))
         .agg(F.count(F.lit(1)).alias("n_orders"),
              F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"),
              F.sum(cents).cast("long").alias("total_cents")))
    return p.withColumn("avg_price", F.col("total_cents") / F.col("n_orders") / F.lit(100.0))


PANEL_SQL = """
panel AS (
  SELECT o_custkey AS id, CAST(year(o_orderdate) AS INTEGER) AS ano,
         COUNT(*) AS n_orders,
         COUNT(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent,
         CAST(SUM(round(o_totalprice * 100)) AS BIGINT) AS total_cents
  FROM orders GROUP BY 1, 2
), panelx AS (
  SELECT *, total_cents / n_orders / 100.0 AS avg_price FROM panel
)"""

PAIRS_SQL = PANEL_SQL + """,
pairs AS (
  SELECT a.id, a.ano AS year_t, CAST(a.ano + 1 AS INTEGER) AS year_t1,
         CASE WHEN b.n_orders IS NOT DISTINCT FROM 2 THEN 0 ELSE 1 END AS y,
         a.n_orders, a.n_urgent, a.total_cents, a.avg_price
  FROM panelx a JOIN panelx b ON a.id = b.id AND b.ano = a.ano + 1
)"""


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary truth + score: returned lines vs quantity / 50."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     (F.col("l_returnflag") == "R").cast("int").alias("y"),
                     (F.col("l_quantity") / F.lit(50.0)).alias("score"))


SCORED_SQL = """
scored AS (
  SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'R' AS INTEGER) AS y,
         l_quantity / 50.0 AS score
  FROM lineitem
)"""
