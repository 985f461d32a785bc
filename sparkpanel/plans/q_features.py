"""Step 7: imputation constants, vocabulary and the fitted preprocessor."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import features as FE
from .catalog import register
from .q_pairs import panel_pairs
from .tables import PAIRS_SQL, table

R = 6

# Order-level feature table: a numeric column with NULLs, two categoricals
# (one with NULLs) and a category that only appears in later years.
ORDER_FEATS = [
    ("o_orderkey", "o_orderkey"),
    ("CAST(year(o_orderdate) AS INTEGER)", "yr"),
    ("CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END", "price"),
    ("CASE WHEN year(o_orderdate) >= 2000 AND o_orderpriority = '5-LOW' THEN '9-NEW' ELSE o_orderpriority END", "priority"),
    ("NULLIF(o_orderstatus, 'P')", "status"),
    ("CASE WHEN o_totalprice > 150000 THEN 'hi' ELSE 'lo' END", "band"),
]
ORDER_FEATS_SQL = "ofe AS (SELECT " + ", ".join(f"{e} AS {n}" for e, n in ORDER_FEATS) + " FROM orders)"


def order_features(spark, sf):
    return table(spark, sf, "orders").selectExpr(*[f"{e} AS {n}" for e, n in ORDER_FEATS])


PAIR_NULLS_SQL = "WITH " + PAIRS_SQL + """,
pn AS (SELECT NULLIF(n_orders, 1) AS n_orders, NULLIF(n_urgent, 0) AS n_urgent, total_cents, avg_price FROM pairs)"""


@register("impute_median", PAIR_NULLS_SQL + f"""
SELECT feature, round(median, {R}) AS median FROM (
  SELECT 'n_orders' AS feature, CAST(quantile_cont(n_orders, 0.5) AS DOUBLE) AS median FROM pn
  UNION ALL SELECT 'n_urgent', CAST(quantile_cont(n_urgent, 0.5) AS DOUBLE) FROM pn
  UNION ALL SELECT 'total_cents', CAST(quantile_cont(total_cents, 0.5) AS DOUBLE) FROM pn
  UNION ALL SELECT 'avg_price', CAST(quantile_cont(avg_price, 0.5) AS DOUBLE) FROM pn) t
""")
def impute_median(spark, sf):
    """Exact (interpolated) median per numeric feature, one aggregate."""
    p = (panel_pairs(spark, sf).withColumn("n_orders", F.nullif("n_orders", F.lit(1)))
         .withColumn("n_urgent", F.nullif("n_urgent", F.lit(0))))
    m = FE.median_table(p, ["n_orders", "n_urgent", "total_cents", "avg_price"])
    return m.withColumn("median", F.round("median", R))


CATS = ["priority", "status", "band"]
_MODE_SQL = "WITH " + ORDER_FEATS_SQL + """,
l AS (SELECT 'priority' AS feature, priority AS v FROM ofe WHERE yr <= 1997
      UNION ALL SELECT 'status', status FROM ofe WHERE yr <= 1997
      UNION ALL SELECT 'band', band FROM ofe WHERE yr <= 1997),
c AS (SELECT feature, v, COUNT(*) AS n FROM l WHERE v IS NOT NULL GROUP BY ALL),
md AS (SELECT feature, min(v) AS mode FROM (SELECT *, max(n) OVER (PARTITION BY feature) AS mx FROM c) t
       WHERE n = mx GROUP BY feature)"""


@register("impute_mode", _MODE_SQL + " SELECT feature, mode FROM md")
def impute_mode(spark, sf):
    """Most frequent value per categorical feature, lowest on ties."""
    train = order_features(spark, sf).where(F.col("yr") <= 1997)
    return FE.mode_table(train, CATS)


@register("onehot_long", _MODE_SQL + """,
imp AS (SELECT 'priority' AS feature, COALESCE(priority, (SELECT mode FROM md WHERE feature = 'priority')) AS category FROM ofe WHERE yr <= 1997
        UNION ALL SELECT 'status', COALESCE(status, (SELECT mode FROM md WHERE feature = 'status')) FROM ofe WHERE yr <= 1997
        UNION ALL SELECT 'band', COALESCE(band, (SELECT mode FROM md WHERE feature = 'band')) FROM ofe WHERE yr <= 1997)
SELECT feature, category, COUNT(*) AS n,
       CAST(row_number() OVER (PARTITION BY feature ORDER BY category) - 1 AS INTEGER) AS idx
FROM imp GROUP BY feature, category
""")
def onehot_long(spark, sf):
    """A10: the fitted one-hot vocabulary (alphabetical slots) with counts,
    after mode imputation."""
    train = order_features(spark, sf).where(F.col("yr") <= 1997)
    fills = FE.fit_constants(train, [], CATS)
    return FE.vocabulary(train, CATS, fills)


@register("preprocess_fit_transform", _MODE_SQL + f""",
med AS (SELECT quantile_cont(price, 0.5) AS m FROM ofe WHERE yr <= 1997),
voc AS (SELECT feature, list(category ORDER BY category) AS cats FROM (
          SELECT DISTINCT 'priority' AS feature, COALESCE(priority, (SELECT mode FROM md WHERE feature = 'priority')) AS category FROM ofe WHERE yr <= 1997
          UNION ALL SELECT DISTINCT 'status', COALESCE(status, (SELECT mode FROM md WHERE feature = 'status')) FROM ofe WHERE yr <= 1997) t
        GROUP BY feature),
te AS (SELECT o_orderkey, COALESCE(price, (SELECT m FROM med)) AS price,
              COALESCE(priority, (SELECT mode FROM md WHERE feature = 'priority')) AS priority,
              COALESCE(status, (SELECT mode FROM md WHERE feature = 'status')) AS status
       FROM ofe WHERE yr >= 1998)
SELECT o_orderkey, list_transform(list_concat([price],
         list_transform((SELECT cats FROM voc WHERE feature = 'priority'), lambda c: CASE WHEN priority = c THEN 1.0 ELSE 0.0 END),
         list_transform((SELECT cats FROM voc WHERE feature = 'status'), lambda c: CASE WHEN status = c THEN 1.0 ELSE 0.0 END)),
       lambda x: round(CAST(x AS DOUBLE), {R})) AS features
FROM te
""")
def preprocess_fit_transform(spark, sf):
    """M1-M4: fit impute + one-hot on the early years, transform the later
    years (unseen category -> all zeros)."""
    of = order_features(spark, sf)
    train, test = of.where(F.col("yr") <= 1997), of.where(F.col("yr") >= 1998)
    pre = FE.fit_preprocessor(train, ["price"], ["priority", "status"])
    out = FE.transform_features(test, pre)
    arr = F.transform(vector_to_array(F.col("features")), lambda x: F.round(x, R))
    return out.select("o_orderkey", arr.alias("features"))
