"""Step 5: confusion matrix, metrics at a threshold, ROC AUC, sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from .catalog import register
from .tables import table

R = 9  # decimals kept for floating outputs


def scored(spark, sf):
    """Truth = returned line, score = quantity / 50, group = line status."""
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.col("l_linestatus").alias("grp"),
                     (F.col("l_returnflag") == "R").cast("int").alias("y"),
                     (F.col("l_quantity") / F.lit(50.0)).alias("score"))


SCORED = """scored AS (
  SELECT l_orderkey, l_linenumber, l_linestatus AS grp, CAST(l_returnflag = 'R' AS INTEGER) AS y,
         l_quantity / 50.0 AS score FROM lineitem)"""


def labelled_docs(spark, sf):
    """Truth = quality label, score = n_chars / (n_chars + 2000)."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.select("doc_id", F.col("quality").alias("y"),
                    (F.col("n_chars") / (F.col("n_chars") + F.lit(2000.0))).alias("score"))


DOCS = """scored AS (
  SELECT doc_id, quality AS y, n_chars / (n_chars + 2000.0) AS score
  FROM documents JOIN labels USING (doc_id))"""


def _rounded(df, cols):
    return df.withColumns({c: F.round(c, R) for c in cols})


def grid_sql(grid) -> str:
    return "[" + ", ".join(repr(float(t)) for t in grid) + "]::DOUBLE[]"


def sweep_sql(grid, src: str = SCORED) -> str:
    return f"""WITH {src},
g AS (SELECT unnest({grid_sql(grid)}) AS threshold),
c AS (SELECT threshold,
        COUNT(*) FILTER (WHERE score >= threshold AND y = 1) AS tp,
        COUNT(*) FILTER (WHERE score >= threshold AND y = 0) AS fp,
        COUNT(*) FILTER (WHERE score < threshold AND y = 1) AS fn,
        COUNT(*) FILTER (WHERE score < threshold AND y = 0) AS tn
      FROM g, scored WHERE y IS NOT NULL AND score IS NOT NULL GROUP BY threshold),
sw AS (SELECT threshold, tp, fp, fn, tn,
        CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
        CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
        CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1
      FROM c)"""


@register("confusion_matrix", f"""
WITH {SCORED}, p AS (SELECT y, CAST(score >= 0.5 AS INTEGER) AS pred FROM scored)
SELECT COUNT(*) FILTER (WHERE y = 0 AND pred = 0) AS tn, COUNT(*) FILTER (WHERE y = 0 AND pred = 1) AS fp,
       COUNT(*) FILTER (WHERE y = 1 AND pred = 0) AS fn, COUNT(*) FILTER (WHERE y = 1 AND pred = 1) AS tp,
       [[COUNT(*) FILTER (WHERE y = 0 AND pred = 0), COUNT(*) FILTER (WHERE y = 0 AND pred = 1)],
        [COUNT(*) FILTER (WHERE y = 1 AND pred = 0), COUNT(*) FILTER (WHERE y = 1 AND pred = 1)]] AS matrix
FROM p
""")
def confusion_matrix(spark, sf):
    """2x2 confusion matrix at threshold 0.5."""
    return M.confusion_matrix(M.with_labels(scored(spark, sf), "score", 0.5), "y", "pred")


_AUC_SQL = """
s AS (SELECT grp, score, SUM(y) AS pos, SUM(1 - y) AS neg FROM scored GROUP BY grp, score),
r AS (SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY grp ORDER BY score
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM s)"""


@register("roc_auc", f"""
WITH {SCORED}, {_AUC_SQL}
SELECT grp, round(CASE WHEN SUM(pos) > 0 AND SUM(neg) > 0 THEN
   SUM(CAST(pos AS DOUBLE) * (nb + 0.5 * CAST(neg AS DOUBLE))) / (CAST(SUM(pos) AS DOUBLE) * CAST(SUM(neg) AS DOUBLE)) END, {R}) AS roc_auc
FROM r GROUP BY grp
""")
def roc_auc(spark, sf):
    """Exact AUC with ties per line status (distributed prefix sums)."""
    return _rounded(M.roc_auc(scored(spark, sf), "y", "score", by=["grp"]), ["roc_auc"])


@register("threshold_metrics", f"""
WITH {SCORED.replace('l_linestatus AS grp', "'all' AS grp")}, {_AUC_SQL},
a AS (SELECT SUM(pos) AS pos, SUM(neg) AS neg,
        SUM(CASE WHEN score >= 0.5 THEN pos ELSE 0 END) AS tp,
        SUM(CASE WHEN score >= 0.5 THEN neg ELSE 0 END) AS fp,
        SUM(CAST(pos AS DOUBLE) * (nb + 0.5 * CAST(neg AS DOUBLE))) / (CAST(SUM(pos) AS DOUBLE) * CAST(SUM(neg) AS DOUBLE)) AS auc
      FROM r)
SELECT 0.5::DOUBLE AS threshold, CAST(pos + neg AS BIGINT) AS n, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg,
       CAST(neg - fp AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(pos - tp AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp,
       round((tp + neg - fp) / (pos + neg), {R}) AS accuracy,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, {R}) AS precision,
       round(CASE WHEN pos > 0 THEN tp / pos ELSE 0 END, {R}) AS recall,
       round(CASE WHEN 2 * tp + fp + pos - tp > 0 THEN 2 * tp / (2 * tp + fp + pos - tp) ELSE 0 END, {R}) AS f1,
       round(auc, {R}) AS roc_auc
FROM a
""")
def threshold_metrics(spark, sf):
    """All metrics at threshold 0.5 from one per-score table."""
    m = M.metrics_at(scored(spark, sf), "y", "score", 0.5)
    return _rounded(m, ["accuracy", "precision", "recall", "f1", "roc_auc"])


@register("threshold_sweep", sweep_sql(M.TUNING_GRID) + f"""
SELECT threshold, tp, fp, fn, tn, round(precision, {R}) AS precision, round(recall, {R}) AS recall,
       round(f1, {R}) AS f1 FROM sw
""")
def threshold_sweep(spark, sf):
    """Confusion counts for the 19-value grid in one pass."""
    sw = M.threshold_sweep(scored(spark, sf), "y", "score", M.TUNING_GRID)
    return _rounded(sw, ["precision", "recall", "f1"])


def _pick_sql(grid, src, objective, feasible):
    return sweep_sql(grid, src) + f""",
cand AS (SELECT threshold, {objective} AS score, precision, recall, f1 FROM sw WHERE {feasible}
         ORDER BY score DESC, threshold DESC LIMIT 1)
SELECT threshold, round(score, {R}) AS score, round(precision, {R}) AS precision,
       round(recall, {R}) AS recall, round(f1, {R}) AS f1 FROM cand
UNION ALL
SELECT 0.5::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE
WHERE NOT EXISTS (SELECT 1 FROM cand)
"""


@register("pick_threshold_f1", _pick_sql(M.TUNING_GRID, SCORED, "f1", "true"))
def pick_threshold_f1(spark, sf):
    """M10 as used by model comparison: maximise F1, no constraints."""
    p = M.pick_threshold(scored(spark, sf), "y", "score", M.TUNING_GRID, objective="f1",
                         min_precision=None, min_recall=None)
    return _rounded(p, ["score", "precision", "recall", "f1"])


@register("pick_threshold_recall", _pick_sql(M.TUNING_GRID, DOCS, "recall", "precision >= 0.5"))
def pick_threshold_recall(spark, sf):
    """M10 defaults: maximise recall with precision >= 0.5; ties -> larger."""
    p = M.pick_threshold(labelled_docs(spark, sf), "y", "score", M.TUNING_GRID,
                         objective="recall", min_precision=0.5)
    return _rounded(p, ["score", "precision", "recall", "f1"])


@register("pick_threshold_infeasible", _pick_sql(M.TUNING_GRID, SCORED, "recall", "precision >= 0.5"))
def pick_threshold_infeasible(spark, sf):
    """M10 fallback: no threshold reaches precision 0.5 -> 0.5 and NULLs."""
    p = M.pick_threshold(scored(spark, sf), "y", "score", M.TUNING_GRID,
                         objective="recall", min_precision=0.5)
    return _rounded(p, ["score", "precision", "recall", "f1"])


@register("choose_threshold_max_f1", sweep_sql(M.F1_GRID, DOCS) + f"""
SELECT threshold, round(f1, {R}) AS f1 FROM sw ORDER BY f1 DESC, threshold ASC LIMIT 1
""")
def choose_threshold_max_f1(spark, sf):
    """91-step float grid, max F1, ties -> smaller threshold."""
    c = M.choose_threshold_max_f1(labelled_docs(spark, sf), "y", "score")
    return _rounded(c, ["f1"])
