"""Classification metrics.

Scale notes
-----------
* Confusion counts, precision/recall/F1 and threshold sweeps are single
  aggregates with map-side combine; a sweep buckets every row by the number
  of grid thresholds ``<= score`` (a CASE chain in generated code) and only
  ``len(grid) + 1`` groups leave each task.
* ROC AUC is exact (Mann-Whitney with ties) and distributed: rows are first
  combined per distinct score, then ``ranking.prefix_sums`` gives the
  negatives below each score without putting all scores into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import grid_bucket
from .ranking import prefix_sums

# The two threshold grids of the reference.
TUNING_GRID = tuple(float(x) for x in np.round(np.arange(0.05, 0.96, 0.05), 2))


def float_step_grid(start: float = 0.05, stop: float = 0.95, step: float = 0.01) -> tuple[float, ...]:
    """Grid made by repeated float addition while ``t <= stop + 1e-12``
    (its 2nd value is 0.060000000000000005)."""
    out, t = [], start
    while t <= stop + 1e-12:
        out.append(float(t))
        t += step
    return tuple(out)


F1_GRID = float_step_grid()


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def _rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    return {"precision": _safe_div(tp, tp + fp), "recall": _safe_div(tp, tp + fn),
            "f1": _safe_div(2 * tp, 2 * tp + fp + fn)}


# ------------------------------------------------------------------ A13/A14
def confusion_matrix(df: DataFrame, y: str = "y", pred: str = "pred",
                     by: Sequence[str] = ()) -> DataFrame:
    """Labels fixed to [0, 1]; ``matrix`` = [[tn, fp], [fn, tp]]."""
    yc, pc = F.col(y), F.col(pred)
    out = df.groupBy(*by).agg(F.count_if((yc == 0) & (pc == 0)).alias("tn"),
                              F.count_if((yc == 0) & (pc == 1)).alias("fp"),
                              F.count_if((yc == 1) & (pc == 0)).alias("fn"),
                              F.count_if((yc == 1) & (pc == 1)).alias("tp"))
    return out.withColumn("matrix", F.array(F.array("tn", "fp"), F.array("fn", "tp")))


# ------------------------------------------------------------------ A17
def score_table(df: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = (),
                n_ranges: int | None = None) -> DataFrame:
    """Per distinct score: ``pos``, ``neg`` and ``neg_below`` (negatives with a
    strictly smaller score in the same group), via distributed prefix sums."""
    by = list(by)
    base = df.where(F.col(y).isNotNull() & F.col(score).isNotNull())
    g = (base.groupBy(*by, score)
         .agg(F.sum(F.col(y).cast("long")).alias("pos"),
              F.sum((1 - F.col(y)).cast("long")).alias("neg")))
    st = prefix_sums(g, by, score, ["neg"], n_ranges)
    return st.withColumnRenamed("neg_before", "neg_below")


def _auc_expr() -> Column:
    # pairs are counted in decimals: their number outgrows a long from a few billion rows a class
    big = "decimal(38,0)"
    P, N = F.sum("pos"), F.sum("neg")
    num = F.sum((F.col("pos").cast("decimal(19,0)") * (2 * F.col("neg_below") + F.col("neg")).cast("decimal(19,0)")).cast(big))
    return F.when((P > 0) & (N > 0), num.cast("double") / 2 / P.cast("double") / N.cast("double"))


def roc_auc(df: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = (),
            n_ranges: int | None = None) -> DataFrame:
    """Exact ROC AUC per group; NULL when a group has one class (Q17)."""
    st = score_table(df, y, score, by, n_ranges)
    return st.groupBy(*by).agg(_auc_expr().alias("roc_auc"))


# ------------------------------------------------------------------ M12
def metrics_at(df: DataFrame, y: str = "y", score: str = "score", threshold: float | Column = 0.5,
               by: Sequence[str] = (), n_ranges: int | None = None) -> DataFrame:
    """Threshold, support, confusion counts, accuracy, precision,
    recall, F1 and ROC AUC in one result, computed from the per-score table."""
    st = score_table(df, y, score, by, n_ranges)
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit = F.col(score) >= thr
    agg = st.groupBy(*by).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        _auc_expr().alias("roc_auc"))
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("pos") - tp, F.col("neg") - fp
    r = _rates(tp, fp, fn)
    return agg.select(*by, thr.cast("double").alias("threshold"),
                      (F.col("pos") + F.col("neg")).alias("n"), "pos", "neg",
                      tn.alias("tn"), fp.alias("fp"), fn.alias("fn"), tp.alias("tp"),
                      _safe_div(tp + tn, F.col("pos") + F.col("neg")).alias("accuracy"),
                      r["precision"].alias("precision"), r["recall"].alias("recall"),
                      r["f1"].alias("f1"), "roc_auc")


# ------------------------------------------------------------------ sweeps
def threshold_sweep(df: DataFrame, y: str = "y", score: str = "score",
                    grid: Sequence[float] = TUNING_GRID, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and rates for every grid threshold in ONE pass.

    Rows are grouped by ``k = #{t in grid : t <= score}`` (map-side
    combined, at most ``len(grid)+1`` groups); the counts at threshold
    ``t_k`` are sums over buckets ``>= k``, taken in one small aggregate over
    those bucket rows and unpivoted to one row per threshold."""
    g = sorted(float(t) for t in grid)
    by = list(by)
    base = df.where(F.col(y).isNotNull() & F.col(score).isNotNull())
    counts = (base.groupBy(*by, grid_bucket(F.col(score), g).alias("k"))
              .agg(F.sum(F.col(y).cast("long")).alias("pos_k"),
                   F.sum((1 - F.col(y)).cast("long")).alias("neg_k")))
    aggs = [F.sum("pos_k").alias("P"), F.sum("neg_k").alias("N")]
    for k in range(1, len(g) + 1):
        hit = F.col("k") >= k
        aggs += [F.sum(F.when(hit, F.col("pos_k")).otherwise(0)).alias(f"tp{k}"),
                 F.sum(F.when(hit, F.col("neg_k")).otherwise(0)).alias(f"fp{k}")]
    wide = counts.groupBy(*by).agg(*aggs)
    stack = ", ".join(f"CAST({t!r} AS DOUBLE), tp{k}, fp{k}" for k, t in enumerate(g, start=1))
    long = wide.selectExpr(*[f"`{b}`" for b in by], "P", "N",
                           f"stack({len(g)}, {stack}) AS (threshold, tp, fp)")
    tp, fp = F.col("tp").cast("long"), F.col("fp").cast("long")
    fn, tn = F.col("P") - tp, F.col("N") - fp
    r = _rates(tp, fp, fn)
    return long.select(*by, "threshold", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
                       r["precision"].alias("precision"), r["recall"].alias("recall"), r["f1"].alias("f1"))


def pick_threshold(df: DataFrame, y: str = "y", score: str = "score",
                   grid: Sequence[float] = TUNING_GRID, objective: str = "recall",
                   min_precision: float | None = 0.5, min_recall: float | None = None,
                   tie_tol: float = 1e-6, by: Sequence[str] = ()) -> DataFrame:
    """Maximise F1 or recall subject to minimum precision/recall; a tie
    within ``tie_tol`` moves to the LARGER threshold; nothing feasible ->
    threshold 0.5 with NULL rates.  The sequential rule runs as an
    ``aggregate`` over the (bounded) sweep rows of each group."""
    if objective not in ("f1", "recall"):
        raise ValueError("objective must be 'f1' or 'recall'")
    sw = threshold_sweep(df, y, score, grid, by)
    feas = F.lit(True)
    if min_precision is not None:
        feas = feas & (F.col("precision") >= F.lit(float(min_precision)))
    if min_recall is not None:
        feas = feas & (F.col("recall") >= F.lit(float(min_recall)))
    sw = sw.withColumn("feasible", feas).withColumn("score", F.col(objective))
    items = F.array_sort(F.collect_list(F.struct("threshold", "score", "precision", "recall", "f1", "feasible")))
    init = F.struct(F.lit(0.5).alias("threshold"), F.lit(float("-inf")).alias("score"),
                    F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"),
                    F.lit(None).cast("double").alias("f1"), F.lit(True).alias("feasible"))
    tol = F.lit(float(tie_tol))

    def step(acc, x):
        better = x["score"] > acc["score"] + tol
        tie = F.abs(x["score"] - acc["score"]) <= tol
        take = x["feasible"] & (better | (tie & (x["threshold"] > acc["threshold"])))
        return F.when(take, x).otherwise(acc)

    best = sw.groupBy(*by).agg(F.aggregate(items, init, step).alias("b"))
    return best.select(*by, F.col("b.threshold").alias("threshold"),
                       F.when(F.col("b.score") > float("-inf"), F.col("b.score")).alias("score"),
                       F.col("b.precision").alias("precision"), F.col("b.recall").alias("recall"),
                       F.col("b.f1").alias("f1"))


def choose_threshold_max_f1(df: DataFrame, y: str = "y", score: str = "score",
                            grid: Sequence[float] = F1_GRID, by: Sequence[str] = ()) -> DataFrame:
    """Largest F1 on the 0.01-step grid; ties keep the SMALLER threshold."""
    sw = threshold_sweep(df, y, score, grid, by)
    return sw.groupBy(*by).agg(
        F.max_by("threshold", F.struct(F.col("f1"), -F.col("threshold"))).alias("threshold"),
        F.max("f1").alias("f1"))


def with_labels(df: DataFrame, score: str = "score", threshold: float | Column = 0.5,
                out: str = "pred") -> DataFrame:
    """T13."""
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return df.withColumn(out, (F.col(score) >= thr).cast("int"))
