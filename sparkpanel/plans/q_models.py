"""Step 8: baselines, stratified folds, training, comparison, scoring."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ..operators import boosting as B
from ..operators import encoding as E
from ..operators import logistic as L
from ..operators import models as MD
from ..operators import scoring as SC
from ..operators import schema as S
from .catalog import register
from .q_pairs import panel_pairs
from .tables import PAIRS_SQL, table

R = 9
NUMERIC = ["n_orders", "n_urgent", "total_cents", "avg_price"]
CATEGORICAL = ["segment"]


def model_pairs(spark, sf):
    """Pairs plus the customer's market segment (a categorical feature)."""
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"),
                                               F.col("c_mktsegment").alias("segment"))
    return panel_pairs(spark, sf).join(cust, "id", "left")


def train_test(spark, sf):
    p = model_pairs(spark, sf)
    return p.where(F.col("year_t") == 1997), p.where(F.col("year_t") == 1998)


@register("dummy_prevalence", "WITH " + PAIRS_SQL + f"""
SELECT year_t, round(AVG(CAST(y AS DOUBLE)), {R}) AS prevalence FROM pairs GROUP BY year_t
""")
def dummy_prevalence(spark, sf):
    """The constant score of the prevalence dummy, trained on each pair of periods."""
    return MD.prevalence(panel_pairs(spark, sf), by=("year_t",)).withColumn("prevalence", F.round("prevalence", R))


@register("dummy_majority", "WITH " + PAIRS_SQL + """
SELECT year_t, min(y) AS majority FROM (
  SELECT year_t, y, COUNT(*) AS n, max(COUNT(*)) OVER (PARTITION BY year_t) AS mx FROM pairs GROUP BY year_t, y) t
WHERE n = mx GROUP BY year_t
""")
def dummy_majority(spark, sf):
    """Majority class (lowest on ties) of each pair of periods."""
    return MD.majority(panel_pairs(spark, sf), by=("year_t",))


@register("stratified_folds", "WITH " + PAIRS_SQL + """
SELECT year_t, y, CAST(f AS INTEGER) AS fold, CAST((n - f + 4) // 5 AS BIGINT) AS n
FROM (SELECT year_t, y, COUNT(*) AS n FROM pairs GROUP BY year_t, y) c, range(5) t(f) WHERE n > f
""")
def stratified_folds(spark, sf):
    """M9 folds of every pair of periods: fold sizes per class differ by at most one."""
    folds = MD.stratified_folds(panel_pairs(spark, sf), "y", "id", k=5, seed=42, by=("year_t",))
    return folds.groupBy("year_t", "y", "fold").agg(F.count(F.lit(1)).alias("n"))


@register("ordered_target_stats", "WITH " + PAIRS_SQL + f""",
r AS (SELECT p.id || '-' || p.year_t AS rid, c.c_mktsegment AS segment, p.y,
             CAST('0x' || substr(md5('42:' || p.id || '-' || p.year_t), 1, 13) AS BIGINT) AS pos
      FROM pairs p LEFT JOIN customer c ON c.c_custkey = p.id),
w AS (SELECT rid, sum(y) OVER o AS s, count(y) OVER o AS n FROM r
      WINDOW o AS (PARTITION BY segment ORDER BY pos RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT rid, round((coalesce(s, 0) + prior) / (n + 1.0), {R}) AS segment_ts
FROM w, (SELECT avg(CAST(y AS DOUBLE)) AS prior FROM pairs) t
""")
def ordered_target_stats(spark, sf):
    """M7 cat: each row's target statistic of its segment, from the rows before it in the random order."""
    rows = model_pairs(spark, sf).withColumn("rid", F.concat_ws("-", "id", "year_t"))
    out = E.ordered_target_stats(rows, ["segment"], "y", "rid", 42)
    return out.select("rid", F.round(f"segment{E.SUFFIX}", R).alias("segment_ts"))


_STUMP = dict(lr=0.05, l2=1.0, l1=0.1)


@register("boost_stump", "WITH " + PAIRS_SQL + """,
f AS (SELECT 0 AS k, CAST(n_orders AS DOUBLE) AS v, y FROM pairs UNION ALL SELECT 1, CAST(n_urgent AS DOUBLE), y FROM pairs),
c AS (SELECT k, v, sum(0.5 - y) AS g, count(*) * 0.25 AS h FROM f GROUP BY k, v),
s AS (SELECT k, v, sum(g) OVER o AS gl, sum(h) OVER o AS hl, sum(g) OVER (PARTITION BY k) AS ga, sum(h) OVER (PARTITION BY k) AS ha
      FROM c WINDOW o AS (PARTITION BY k ORDER BY v)),
t AS (SELECT k, v, gl, hl, ga - gl AS gr, ha - hl AS hr, ga, ha FROM s WHERE hl >= 1 AND ha - hl >= 1),
u AS (SELECT *, greatest(abs(gl) - {l1}, 0) ** 2 / (hl + {l2}) + greatest(abs(gr) - {l1}, 0) ** 2 / (hr + {l2})
                - greatest(abs(ga) - {l1}, 0) ** 2 / (ha + {l2}) AS gain FROM t)
SELECT CAST(k AS INTEGER) AS feature, v AS threshold, round(gain, 6) AS gain,
       round(-{lr} * sign(gl) * greatest(abs(gl) - {l1}, 0) / (hl + {l2}), {r}) AS left_value,
       round(-{lr} * sign(gr) * greatest(abs(gr) - {l1}, 0) / (hr + {l2}), {r}) AS right_value
FROM u WHERE gain > 0.000001 ORDER BY u.gain DESC, k, v LIMIT 1
""".format(r=R, **_STUMP))
def boost_stump(spark, sf):
    """M7 xgb: the first split of second-order boosting over all pairs, with both leaf penalties."""
    rows = VectorAssembler(inputCols=["n_orders", "n_urgent"], outputCol="features").transform(
        panel_pairs(spark, sf).withColumns({c: F.col(c).cast("double") for c in ("n_orders", "n_urgent")}))
    p = B.BoostParams(rounds=1, depth=1, learning_rate=_STUMP["lr"], reg_lambda=_STUMP["l2"], reg_alpha=_STUMP["l1"])
    trees, edges = B.fit_trees(rows, "features", "y", p)
    found = [(int(t.feature[0]), float(edges[t.feature[0]][t.bin[0]]), round(float(t.gain[0]), 6), round(float(t.value[1]), R),
              round(float(t.value[2]), R)) for t in trees if t.feature[0] >= 0]
    return spark.createDataFrame(found, "feature int, threshold double, gain double, left_value double, right_value double")


@register("logit_two_valued", "WITH " + PAIRS_SQL + """,
c AS (SELECT n_urgent > 0 AS u, sum(y) AS p, sum(1 - y) AS q FROM pairs GROUP BY 1)
SELECT round(ln(a.p / a.q) - ln(b.p / b.q), 5) AS coefficient, round(ln(b.p / b.q), 5) AS intercept
FROM c a, c b WHERE a.u AND NOT b.u
""")
def logit_two_valued(spark, sf):
    """M6: Newton steps on one two-valued feature, the penalty next to nothing: the log odds of both values."""
    rows = panel_pairs(spark, sf).select("y", (F.col("n_urgent") > 0).cast("double").alias("u"))
    rows = VectorAssembler(inputCols=["u"], outputCol="features").transform(rows)
    blocks = L.row_blocks(rows, "features", "y")
    v = L.solve(blocks, [L.Fit(1e9)])[0]
    blocks.unpersist()
    return spark.createDataFrame([(round(float(v[0]), 5), round(float(v[1]), 5))], "coefficient double, intercept double")


@register("train_baseline")
def train_baseline(spark, sf):
    """Temporal baseline job (align, drop all-NULL, balanced logistic
    regression, max-F1 threshold on train, metrics on train and test)."""
    train, test = train_test(spark, sf)
    test = test.drop("n_urgent").withColumn("extra_col", F.lit(1))
    return MD.run_train(train, test)


@register("compare_models")
def compare_models(spark, sf):
    """The quickly fitted models at their default settings, threshold by F1 on train, test
    metrics, leaderboard (``compare_rf``, ``compare_xgb`` and ``compare_cat`` give the rows of the others)."""
    train, test = train_test(spark, sf)
    return MD.compare(train, test, NUMERIC, CATEGORICAL, models=("dummy", "logreg", "tree"))


@register("compare_rf")
def compare_rf(spark, sf):
    """The leaderboard row of the random forest at the default 500 trees."""
    train, test = train_test(spark, sf)
    return MD.compare(train, test, NUMERIC, CATEGORICAL, models=("rf",))


@register("compare_xgb")
def compare_xgb(spark, sf):
    """The leaderboard row of second-order boosting at the default 500 rounds."""
    train, test = train_test(spark, sf)
    return MD.compare(train, test, NUMERIC, CATEGORICAL, models=("xgb",))


@register("compare_cat")
def compare_cat(spark, sf):
    """The leaderboard row of symmetric trees on target statistics at the default 800 rounds."""
    train, test = train_test(spark, sf)
    return MD.compare(train, test, NUMERIC, CATEGORICAL, models=("cat",))


_COUNTS = """, c AS (SELECT COUNT(*) FILTER (WHERE year_t = 1997) AS n, COUNT(*) FILTER (WHERE year_t = 1997 AND y = 1) AS p,
       COUNT(*) FILTER (WHERE year_t = 1998) AS tn, COUNT(*) FILTER (WHERE year_t = 1998 AND y = 1) AS tp FROM pairs)"""


@register("train_temporal_dummy", "WITH " + PAIRS_SQL + _COUNTS + f"""
SELECT round(CAST(p AS DOUBLE) / n, {R}) AS score, CAST(tn AS BIGINT) AS n,
       CAST(CASE WHEN CAST(p AS DOUBLE) / n >= 0.5 THEN tp ELSE 0 END AS BIGINT) AS tp,
       CAST(CASE WHEN CAST(p AS DOUBLE) / n >= 0.5 THEN tn - tp ELSE 0 END AS BIGINT) AS fp FROM c WHERE tn > 0
""")
def train_temporal_dummy(spark, sf):
    """A model fitted on one pair (the prevalence dummy) scored on the next at a fixed threshold."""
    train, test = train_test(spark, sf)
    fm = MD.fit(train, NUMERIC, CATEGORICAL, MD.ModelConfig("dummy", dummy_strategy="prevalence"))
    p = MD.predict(fm, test, 0.5)
    return p.groupBy(F.round("score", R).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("pred") == 1) & (F.col("y") == 1)).alias("tp"),
        F.count_if((F.col("pred") == 1) & (F.col("y") == 0)).alias("fp"))


# A logistic model with given weights: its scores have a closed form, so every row can be checked.
WEIGHTS = {"n_orders": 0.4, "n_urgent": -0.7, "avg_price": 0.000002}
INTERCEPT, THRESHOLD = -0.9, 0.45
_LOGIT = f"{INTERCEPT}" + "".join(f" + {w} * CAST({c} AS DOUBLE)" for c, w in WEIGHTS.items())
SCORE_SQL = f"CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + exp(-({_LOGIT})))"


def recorded_bundle(spark):
    """Save the logistic bundle and record two runs of it (an older one with another threshold); return the runs table."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer
    from ..operators.registry import record_run
    from ..session import scratch_path
    base = f"{scratch_path(spark, 'bundles')}-{uuid.uuid4().hex[:12]}"
    stage = SQLTransformer(statement=f"SELECT *, {SCORE_SQL} AS score FROM __THIS__")
    Pipeline(stages=[stage]).fit(spark.range(0)).write().save(f"{base}/model_logreg_20260101_000000")
    runs = spark.createDataFrame(
        [("logreg", "20260101_000000", f"{base}/model_logreg_20260101_000000", list(WEIGHTS), THRESHOLD, "2026-01-01 00:00:00"),
         ("logreg", "20250101_000000", "gone", list(WEIGHTS), 0.9, "2025-01-01 00:00:00")],
        "model string, run_id string, model_path string, features array<string>, threshold double, run_ts string")
    record_run(f"{base}/runs", runs.withColumn("run_ts", F.col("run_ts").cast("timestamp")))
    return spark.read.parquet(f"{base}/runs")


def _json_payload():
    feats = F.struct(*[F.col(c) for c in NUMERIC + CATEGORICAL])
    nested = F.to_json(F.struct(feats.alias("features")))
    flat = F.to_json(F.struct(*[F.col(c) for c in NUMERIC + CATEGORICAL], F.lit("tree").alias("model_key")))
    return F.when(F.col("n_urgent") > 0, nested).otherwise(flat)


@register("batch_score", "WITH " + PAIRS_SQL + f"""
SELECT id, round(s, {R}) AS score, CAST(s >= {THRESHOLD} AS INTEGER) AS pred
FROM (SELECT id, {SCORE_SQL} AS s FROM pairs)
""")
def batch_score(spark, sf):
    """JSON payloads (nested or flat) -> guards -> typed features -> the newest recorded model,
    at its recorded threshold; rejected rows carry a reason."""
    pairs = model_pairs(spark, sf)
    fm, threshold = MD.load_recorded(recorded_bundle(spark), "logistic regression")
    req = pairs.select("id", _json_payload().alias("payload"))
    g = SC.guard_payloads(req, "payload", NUMERIC + CATEGORICAL)
    types = {f.name: f.dataType for f in pairs.schema.fields}
    ok = SC.payload_to_columns(g.where(F.col("reject_reason").isNull()), fm.features, types, keep=["id"])
    scored = MD.predict(fm, ok, SC.resolve_threshold(None, threshold))
    return scored.select("id", F.round("score", R).alias("score"), "pred")


@register("evaluate_bundle", "WITH " + PAIRS_SQL + f"""
SELECT id, y AS y_true, round(s, {R}) AS y_score, CAST(s >= {THRESHOLD} AS INTEGER) AS y_pred
FROM (SELECT id, y, {SCORE_SQL} AS s FROM pairs)
""")
def evaluate_bundle(spark, sf):
    """Dataset + newest recorded model -> predictions (y_true, y_score, y_pred)."""
    fm, threshold = MD.load_recorded(recorded_bundle(spark), "logreg")
    p = MD.predict(fm, S.strict_select(panel_pairs(spark, sf), ["id", "y", *fm.features]), threshold)
    return p.select("id", F.col("y").alias("y_true"), F.round("score", R).alias("y_score"),
                    F.col("pred").alias("y_pred"))


def _tuned(spark, sf):
    from ..operators import features as FE
    train = train_test(spark, sf)[0].persist(StorageLevel.MEMORY_AND_DISK)  # read by each job of both steps
    try:
        pre = FE.fit_preprocessor(train, NUMERIC, CATEGORICAL)
        return MD.tune(train, [pre.model], MD.ModelConfig("logreg")).candidates
    finally:
        train.unpersist()


@register("tuning_folds", "WITH " + PAIRS_SQL + """
SELECT CAST(candidate AS INTEGER) AS candidate, CAST(5 AS INTEGER) AS n_folds
FROM range(10) t(candidate) WHERE EXISTS (SELECT 1 FROM pairs WHERE year_t = 1997)
""")
def tuning_folds(spark, sf):
    """M8/M9: all ten points of the logistic space, five folds each."""
    return _tuned(spark, sf).select("candidate", "n_folds")


@register("tuning_metrics")
def tuning_metrics(spark, sf):
    """M9: mean held-out ROC AUC, F1, precision and recall of every logistic candidate (fits: tested apart)."""
    return _tuned(spark, sf)
