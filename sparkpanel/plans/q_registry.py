"""Step 9: run registry, leaderboards, pointers (runs derived from events)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import normalize_model_key, run_id_from_ts
from ..operators import registry as RG
from .catalog import register
from .tables import table

RUN_KEY = ("CASE event_type WHEN 'view' THEN ' Random-Forest ' WHEN 'click' THEN 'XGBoost' "
           "WHEN 'signup' THEN 'decision_tree' WHEN 'error' THEN 'Logistic-Regression' ELSE 'CatBoost' END")


def runs(spark, sf):
    """One run per event: model from the messy key (T16), run id from the
    time (T19), metrics from the value and the JSON props."""
    e = table(spark, sf, "events")
    run_id = run_id_from_ts(F.col("ts"))
    model = normalize_model_key(F.expr(RUN_KEY))
    return e.select("event_id", "event_type", run_id.alias("run_id"), model.alias("model"),
                    F.col("ts").alias("run_ts"), (F.col("value") / 100.0).alias("threshold"),
                    (F.col("value") / 100.0).alias("test_roc_auc"),
                    (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("test_f1"),
                    F.concat(F.lit("artifacts/models/model_"), model, F.lit("_"), run_id,
                             F.lit(".joblib")).alias("model_path"))


RUNS_SQL = f"""runs AS (
  SELECT event_id, event_type, strftime(ts, '%Y%m%d_%H%M%S') AS run_id,
         CASE event_type WHEN 'view' THEN 'rf' WHEN 'click' THEN 'xgb' WHEN 'signup' THEN 'tree'
                         WHEN 'error' THEN 'logreg' ELSE 'cat' END AS model,
         ts AS run_ts, value / 100.0 AS threshold, value / 100.0 AS test_roc_auc,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0 AS test_f1,
         concat('artifacts/models/model_',
                CASE event_type WHEN 'view' THEN 'rf' WHEN 'click' THEN 'xgb' WHEN 'signup' THEN 'tree'
                                WHEN 'error' THEN 'logreg' ELSE 'cat' END,
                '_', strftime(ts, '%Y%m%d_%H%M%S'), '.joblib') AS model_path
  FROM events)"""
COLS = "event_id, event_type, run_id, model, run_ts, threshold, test_roc_auc, test_f1, model_path"


@register("leaderboard_top", f"""WITH {RUNS_SQL}
SELECT {COLS} FROM runs ORDER BY test_roc_auc DESC NULLS LAST, run_id, event_id LIMIT 10
""")
def leaderboard_top(spark, sf):
    """K2: validated sort column, descending, top 10 (a top-k report)."""
    return RG.leaderboard(runs(spark, sf), top_n=10, sort_by="test_roc_auc", order="desc",
                          tie_break=("run_id", "event_id"))


@register("leaderboard_filtered", f"""WITH {RUNS_SQL}
SELECT {COLS} FROM runs WHERE model = 'rf'
ORDER BY test_roc_auc DESC NULLS LAST, run_id, event_id LIMIT 50
""")
def leaderboard_filtered(spark, sf):
    """F2+K2: filter by a model given by its display name, default sort
    column (first available), top 50."""
    return RG.leaderboard(runs(spark, sf), top_n=50, model_key="Random Forest",
                          tie_break=("run_id", "event_id"))


@register("latest_run_per_model", f"""WITH {RUNS_SQL}
SELECT model, event_id, event_type, run_id, run_ts, threshold, test_roc_auc, test_f1, model_path FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY run_ts DESC, run_id DESC, event_id DESC) AS rn FROM runs) t
WHERE rn = 1
""")
def latest_run_per_model(spark, sf):
    """R2: newest run per model key (partial ``max_by``, skew-safe)."""
    return RG.latest_per_model(runs(spark, sf), "model", ("run_ts", "run_id", "event_id"))


@register("best_run", f"""WITH {RUNS_SQL}
SELECT {COLS} FROM runs ORDER BY test_roc_auc DESC, test_f1 DESC, run_id DESC, event_id DESC LIMIT 1
""")
def best_run(spark, sf):
    """K3: the single best run (AUC, then F1)."""
    return RG.best_run(runs(spark, sf), ("test_roc_auc", "test_f1"), ("run_id", "event_id"))


#: What each model's runs record as their features.
FEATURES = {"rf": ["n_orders", "avg_price"], "xgb": ["n_orders", "n_urgent", "total_cents"], "tree": [], "cat": ["segment"]}
FEATURES_SQL = "CASE model " + " ".join(f"WHEN '{m}' THEN {f!r}::VARCHAR[]" for m, f in FEATURES.items()) + " END"


@register("model_info", f"""WITH {RUNS_SQL},
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY run_ts DESC, run_id DESC, event_id DESC) AS rn FROM runs) t WHERE rn = 1)
SELECT model, model_path, COALESCE(TRY_CAST(CAST(threshold AS VARCHAR) AS DOUBLE), 0.5) AS threshold,
       CAST(len(COALESCE({FEATURES_SQL}, [])) AS INTEGER) AS n_features, array_to_string(COALESCE({FEATURES_SQL}, []), ',') AS features,
       ['event_id', 'event_type', 'features', 'model_path', 'run_id', 'run_ts', 'test_f1', 'test_roc_auc', 'threshold'] AS meta_keys
FROM latest
""")
def model_info(spark, sf):
    """Metadata and expected features of the latest run per model (threshold falls back to 0.5)."""
    named = F.create_map(*[x for m, f in FEATURES.items() for x in (F.lit(m), F.array(*[F.lit(c) for c in f]).cast("array<string>"))])
    latest = RG.latest_per_model(runs(spark, sf).withColumn("features", named[F.col("model")]), "model",
                                 ("run_ts", "run_id", "event_id"))
    return RG.model_info(latest).withColumn("features", F.array_join("features", ","))


@register("promoted_latest", f"""WITH {RUNS_SQL},
prom AS (SELECT event_id, run_ts + INTERVAL 40 DAY AS promoted_at FROM runs WHERE test_roc_auc >= 0.95),
p AS (SELECT r.*, prom.promoted_at, COALESCE(prom.promoted_at, r.run_ts) AS eff FROM runs r LEFT JOIN prom USING (event_id))
SELECT model, event_id, event_type, run_id, run_ts, threshold, test_roc_auc, test_f1, model_path, promoted_at FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY eff DESC, run_id DESC) AS rn FROM p) t WHERE rn = 1
""")
def promoted_latest(spark, sf):
    """Promotions override the newest run as the model's pointer."""
    r = runs(spark, sf)
    prom = (r.where(F.col("test_roc_auc") >= 0.95)
            .select("model", "event_id", (F.col("run_ts") + F.expr("INTERVAL 40 DAYS")).alias("promoted_at")))
    return RG.promote(r, prom, "model", on="event_id")


PTR_SQL = f"""WITH {RUNS_SQL},
ptr AS (SELECT event_id, model AS model_key, 'artifacts/models/' AS base_dir,
   CASE WHEN event_type IN ('view', 'signup') THEN '  ' ELSE concat('model_', model, '_', run_id, '.joblib') END AS model_path,
   CASE WHEN event_type = 'view' THEN concat('/srv/models/model_', model, '_', run_id, '.joblib') END AS artifact_path,
   CAST(NULL AS VARCHAR) AS path,
   CASE WHEN event_type = 'signup' THEN concat('latest/model_', model, '_', run_id, '.joblib') END AS latest_model_path
 FROM runs),
f AS (SELECT *, COALESCE(NULLIF(trim(model_path), ''), NULLIF(trim(artifact_path), ''), NULLIF(trim(path), ''),
                        NULLIF(trim(latest_model_path), '')) AS first_path FROM ptr)"""


def _pointers(spark, sf):
    r = runs(spark, sf)
    return r.select(
        "event_id", F.col("model").alias("model_key"), F.lit("artifacts/models/").alias("base_dir"),
        F.when(F.col("event_type").isin("view", "signup"), F.lit("  "))
         .otherwise(F.concat(F.lit("model_"), "model", F.lit("_"), "run_id", F.lit(".joblib"))).alias("model_path"),
        F.when(F.col("event_type") == "view",
               F.concat(F.lit("/srv/models/model_"), "model", F.lit("_"), "run_id", F.lit(".joblib"))).alias("artifact_path"),
        F.lit(None).cast("string").alias("path"),
        F.when(F.col("event_type").isin("signup", "view"),
               F.concat(F.lit("latest/model_"), "model", F.lit("_"), "run_id", F.lit(".joblib"))).alias("latest_model_path"))


#: The working folder, and the paths that exist: of each run the file in one of four places, by its id.
CWD = "/srv/work"
HELD = ("CASE event_id % 4 WHEN 0 THEN concat('/srv/models/model_', model, '_', run_id, '.joblib') "
        "WHEN 1 THEN concat('/srv/work/artifacts/models/model_', model, '_', run_id, '.joblib') "
        "WHEN 2 THEN concat('/srv/work/artifacts/models/latest/model_', model, '_', run_id, '.joblib') "
        "ELSE concat('/srv/work/model_', model, '_', run_id, '.joblib') END")


@register("pointer_resolve", PTR_SQL.replace("CASE WHEN event_type = 'signup' THEN concat('latest/", "CASE WHEN event_type IN ('signup', 'view') THEN concat('latest/")
          + f""",
held AS (SELECT DISTINCT {HELD} AS p FROM runs),
c AS (SELECT event_id, unnest([1, 2, 3]) AS k, unnest([model_path, artifact_path, latest_model_path]) AS raw FROM ptr),
t AS (SELECT event_id, 2 * k + w AS pos, CASE WHEN starts_with(trim(raw), '/') THEN trim(raw) WHEN w = 0 THEN concat('{CWD}/', trim(raw))
                                             ELSE concat('{CWD}/artifacts/models/', trim(raw)) END AS p
      FROM c, (SELECT unnest([0, 1]) AS w) x WHERE trim(raw) <> '' AND (w = 0 OR NOT starts_with(trim(raw), '/'))),
g AS (SELECT event_id, min_by(t.p, pos) AS p FROM t JOIN held ON held.p = t.p GROUP BY event_id)
SELECT ptr.event_id, g.p AS resolved_path,
       NULLIF(regexp_extract(g.p, 'model_([a-z]+)_(\\d{{8}}_\\d{{6}})', 2), '') AS path_run_id,
       NULLIF(regexp_extract(g.p, 'model_([a-z]+)_(\\d{{8}}_\\d{{6}})', 1), '') AS path_model
FROM ptr LEFT JOIN g USING (event_id)
""")
def pointer_resolve(spark, sf):
    """Of each pointer the first candidate that exists, against the working folder, then the
    pointer's; run id and model parsed from the path found."""
    held = runs(spark, sf).select(F.expr(HELD).alias("p")).distinct()
    out = RG.resolve_existing(_pointers(spark, sf), "base_dir", held, CWD)
    return out.select("event_id", "resolved_path", "path_run_id", "path_model")
