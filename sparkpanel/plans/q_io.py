"""Sources, sinks and whole jobs: each query writes a table derived from the test tables in the shared
scratch folder and gives what the readers or jobs make of it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import jobs
from ..operators import models as MD
from ..operators import scoring as SC
from ..session import scratch_path
from ..sources import io
from .catalog import register
from .q_drift import ALL, CUT, LINE_COLS, R, _TABLE_SQL, _sides, _split
from .q_models import CATEGORICAL, NUMERIC, SCORE_SQL, _json_payload, model_pairs, recorded_bundle
from .q_pairs import panel_pairs
from .tables import PAIRS_SQL, table


def _fresh(spark, name: str) -> str:
    return f"{scratch_path(spark, name)}-{uuid.uuid4().hex[:12]}"


@register("csv_quoted", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, md5(replace(text, chr(13) || chr(10), chr(10))) AS text_md5, length(replace(text, chr(13) || chr(10), chr(10))) AS n_chars
FROM documents WHERE text IS NOT NULL AND trim(text) NOT IN ('', 'NA', 'NaN', 'nan', 'null', 'NULL', 'None', 'n/a', 'N/A')
""")
def csv_quoted(spark, sf):
    """Whole texts with quotes, separators and line breaks, written as quoted CSV and read in splits."""
    path = _fresh(spark, "quoted")
    (table(spark, sf, "documents").select("doc_id", "lang", "text").write
     .options(header=True, sep=";", quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
              emptyValue='""').csv(path))
    back = io.read_csv_strings(spark, path).filter("text is not null")
    return back.select("doc_id", "lang", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


_BACK_SQL = "WITH " + PAIRS_SQL + " SELECT id, year_t, year_t1, y, n_orders, n_urgent, total_cents FROM pairs"
_BACK = ["id", "year_t", "year_t1", "y", "n_orders", "n_urgent", "total_cents"]


def _same_types(df, like):
    return df.select(*[F.col(c).cast(like.schema[c].dataType).alias(c) for c in _BACK])


@register("csv_gz_round_trip", _BACK_SQL)
def csv_gz_round_trip(spark, sf):
    """Pairs written as ``;`` CSV with gzip, found by their stem and read with lossless types."""
    base, pairs = _fresh(spark, "gz"), panel_pairs(spark, sf).select(*_BACK)
    io.write_table(pairs, f"{base}/pairs.csv.gz", fmt="csv", compression="gzip")
    return _same_types(io.read_first_available(spark, base, "pairs"), pairs)


@register("periods_round_trip", _BACK_SQL)
def periods_round_trip(spark, sf):
    """One Parquet table for each period, loaded again as one panel."""
    base, pairs = _fresh(spark, "periods"), panel_pairs(spark, sf).select(*_BACK)
    io.write_table(pairs, base, partition_by=["year_t"])
    years = [r["year_t"] for r in pairs.select("year_t").distinct().collect()]  # a handful
    back = io.load_periods(spark, {y: f"{base}/year_t={y}" for y in years}, "year_t", reader=lambda p: io.read_parquet(spark, p))
    return _same_types(back, pairs)


@register("train_test_round_trip", "WITH " + PAIRS_SQL + """
SELECT 'train' AS side, COUNT(*) AS n, CAST(SUM(y) AS BIGINT) AS n_pos, CAST(SUM(total_cents) AS BIGINT) AS cents FROM pairs WHERE year_t = 1997
UNION ALL SELECT 'test', COUNT(*), CAST(SUM(y) AS BIGINT), CAST(SUM(total_cents) AS BIGINT) FROM pairs WHERE year_t = 1998
""")
def train_test_round_trip(spark, sf):
    """Both pair tables written, loaded together and summed up (a pair of tables is the feature)."""
    base, pairs = _fresh(spark, "train-test"), panel_pairs(spark, sf)
    for name, year in (("train", 1997), ("test", 1998)):
        io.write_table(pairs.filter(F.col("year_t") == year), f"{base}/{name}.parquet")
    both = io.load_train_test(spark, f"{base}/train.parquet", f"{base}/test.parquet")
    sums = [df.agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("n_pos"), F.sum("total_cents").cast("long").alias("cents"))
            .select(F.lit(side).alias("side"), "*") for side, df in zip(("train", "test"), both)]
    return sums[0].unionByName(sums[1])


@register("drift_job_history", _TABLE_SQL + f"""
SELECT t.feature, t.kind, round(t.score, {R}) AS score, t.status, t.n_ref, t.n_cur,
       (SELECT CASE WHEN COUNT(*) FILTER (WHERE status = 'alert') > 0 THEN 'alert'
                    WHEN COUNT(*) FILTER (WHERE status = 'warn') > 0 THEN 'warn' ELSE 'ok' END FROM tbl) AS run_status
FROM tbl t
""")
def drift_job_history(spark, sf):
    """The drift job twice under one id and once under another; the newest run's rows, one each."""
    base = _fresh(spark, "drift-job")
    for name, side in zip(("ref", "cur"), _sides(spark, sf)):
        io.write_table(side, f"{base}/{name}.parquet")
    args = (spark, f"{base}/ref.parquet", f"{base}/cur.parquet", f"{base}/history")
    for run in ("run_a", "run_b", "run_b"):
        status = jobs.drift_job(*args, run_id=run)
    out = jobs.latest_drift(spark, f"{base}/history").filter("run_id = 'run_b'")
    return out.select("feature", "kind", F.round("score", R).alias("score"), "status", "n_ref", "n_cur", F.lit(status).alias("run_status"))


OVERRIDE = 0.3


@register("threshold_override", "WITH " + PAIRS_SQL + f"""
SELECT id, round(s, 9) AS score, CAST(s >= CASE WHEN n_orders > 2 THEN {OVERRIDE} ELSE 0.45 END AS INTEGER) AS pred
FROM (SELECT id, n_orders, {SCORE_SQL} AS s FROM pairs)
""")
def threshold_override(spark, sf):
    """Scoring with a threshold in some payloads ('invalid' in others), the recorded one elsewhere."""
    fm, recorded = MD.load_recorded(recorded_bundle(spark), "logreg")
    pairs = model_pairs(spark, sf)
    asked = F.when(F.col("n_orders") > 2, F.lit(str(OVERRIDE))).when(F.col("n_orders") > 1, F.lit("invalid"))
    req = pairs.select("id", _json_payload().alias("payload"), asked.alias("threshold"))
    g = SC.guard_payloads(req, "payload", NUMERIC + CATEGORICAL).where(F.col("reject_reason").isNull())
    types = {f.name: f.dataType for f in pairs.schema.fields}
    ok = SC.payload_to_columns(g, fm.features, types, keep=["id", "threshold"])
    at = SC.threshold_column(F.col("threshold"), F.lit(recorded))
    return MD.predict(fm, ok, at).select("id", F.round("score", 9).alias("score"), "pred")


@register("train_job_selected", "WITH " + PAIRS_SQL + f""",
c AS (SELECT COUNT(*) FILTER (WHERE year_t = 1997) AS n, COUNT(*) FILTER (WHERE year_t = 1997 AND y = 1) AS p,
      COUNT(*) FILTER (WHERE year_t = 1998) AS tn, COUNT(*) FILTER (WHERE year_t = 1998 AND y = 1) AS tp FROM pairs)
SELECT 'n_orders,segment' AS features, 0.6::DOUBLE AS threshold, CAST(tn AS BIGINT) AS n,
       CAST(CASE WHEN p / n >= 0.6 THEN tp ELSE 0 END AS BIGINT) AS tp, CAST(CASE WHEN p / n >= 0.6 THEN tn - tp ELSE 0 END AS BIGINT) AS fp
FROM c WHERE tn > 0
""")
def train_job_selected(spark, sf):
    """The train job with a chosen model, a feature list and a fixed threshold; what it recorded."""
    base, pairs = _fresh(spark, "train-job"), model_pairs(spark, sf)
    for name, year in (("train", 1997), ("test", 1998)):
        io.write_table(pairs.filter(F.col("year_t") == year), f"{base}/{name}.parquet")
    row = jobs.train_job(spark, f"{base}/train.parquet", f"{base}/test.parquet", f"{base}/artifacts",
                         cfg=MD.ModelConfig("dummy", dummy_strategy="prevalence"), feature_set="selected",
                         variables=["n_orders", "segment"], threshold=0.6, y="y", id_col="id")
    return row.select(F.array_join("features", ",").alias("features"), "threshold", "n", "tp", "fp")
