"""Run registry and leaderboard as tables.

The reference keeps one JSON pointer file per model and a CSV leaderboard.
Here a run is a row of a ``runs`` table (appended, never rewritten), and
"latest per model", promotions and leaderboards are queries over it.
"Latest" uses ``max_by`` (a partial aggregate, so a model with a huge number
of runs is combined map-side) rather than a window over the whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import canonical_model_key, normalize_model_key, parse_model_from_path, parse_run_id

# Default leaderboard sort columns (first present wins) and
# the pointer keys tried in order.
DEFAULT_SORT_COLS = ("test_roc_auc", "test_f1", "test_precision", "test_recall", "threshold",
                     "model", "run_id", "metrics_path", "model_path")
POINTER_KEYS = ("model_path", "artifact_path", "path", "model", "latest_model_path")
DEFAULT_MODEL = "tree"  # the key that "default" resolves to
TOP_N_MAX = 1000


def record_run(runs_path: str, run: DataFrame) -> None:
    """Append run rows (partitioned by model) to the runs table."""
    run.write.mode("append").partitionBy("model").parquet(runs_path)


def trim_columns(df: DataFrame) -> DataFrame:
    """K5: strip blanks around column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def canonical_models(runs: DataFrame, col: str = "model") -> DataFrame:
    """T16 over a runs table; unknown keys keep NULL (caller decides)."""
    return runs.withColumn(col, normalize_model_key(F.col(col)))


def latest_per_model(runs: DataFrame, key: str = "model",
                     order: Sequence[str] = ("run_ts", "run_id")) -> DataFrame:
    """R2: newest run per model (ties by the later ``order`` columns).  A hash aggregate finds the
    greatest first ``order`` value of each model; only the rows that have it are compared whole."""
    newest = runs.groupBy(F.col(key).alias("_key")).agg(F.max(order[0]).alias("_newest"))
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col(order[0]).eqNullSafe(F.col("_newest"))
    few = runs.join(newest, same, "left_semi")
    cols = [c for c in runs.columns if c != key]
    picked = few.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r"))
    return picked.select(key, *[F.col(f"r.{c}").alias(c) for c in cols])


def resolve_model(latest: DataFrame, model_key: Column | str | None, key: str = "model") -> DataFrame:
    """R2: the latest run for a requested key (``None``/``default`` -> tree)."""
    req = normalize_model_key(F.lit(model_key) if not isinstance(model_key, Column) else model_key)
    req = F.when(req == "default", F.lit(DEFAULT_MODEL)).otherwise(req)
    return latest.where(F.col(key) == req)


def promote(runs: DataFrame, promotions: DataFrame, key: str = "model", on: str = "run_id") -> DataFrame:
    """Per model, the run with the latest effective time: a run's promotion time, or its own time
    if it was never promoted.  ``promotions`` has ``(key, on, promoted_at)``: run ids repeat between
    models, so a promotion names both.  Of several promotions of a run the newest counts."""
    if key not in promotions.columns:
        raise ValueError(f"promotions must name the {key!r} beside {on!r}")
    newest = promotions.groupBy(key, on).agg(F.max("promoted_at").alias("promoted_at"))
    p = runs.join(newest, on=[key, on], how="left")
    eff = F.coalesce(F.col("promoted_at"), F.col("run_ts"))
    return latest_per_model(p.withColumn("_eff", eff), key, ("_eff", "run_id")).drop("_eff")


def resolve_pointer(ptr: DataFrame, base_dir: Column | str, keys: Sequence[str] = POINTER_KEYS,
                    out: str = "resolved_path") -> DataFrame:
    """First non-blank candidate key; relative paths resolve against the
    pointer's folder; run id and model parsed from the file name (T20)."""
    present = [k for k in keys if k in ptr.columns]
    first = F.coalesce(*[F.nullif(F.trim(F.col(k)), F.lit("")) for k in present]) if present else F.lit(None)
    base = F.col(base_dir) if isinstance(base_dir, str) else base_dir
    path = (F.when(first.startswith("/"), first)
            .when(first.isNotNull(), F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), first)))
    return ptr.withColumns({out: path, "path_run_id": parse_run_id(first),
                            "path_model": parse_model_from_path(first)})


def _plain_path(path: Column) -> Column:
    """A path without ``.``, ``..`` and repeated or closing slashes."""
    none = F.array().cast("array<string>")
    parts = F.aggregate(F.split(path, "/"), none, lambda out, x: F.when(x.isin("", "."), out).when(
        x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, x)))
    return F.concat(F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))


def resolve_existing(ptr: DataFrame, base_dir: Column | str, existing: DataFrame, cwd: str,
                     keys: Sequence[str] = POINTER_KEYS, out: str = "resolved_path") -> DataFrame:
    """The first candidate that exists.  Candidates are the non-blank keys in order, a relative one
    first against ``cwd`` and then against the pointer's folder; ``existing`` has one column of absolute
    paths.  Pointers without one get NULL.  Run id and model are those of the path found (T20)."""
    present = [k for k in keys if k in ptr.columns]
    base = F.col(base_dir) if isinstance(base_dir, str) else base_dir
    base = F.when(base.startswith("/"), base).otherwise(F.concat(F.lit(f"{cwd}/"), base))
    tried = []
    for k in present:
        raw = F.nullif(F.trim(F.col(k)), F.lit(""))
        tried += [F.when(raw.startswith("/"), raw).otherwise(F.concat(F.lit(f"{cwd}/"), raw)),
                  F.when(~raw.startswith("/"), F.concat(base, F.lit("/"), raw))]
    numbered = ptr.withColumn("_ptr", F.monotonically_increasing_id())
    paths = F.transform(F.array(*tried), _plain_path) if tried else F.array().cast("array<string>")
    # one pass: a pointer's first candidate carries its row, so the ids are not joined back; keys without a
    # path are dropped, and a pointer without candidates joins by its own number, so no task gets all of them
    places = F.filter(F.transform(paths, lambda path, at: F.struct(at.alias("at"), path.alias("path"))),
                      lambda c: c.getField("path").isNotNull())
    row = F.struct(*[F.col(c) for c in ptr.columns])
    every = numbered.select("_ptr", row.alias("_row"), F.posexplode_outer(places).alias("_n", "_c")).select(
        "_ptr", F.when(F.coalesce("_n", F.lit(0)) == 0, F.col("_row")).alias("_row"), F.col("_c.at").alias("_at"),
        F.col("_c.path").alias("_path"), F.coalesce("_c.path", F.concat(F.lit("\0"), F.col("_ptr").cast("string"))).alias("_key"))
    there = existing.select(_plain_path(F.col(existing.columns[0])).alias("_key")).distinct() \
        .withColumn("_there", F.lit(True))
    found = every.join(there, "_key", "left").groupBy("_ptr").agg(
        F.first("_row", ignorenulls=True).alias("_row"), F.min_by("_path", F.when(F.col("_there"), F.col("_at"))).alias(out))
    return found.select(*[F.col(f"_row.{c}").alias(c) for c in ptr.columns], out,
                        parse_run_id(F.col(out)).alias("path_run_id"), parse_model_from_path(F.col(out)).alias("path_model"))


def leaderboard(board: DataFrame, top_n: int = 50, sort_by: str | None = None, order: str = "desc",
                model_key: str | None = None, key: str = "model",
                tie_break: Sequence[str] = ()) -> DataFrame:
    """K2/F2: optional model filter (after T16), validated sort column (else
    the first available default column, descending), ``top_n`` in 1..1000."""
    if not 1 <= int(top_n) <= TOP_N_MAX:
        raise ValueError(f"top_n must be in 1..{TOP_N_MAX}")
    if order not in ("asc", "desc"):
        raise ValueError("order must be 'asc' or 'desc'")
    df = board
    if model_key is not None and key in df.columns:
        df = df.where(normalize_model_key(F.col(key)) == F.lit(canonical_model_key(model_key)))
    if sort_by is not None:
        if sort_by not in df.columns:
            raise ValueError(f"invalid sort_by {sort_by!r}; available: {df.columns}")
        col, asc = sort_by, order == "asc"
    else:
        col = next((c for c in DEFAULT_SORT_COLS if c in df.columns), None)
        asc = False
    if col is None:
        return df.limit(int(top_n))
    first = F.asc_nulls_last(col) if asc else F.desc_nulls_last(col)
    return df.orderBy(first, *tie_break).limit(int(top_n))


def best_run(board: DataFrame, metrics: Sequence[str] = ("test_roc_auc", "test_f1"),
             tie_break: Sequence[str] = ("run_id",)) -> DataFrame:
    """K3: the single best row (global ``max_by`` over a struct key)."""
    cols = board.columns
    key = F.struct(*[F.coalesce(F.col(m), F.lit(float("-inf"))) for m in metrics], *[F.col(t) for t in tie_break])
    r = board.agg(F.max_by(F.struct(*cols), key).alias("r"))
    return r.select(*[F.col(f"r.{c}").alias(c) for c in cols])


def model_info(latest: DataFrame, key: str = "model") -> DataFrame:
    """Path, threshold (T18 fallback 0.5) and metadata keys per model; with the expected features and
    their number (M19) where the runs table records ``features``."""
    meta = sorted(c for c in latest.columns if c != key)
    thr = F.coalesce(F.col("threshold").cast("string").try_cast("double"), F.lit(0.5)) \
        if "threshold" in latest.columns else F.lit(0.5)
    path = F.coalesce(F.col("model_path"), F.lit("unknown")) if "model_path" in latest.columns else F.lit("unknown")
    out = [path.alias("model_path"), thr.alias("threshold")]
    if "features" in latest.columns:
        feats = F.coalesce(F.col("features"), F.array().cast("array<string>"))
        out += [F.size(feats).alias("n_features"), feats.alias("features")]
    return latest.select(key, *out, F.array(*[F.lit(m) for m in meta]).alias("meta_keys"))
