"""Models on ``pyspark.ml``.

``tree`` and ``rf`` are fitted by ``pyspark.ml``, ``logreg`` by exact Newton
steps (``logistic``), ``xgb`` by second-order histogram boosting and ``cat`` by
symmetric trees on ordered target statistics (``boosting``, ``encoding``).  The
driver loops over the (at most six) model keys and holds sums of a model's size
and one-row metric reports.
"""

from __future__ import annotations

import random
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir, scratch_path
from . import boosting as B
from . import encoding as E
from . import features as FE
from . import logistic as L
from . import metrics as M
from .scoring import score as score_with

MODEL_KEYS = ("dummy", "logreg", "tree", "rf", "xgb", "cat")


@dataclass(frozen=True)
class ModelConfig:
    """The reference's default hyper-parameters."""
    name: str
    seed: int = 42
    lr_max_iter: int = 2000
    lr_c: float = 1.0
    dt_max_depth: int | None = None
    dt_min_leaf: int = 1
    dt_balanced: bool = True
    rf_trees: int = 500
    rf_max_depth: int | None = None
    rf_min_leaf: int = 1
    rf_balanced: bool = True
    xgb_trees: int = 500
    xgb_lr: float = 0.05
    xgb_depth: int = 4
    xgb_subsample: float = 0.9
    xgb_colsample: float = 0.9
    xgb_reg_lambda: float = 1.0
    xgb_reg_alpha: float = 0.0
    cat_iterations: int = 800
    cat_lr: float = 0.05
    cat_depth: int = 6
    cat_l2_leaf_reg: float = 3.0
    dummy_strategy: str = "majority"


SPARK_MAX_DEPTH = 30  # Spark trees cap depth at 30; "unlimited" maps here


def _depth(d: int | None) -> int:
    if d is not None and int(d) > SPARK_MAX_DEPTH:
        raise ValueError(f"Spark trees are at most {SPARK_MAX_DEPTH} deep; depth {d} was asked for")
    return SPARK_MAX_DEPTH if d is None else int(d)


# ------------------------------------------------------------------ caching
def _cache(df: DataFrame) -> tuple[DataFrame, bool]:
    """Persist for the duration of a call unless the caller already did;
    the flag says whether this call owns (and must release) the cache."""
    from pyspark import StorageLevel
    lvl = df.storageLevel
    if lvl.useMemory or lvl.useDisk:
        return df, False
    return df.persist(StorageLevel.MEMORY_AND_DISK), True


# ------------------------------------------------------------------ weights
MAX_CLASSES = 100  # more label values than this are an error


def class_counts(df: DataFrame, y: str = "y") -> dict[int, int]:
    rows = df.groupBy(y).agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"column {y!r} is no class label: more than {MAX_CLASSES} values")
    return {int(r[y]): int(r["n"]) for r in rows if r[y] is not None}


def balanced_weight(counts: dict[int, int], y: str = "y") -> Column:
    """'balanced' class weight n / (n_classes * n_class) as a column."""
    n, k = sum(counts.values()), max(len(counts), 1)
    expr = F.lit(1.0)
    for cls, c in counts.items():
        expr = F.when(F.col(y) == cls, F.lit(n / (k * c))).otherwise(expr)
    return expr


# ------------------------------------------------------------------ factory
FOREST_MEMORY_MB = 1024  # node statistics of one pass over the rows; more means fewer passes for a forest
FOREST_TASK_ROWS = 1 << 16  # rows that one task of a forest's pass holds


def build_classifier(cfg: ModelConfig, features_col: str = "features", label: str = "y",
                     weight_col: str | None = None):
    """M7: the ``pyspark.ml`` estimator of ``tree`` and ``rf``.  A forest keeps each row's node in every tree:
    without them each pass would send all trees grown so far to every task."""
    common = dict(featuresCol=features_col, labelCol=label, seed=cfg.seed)
    if cfg.name == "tree":
        est = DecisionTreeClassifier(maxDepth=_depth(cfg.dt_max_depth), minInstancesPerNode=cfg.dt_min_leaf, **common)
    elif cfg.name == "rf":
        est = RandomForestClassifier(numTrees=cfg.rf_trees, maxDepth=_depth(cfg.rf_max_depth),
                                     minInstancesPerNode=cfg.rf_min_leaf, featureSubsetStrategy="sqrt",
                                     maxMemoryInMB=FOREST_MEMORY_MB, cacheNodeIds=True, **common)
    else:
        raise ValueError(f"{cfg.name} is not a pyspark.ml estimator")
    if weight_col:
        est.setWeightCol(weight_col)
    return est


def boost_params(cfg: ModelConfig) -> B.BoostParams:
    """M7: the settings of ``xgb`` and ``cat``."""
    if cfg.name == "xgb":
        return B.BoostParams(cfg.xgb_trees, cfg.xgb_lr, cfg.xgb_depth, cfg.xgb_subsample, cfg.xgb_colsample,
                             cfg.xgb_reg_lambda, cfg.xgb_reg_alpha, seed=cfg.seed)
    if cfg.name == "cat":
        return B.BoostParams(cfg.cat_iterations, cfg.cat_lr, cfg.cat_depth, reg_lambda=cfg.cat_l2_leaf_reg,
                             min_child_weight=0.0, symmetric=True, seed=cfg.seed)
    raise ValueError(f"{cfg.name} is not a boosted model")


def cat_stages(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], y: str, id_col: str, seed: int,
               path: str | None = None) -> tuple[DataFrame, list, list[str], list[str]]:
    """The features of ``cat``: imputed numbers and target statistics of the categories.  Gives the rows to
    fit on (each row's statistics from the rows before it), the stages that score other rows (statistics of
    all rows), and the features in use."""
    fills = FE.fit_constants(train, numeric, categorical)
    num = [c for c in numeric if fills.get(c) is not None]
    cat = [c for c in categorical if fills.get(c) is not None]
    impute = FE.impute_stage(num, cat, fills)
    inputs = [f"{c}{FE.IMP}" for c in [*num, *cat]]
    whole = impute.transform(train)
    names = [f"{c}{FE.IMP}" for c in cat]
    assemble = VectorAssembler(inputCols=[f"{c}{E.SUFFIX}" if c in names else c for c in inputs], outputCol="features",
                               handleInvalid="keep")
    if not names:
        return assemble.transform(whole), [impute, assemble], num, cat
    key = id_col if id_col in train.columns else None
    if key is None:
        whole, key = whole.withColumn("_own", F.xxhash64(*[q_name(c) for c in inputs])), "_own"
    ordered = E.ordered_target_stats(whole, names, y, key, seed)
    return assemble.transform(ordered), [impute, E.statistics_stage(whole, names, y, path=path), assemble], num, cat


def q_name(c: str) -> Column:
    return F.col(f"`{c}`")


def fit_stage(data: DataFrame, cfg: ModelConfig, y: str, id_col: str | None = None, weight: Column | None = None):
    """The fitted last stage of a model on rows with a ``features`` vector."""
    if cfg.name in ("xgb", "cat"):
        key = F.xxhash64(q_name(id_col).cast("string")) if id_col in data.columns else None
        return B.fit(data, "features", y, boost_params(cfg), weight, key)
    if cfg.name == "logreg":
        rdd = L.row_blocks(data, "features", y, weight=weight)
        try:
            return L.as_model(data.sparkSession, L.solve(rdd, [L.Fit(cfg.lr_c)], max_iter=cfg.lr_max_iter)[0], label=y)
        finally:
            rdd.unpersist()
    if weight is not None:
        data = data.withColumn("w_fit", weight)
    if cfg.name == "rf":
        data = _forest_tasks(data)
    return build_classifier(cfg, label=y, weight_col=None if weight is None else "w_fit").fit(data)


def _forest_tasks(data: DataFrame) -> DataFrame:
    """Rows in no more partitions than the cores or the rows need: every partition adds its own statistics of
    all nodes to each pass."""
    checkpoint_dir(data.sparkSession)  # kept nodes are checkpointed, as their lineage grows with the passes
    parts = max(2 * data.sparkSession.sparkContext.defaultParallelism, -(-data.count() // FOREST_TASK_ROWS))
    return data.coalesce(parts)


def constant_model(p: float, score_col: str = "score") -> PipelineModel:
    """A11/A12 baselines as a persistable transformer emitting a constant."""
    stage = SQLTransformer(statement=f"SELECT *, CAST({float(p)!r} AS DOUBLE) AS `{score_col}` FROM __THIS__")
    return Pipeline(stages=[stage]).fit(_empty_frame())


def _empty_frame():
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession().range(0)


def prevalence(df: DataFrame, y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Train prevalence (mean target), of each group."""
    return df.groupBy(*by).agg(F.avg(F.col(y).cast("double")).alias("prevalence"))


def majority(df: DataFrame, y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Majority class (lowest on ties), of each group."""
    return df.groupBy(*by).agg(F.mode(F.col(y), True).alias("majority"))


# ------------------------------------------------------------------ folds
FOLD_ROWS = 50_000  # rows that one task ranks


def stratified_folds(df: DataFrame, y: str = "y", id_col: str = "id", k: int = 5, seed: int = 42,
                     n_ranges: int | None = None, fold_col: str = "fold", by: Sequence[str] = ()) -> DataFrame:
    """M9 folds: within each class (of each group ``by``), rows ordered by ``xxhash64(id, seed)``
    (id breaks ties) are dealt round-robin into ``k`` folds, so fold sizes
    differ by at most one per class.

    The per-class rank is computed without a single-task window: the hash
    space is cut into ``n_ranges`` equal ranges (uniform because the hash
    is; by default one for each ``FOLD_ROWS`` rows), the rows before each range come from a
    prefix over the small (class, range) count table, and ``row_number`` runs inside a range."""
    if n_ranges is None:
        n_ranges = 1 + df.count() // FOLD_ROWS
    h = F.xxhash64(F.col(id_col).cast("string"), F.lit(int(seed)))
    rng = F.least(F.floor((h.cast("double") / F.lit(9.223372036854775807e18) + 1.0) * (n_ranges / 2.0)),
                  F.lit(n_ranges - 1)).cast("int")
    base = df.withColumn("_h", h).withColumn("_r", rng)
    classes = [*by, y]
    tot = base.groupBy(*classes, "_r").agg(F.count(F.lit(1)).alias("_n"))
    wprev = Window.partitionBy(*classes).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumn("_off", F.coalesce(F.sum("_n").over(wprev), F.lit(0))).drop("_n")
    win = Window.partitionBy(*classes, "_r").orderBy("_h", id_col)
    ranked = base.withColumn("_rn", F.row_number().over(win))
    out = ranked.join(tot, on=[*classes, "_r"], how="inner")
    return (out.withColumn(fold_col, F.pmod(F.col("_off") + F.col("_rn") - 1, F.lit(k)).cast("int"))
            .drop("_h", "_r", "_rn", "_off"))


# ------------------------------------------------------------------ search spaces
def param_space(name: str) -> dict[str, list]:
    """M8: the reference's search spaces (sklearn names)."""
    # The search space of each model key.
    return {
        "logreg": {"C": [0.01, 0.1, 1.0, 3.0, 10.0], "class_weight": [None, "balanced"]},
        "tree": {"max_depth": [None, 3, 5, 8, 12, 20], "min_samples_leaf": [1, 2, 5, 10],
                 "class_weight": [None, "balanced"]},
        "rf": {"n_estimators": [300, 500, 800], "max_depth": [None, 6, 10, 16, 24],
               "min_samples_leaf": [1, 2, 5, 10], "class_weight": [None, "balanced"]},
        "xgb": {"n_estimators": [300, 600, 900], "learning_rate": [0.01, 0.05, 0.1],
                "max_depth": [3, 4, 6, 8], "subsample": [0.7, 0.85, 1.0],
                "colsample_bytree": [0.7, 0.85, 1.0], "reg_lambda": [0.5, 1.0, 2.0],
                "reg_alpha": [0.0, 0.1, 0.5]},
        "cat": {"iterations": [400, 800, 1200], "learning_rate": [0.01, 0.05, 0.1],
                "depth": [4, 6, 8, 10], "l2_leaf_reg": [1.0, 3.0, 10.0]},
        "dummy": {},
    }[name]


def sample_space(space: dict[str, list], n_iter: int = 25, seed: int = 42) -> list[dict]:
    """Seeded sample of min(n_iter, |grid|) distinct grid points."""
    import itertools
    keys = sorted(space)
    grid = [dict(zip(keys, vals)) for vals in itertools.product(*[space[k] for k in keys])]
    if len(grid) <= n_iter:
        return grid
    return random.Random(seed).sample(grid, n_iter)


def at_point(cfg: ModelConfig, point: dict) -> tuple[ModelConfig, bool]:
    """The settings with a search point's values, and whether its classes are balanced."""
    names = {"logreg": {"C": "lr_c"},
             "tree": {"max_depth": "dt_max_depth", "min_samples_leaf": "dt_min_leaf"},
             "rf": {"n_estimators": "rf_trees", "max_depth": "rf_max_depth", "min_samples_leaf": "rf_min_leaf"},
             "xgb": {"n_estimators": "xgb_trees", "learning_rate": "xgb_lr", "max_depth": "xgb_depth",
                     "subsample": "xgb_subsample", "colsample_bytree": "xgb_colsample", "reg_lambda": "xgb_reg_lambda",
                     "reg_alpha": "xgb_reg_alpha"},
             "cat": {"iterations": "cat_iterations", "learning_rate": "cat_lr", "depth": "cat_depth",
                     "l2_leaf_reg": "cat_l2_leaf_reg"}}[cfg.name]
    return replace(cfg, **{names[k]: v for k, v in point.items() if k != "class_weight"}), point.get("class_weight") == "balanced"


TUNING_METRICS = ("roc_auc", "f1", "precision", "recall")


@dataclass
class TuningConfig:
    n_splits: int = 5
    n_iter: int = 25
    seed: int = 42
    parallelism: int = 4
    refit: str = "roc_auc"


@dataclass
class TuningResult:
    """The refitted best model, its point and score, and one row a candidate (mean metrics over the folds)."""
    best_model: PipelineModel
    best_params: dict
    best_score: float
    candidates: DataFrame
    n_fits: int


def tune(train: DataFrame, pre_stages: list, cfg: ModelConfig, y: str = "y", id_col: str = "id",
         tcfg: TuningConfig = TuningConfig(),
         prepare: Callable[[DataFrame], tuple[DataFrame, list]] | None = None) -> TuningResult:
    """M9: seeded random search over stratified folds; every candidate gets the mean ROC AUC, F1,
    precision and recall (at 0.5) of its folds, and the best by ``refit`` is fitted again on all rows.

    ``logreg`` fits all candidates and folds together (one pass a Newton step); other models
    fit ``parallelism`` at a time, each distributed.  The class weights of a fit are those of its rows.
    ``prepare`` (rows to fit on, and stages for other rows) is applied to each fit's own rows, for features
    that use the target."""
    if tcfg.refit not in TUNING_METRICS:
        raise ValueError(f"refit must be one of {TUNING_METRICS}")
    points = sample_space(param_space(cfg.name), tcfg.n_iter, tcfg.seed)
    data = stratified_folds(train, y, id_col, tcfg.n_splits, tcfg.seed)
    for stage in pre_stages:
        data = stage.transform(data)
    data, owned = _cache(data)
    try:
        if cfg.name == "logreg":
            per_fold, refit, n_fits = _tune_together(data, cfg, points, y)
        else:
            per_fold, refit, n_fits = _tune_apart(data, cfg, points, y, id_col, tcfg, prepare)
        rows = _mean_rows(per_fold, points)
        at = 3 + TUNING_METRICS.index(tcfg.refit)
        best = max(rows, key=lambda r: (r[at] if r[at] is not None else float("-inf"), -r[0]))
        model = PipelineModel(stages=[*pre_stages, refit(best[0])])
    finally:
        if owned:
            data.unpersist()
    table = train.sparkSession.createDataFrame(
        rows, "candidate int, params string, n_folds int, " + ", ".join(f"{m} double" for m in TUNING_METRICS))
    return TuningResult(model, points[best[0]], best[at], table, n_fits)


def _mean_rows(per_fold: dict[int, list[dict]], points: list[dict]) -> list[tuple]:
    """candidate, params, folds and the mean of each metric over the folds that have it."""
    import json
    rows = []
    for i, point in enumerate(points):
        own = per_fold.get(i, [])
        mean = {m: (sum(v) / len(v) if (v := [r[m] for r in own if r[m] is not None]) else None) for m in TUNING_METRICS}
        rows.append((i, json.dumps(point, sort_keys=True), len(own), *[mean[m] for m in TUNING_METRICS]))
    return rows


def _tune_together(data: DataFrame, cfg: ModelConfig, points: list[dict], y: str):
    """All logistic candidates and folds as one weight matrix; all held-out metrics in one grouped job."""
    rdd = L.row_blocks(data, "features", y, fold="fold")
    sizes = L.class_sizes(rdd)
    folds = sorted(int(f) for f in sizes)

    def made(point: dict, without: int | None) -> L.Fit:
        own, even = at_point(cfg, point)
        return L.Fit(own.lr_c, L.balanced(sizes, without) if even else (1.0, 1.0), without)

    jobs = [(i, fold) for fold in folds for i in range(len(points))]
    try:
        found = L.solve(rdd, [made(points[i], fold) for i, fold in jobs], max_iter=cfg.lr_max_iter)
        again = L.solve(rdd, [made(p, None) for p in points], max_iter=cfg.lr_max_iter)
    finally:
        rdd.unpersist()
    held_out = None
    for n, fold in enumerate(folds):
        own = L.scores(data.filter(F.col("fold") == fold), "features", found[n * len(points):(n + 1) * len(points)])
        held_out = own if held_out is None else held_out.unionByName(own)
    per_fold: dict[int, list[dict]] = {}
    if held_out is not None:
        long = held_out.select("fold", F.col(y).alias("y"), F.posexplode("scores").alias("candidate", "score"))
        for r in M.metrics_at(long, "y", "score", 0.5, by=("candidate", "fold")).collect():  # one row a fit
            per_fold.setdefault(r["candidate"], []).append({m: r[m] for m in TUNING_METRICS})
    return per_fold, lambda i: L.as_model(data.sparkSession, again[i], label=y), len(jobs)


def _tune_apart(data: DataFrame, cfg: ModelConfig, points: list[dict], y: str, id_col: str, tcfg: TuningConfig, prepare):
    """Every candidate and fold as a fit of its own."""
    from concurrent.futures import ThreadPoolExecutor
    sizes = {(r["fold"], r[y]): r["n"] for r in data.groupBy("fold", y).agg(F.count(F.lit(1)).alias("n")).collect()}
    folds = sorted({fold for fold, _ in sizes})
    ready = {}
    for fold in [*folds, None]:
        rows = data if fold is None else data.where(F.col("fold") != fold)
        ready[fold] = (rows, []) if prepare is None else prepare(rows)

    def fitted(i: int, without: int | None):
        own, even = at_point(cfg, points[i])
        counts: dict[int, int] = {}
        for (fold, label), n in sizes.items():
            if fold != without and label is not None:
                counts[int(label)] = counts.get(int(label), 0) + n
        rows, stages = ready[without]
        last = fit_stage(rows, own, y, id_col, balanced_weight(counts, y) if even else None)
        return PipelineModel(stages=[*stages, last])

    def one(job: tuple[int, int]) -> tuple[int, dict]:
        i, fold = job
        row = M.metrics_at(score_with(fitted(i, fold), data.where(F.col("fold") == fold), 0.5), y, "score", 0.5).first()
        return i, {m: row[m] for m in TUNING_METRICS}

    jobs = [(i, fold) for i in range(len(points)) for fold in folds]
    with ThreadPoolExecutor(max(1, tcfg.parallelism)) as pool:
        results = list(pool.map(one, jobs))
    per_fold: dict[int, list[dict]] = {}
    for i, row in results:
        per_fold.setdefault(i, []).append(row)
    return per_fold, lambda i: fitted(i, None), len(jobs)


# ------------------------------------------------------------------ fit
@dataclass
class FittedModel:
    key: str
    model: PipelineModel
    features: list[str]
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    best_params: dict | None = None
    best_score: float | None = None


def fit(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], cfg: ModelConfig,
        y: str = "y", id_col: str = "id", tuning: TuningConfig | None = None) -> FittedModel:
    """Preprocessor + classifier; ``dummy`` = majority class, or the train prevalence with
    ``dummy_strategy="prevalence"``."""
    if cfg.name == "dummy" and cfg.dummy_strategy == "prevalence":
        return FittedModel("dummy", constant_model(prevalence(train, y).first()["prevalence"]), [*numeric, *categorical])
    if cfg.name == "dummy":
        maj = majority(train, y).first()["majority"]
        return FittedModel("dummy", constant_model(1.0 if maj == 1 else 0.0), [*numeric, *categorical])
    train, owned = _cache(train)  # read by every fitting job below
    try:
        return _fit_persisted(train, numeric, categorical, cfg, y, id_col, tuning)
    finally:
        if owned:
            train.unpersist()


def _fit_persisted(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], cfg: ModelConfig,
                   y: str, id_col: str, tuning: TuningConfig | None) -> FittedModel:
    if cfg.name not in MODEL_KEYS:
        raise ValueError(f"unsupported model: {cfg.name}")
    prepare = None
    if cfg.name == "cat":
        data, stages, num, cat = cat_stages(train, numeric, categorical, y, id_col, cfg.seed)
        if tuning is not None:  # target statistics of each fit's own rows
            stages = []

            def prepare(rows: DataFrame) -> tuple[DataFrame, list]:
                return cat_stages(rows, num, cat, y, id_col, cfg.seed)[:2]
    else:
        pre = FE.fit_preprocessor(train, numeric, categorical)
        data, stages, num, cat = pre.model.transform(train), [pre.model], pre.numeric, pre.categorical
    if tuning is not None:
        tuned = tune(train, stages, cfg, y, id_col, tuning, prepare)
        return FittedModel(cfg.name, tuned.best_model, [*num, *cat], num, cat, tuned.best_params, tuned.best_score)
    balanced = (cfg.name == "tree" and cfg.dt_balanced) or (cfg.name == "rf" and cfg.rf_balanced)
    weight = balanced_weight(class_counts(train, y), y) if balanced else None
    return FittedModel(cfg.name, PipelineModel(stages=[*stages, fit_stage(data, cfg, y, id_col, weight)]), [*num, *cat], num, cat)


def train_baseline(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                   y: str = "y") -> FittedModel:
    """M6: class-balanced logistic regression on the preprocessed features."""
    train, owned = _cache(train)
    try:
        pre = FE.fit_preprocessor(train, numeric, categorical)
        weight = balanced_weight(class_counts(train, y), y)
        model = PipelineModel(stages=[pre.model, fit_stage(pre.model.transform(train), ModelConfig("logreg"), y, weight=weight)])
    finally:
        if owned:
            train.unpersist()
    return FittedModel("logreg", model, pre.selected, pre.numeric, pre.categorical)


def load_recorded(runs: DataFrame, model_key: str | None = None) -> tuple[FittedModel, float]:
    """R2: the newest recorded run of a key (``None``: the default model) as a usable model with its
    features, and the threshold recorded with it (Q12; 0.5 if none is)."""
    from ..functions.scalar import canonical_model_key
    from .registry import latest_per_model, resolve_model
    canonical_model_key(model_key)
    row = resolve_model(latest_per_model(runs), model_key).first()
    if row is None:
        raise LookupError(f"no recorded run of model {model_key or 'default'!r}")
    got = row.asDict()
    threshold = float(got["threshold"]) if got.get("threshold") is not None else 0.5
    return FittedModel(row["model"], PipelineModel.load(row["model_path"]), list(got.get("features") or [])), threshold


def predict(fm: FittedModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Score + label."""
    return score_with(fm.model, df, threshold)


def scored_once(fm: FittedModel, df: DataFrame, y: str = "y") -> DataFrame:
    """Truth and score of each row, written to the scratch folder: jobs that read them send no model to their tasks."""
    path = f"{scratch_path(df.sparkSession, 'scores')}-{uuid.uuid4().hex[:12]}"
    predict(fm, df).select(y, "score").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def evaluate(fm: FittedModel, df: DataFrame, threshold: float, y: str = "y", split: str | None = None,
             scored: DataFrame | None = None) -> DataFrame:
    """M12 on a split; one row.  ``scored`` as from ``scored_once``."""
    m = M.metrics_at(predict(fm, df, threshold) if scored is None else scored, y, "score", threshold)
    return m if split is None else m.withColumn("split", F.lit(split))


def pick_on_train(fm: FittedModel, train: DataFrame, y: str = "y", objective: str = "f1",
                  min_precision: float | None = None, min_recall: float | None = None,
                  scored: DataFrame | None = None) -> float:
    """M10 in-sample threshold (one bounded row to the driver).  ``scored`` as from ``scored_once``."""
    p = M.pick_threshold(predict(fm, train) if scored is None else scored, y, "score", M.TUNING_GRID, objective,
                         min_precision, min_recall).first()
    return float(p["threshold"])


def compare(train: DataFrame, test: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
            models: Sequence[str] = MODEL_KEYS, y: str = "y", id_col: str = "id",
            tuning: TuningConfig | None = None, objective: str = "f1",
            configs: dict[str, ModelConfig] | None = None,
            artifacts_dir: str | None = None, min_precision: float | None = None,
            min_recall: float | None = None) -> DataFrame:
    """Fit each model, pick its threshold on train, evaluate on
    test; leaderboard sorted by test ROC AUC then F1 (descending).

    With ``artifacts_dir`` each fitted model is saved as
    ``model_<key>_<run_id>`` and one row per model is appended to the
    ``runs`` table there (R1), so ``registry.latest_per_model`` finds it."""
    train, own_train = _cache(train)
    test, own_test = _cache(test)
    rows = []
    for key in models:
        cfg = (configs or {}).get(key, ModelConfig(key))
        fm = fit(train, numeric, categorical, cfg, y, id_col, tuning)
        seen_scores, test_scores = scored_once(fm, train, y), scored_once(fm, test, y)
        thr = pick_on_train(fm, train, y, objective, min_precision, min_recall, seen_scores)
        m = evaluate(fm, test, thr, y, scored=test_scores)
        seen = evaluate(fm, train, thr, y, scored=seen_scores).first()
        m = m.withColumns({f"train_{k}": F.lit(seen[k]).cast("double") for k in ("roc_auc", "f1", "precision", "recall")})
        if artifacts_dir:
            run_id = train.sparkSession.range(1).select(
                F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")).first()[0]
            path = f"{artifacts_dir.rstrip('/')}/model_{key}_{run_id}"
            fm.model.write().overwrite().save(path)
            m = m.withColumns({"run_id": F.lit(run_id), "model_path": F.lit(path),
                               "features": F.array(*[F.lit(c) for c in fm.features])})
            from .registry import record_run
            record_run(f"{artifacts_dir.rstrip('/')}/runs",
                       m.select(F.lit(key).alias("model"), "run_id", "model_path", "features", "threshold",
                                F.col("roc_auc").alias("test_roc_auc"), F.col("f1").alias("test_f1"),
                                F.col("precision").alias("test_precision"), F.col("recall").alias("test_recall"),
                                "train_roc_auc", "train_f1", "train_precision", "train_recall",
                                F.current_timestamp().alias("run_ts")))
        rows.append(m.select(F.lit(key).alias("model"), "threshold",
                             F.col("roc_auc").alias("test_roc_auc"), F.col("f1").alias("test_f1"),
                             F.col("precision").alias("test_precision"), F.col("recall").alias("test_recall"),
                             F.col("tp").alias("test_tp"), F.col("fp").alias("test_fp"),
                             F.col("n").alias("test_n"), "train_roc_auc", "train_f1", "train_precision",
                             "train_recall"))
    board = rows[0]
    for r in rows[1:]:
        board = board.unionByName(r)
    board = board.orderBy(F.desc_nulls_last("test_roc_auc"), F.desc("test_f1"), "model")
    # one row per model: materialise the report, then release the inputs
    out = train.sparkSession.createDataFrame(board.collect(), board.schema)
    if artifacts_dir:  # the leaderboard file
        from ..sources.io import write_table
        write_table(out.coalesce(1), f"{artifacts_dir.rstrip('/')}/leaderboard", fmt="csv", sep=",")
    if own_train:
        train.unpersist()
    if own_test:
        test.unpersist()
    return out


def run_train(train: DataFrame, test: DataFrame, y: str = "y", id_col: str = "id",
              meta: Sequence[str] = ("year_t", "year_t1")) -> DataFrame:
    """Schema diff -> align test to train -> drop all-NULL features ->
    balanced logistic regression -> threshold by max F1 (M11) on train ->
    metrics on train and test (two rows, with the schema diff)."""
    from . import schema as S
    keep = (id_col, *meta, y)
    diff = S.schema_diff(train, test, exclude=keep)
    test = S.align_to_schema(train, test, keep=keep)
    feats = [c for c in train.columns if c not in keep]
    cached, owned = _cache(train)
    train, test, dead = S.drop_all_null_features(cached, test, feats)
    feats = [c for c in feats if c not in dead]
    num, cat = S.feature_kinds(train, feats)
    fm = train_baseline(train, num, cat, y)
    thr = float(M.choose_threshold_max_f1(predict(fm, train), y, "score").first()["threshold"])
    out = evaluate(fm, train, thr, y, "train").unionByName(evaluate(fm, test, thr, y, "test"))
    out = out.withColumns({
        "missing_in_test": F.lit(",".join(diff["missing_in_test"])),
        "extra_in_test": F.lit(",".join(diff["extra_in_test"])),
        "dropped_all_null": F.lit(",".join(dead)),
        "n_features": F.lit(len(feats)),
    })
    # two report rows: materialise, then release the cached training data
    report = train.sparkSession.createDataFrame(out.collect(), out.schema)
    if owned:
        cached.unpersist()
    return report
