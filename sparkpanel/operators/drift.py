"""Distribution drift by PSI.

All features are handled in the same jobs: each side is unpivoted to
``(group..., feature, value)`` and every step is a ``groupBy`` keyed by the
feature, so there is no per-column loop and no per-column job.

Numeric PSI: reference deciles (linear interpolation, de-duplicated, with
``-inf``/``+inf`` ends) -> right-closed bin per value, found in the row
before it is unpivoted (one reference group: its edges are literals; several:
a broadcast row of edge arrays a group) -> counts per bin
and side (map-side combined) -> every reference bin kept, absent = 0 ->
probabilities clipped to [1e-6, 1] -> ``sum((pc - pr) * ln(pc / pr))``.

Categorical PSI: NULL is the category ``__na__``; the category domain is the
union of both sides.  Each side's values are counted in one shuffle, from
which both the totals and the cells come.

Comparisons are keyed by ``by`` (e.g. the period of the current side); the
reference side is keyed by ``ref_by`` (a subset of ``by``), so one fixed
reference table is scanned once and compared with every period.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import band, clip, to_double
from .ranking import exact_quantiles
from .schema import common_columns, is_numeric_type, q

# Probability clip, the NULL category, columns never scored
# for drift, and the status thresholds.
EPS = 1e-6
NA = "__na__"
DEFAULT_EXCLUDE = ("y", "year_t", "year_t1", "ano", "ra")
WARN, ALERT = 0.10, 0.25


def decile_probs(bins: int = 10) -> list[float]:
    return [float(x) for x in np.linspace(0, 1, bins + 1)]


def _long(df: DataFrame, keys: Sequence[str], cols: Sequence[str], numeric: bool) -> DataFrame:
    conv = (lambda c: to_double(q(c))) if numeric else (lambda c: q(c).cast("string"))
    proj = df.select(*[q(k) for k in keys], *[conv(c).alias(c) for c in cols])
    return proj.unpivot(list(keys), list(cols), "feature", "v")


def _psi_term(pr: Column, pc: Column) -> Column:
    pr, pc = clip(pr, EPS, 1.0), clip(pc, EPS, 1.0)
    return (pc - pr) * F.ln(pc / pr)


def _prob(c: Column, total: Column) -> Column:
    return F.when(total > 0, c.cast("double") / total.cast("double")).otherwise(F.lit(0.0))


def normalize_probs(counts: DataFrame, count: str = "n", by: Sequence[str] = ("feature",), out: str = "p") -> DataFrame:
    """Each count's share of its group's total; a group of zeros is uniform.  The totals come from
    an aggregate joined back, so a large group is not gathered."""
    total = counts.groupBy(*by).agg(F.sum(count).alias("_total"), F.count(F.lit(1)).alias("_cells"))
    share = F.when(F.col("_total") > 0, F.col(count) / F.col("_total")).otherwise(1.0 / F.col("_cells"))
    return counts.join(total, list(by)).withColumn(out, share.cast("double")).drop("_total", "_cells")


def _bin_codes(df: DataFrame, keys: Sequence[str], cols: Sequence[str], edges: Sequence, edge_schema,
               ref_by: Sequence[str], bins: int) -> DataFrame:
    """``(keys..., code)``, a row for each row and column: ``column * (bins + 2)`` plus the right-closed
    bin, ``bins`` for NULL, or ``bins + 1`` where the reference has no value."""
    vals = df.select(*[q(k) for k in keys], *[to_double(q(c)).alias(f"_v{i}") for i, c in enumerate(cols)])
    if ref_by:
        groups: dict[tuple, dict] = {}
        for r in edges:  # #reference groups x #features rows
            groups.setdefault(tuple(r[k] for k in ref_by), {})[r["feature"]] = r["inner"]
        schema = T.StructType([*[edge_schema[k] for k in ref_by],
                               *[T.StructField(f"_e{i}", T.ArrayType(T.DoubleType())) for i in range(len(cols))]])
        wide = df.sparkSession.createDataFrame([(*k, *[e.get(c) for c in cols]) for k, e in groups.items()], schema)
        vals = vals.join(F.broadcast(wide), list(ref_by), "left")
    held = {r["feature"]: r["inner"] for r in edges}

    def code(i: int, c: str) -> Column:
        v, base = F.col(f"_v{i}"), i * (bins + 2)
        # right-closed bin = number of inner edges below the value; at most
        # bins-1 edges, unrolled so the expression stays in generated code
        if ref_by:
            none = F.col(f"_e{i}").isNull()
            terms = [F.coalesce((F.try_element_at(f"_e{i}", F.lit(j)) < v).cast("int"), F.lit(0)) for j in range(1, bins)]
        else:
            none = F.lit(c not in held)
            terms = [(F.lit(e) < v).cast("int") for e in held.get(c, []) if e is not None]
        return (F.when(v.isNull(), base + bins).when(none, base + bins + 1)
                .otherwise(sum(terms, F.lit(base))).alias(f"_c{i}"))

    coded = vals.select(*[q(k) for k in keys], *[code(i, c) for i, c in enumerate(cols)])
    return coded.unpivot([q(k) for k in keys], [f"_c{i}" for i in range(len(cols))], "_column", "code").drop("_column")


def _bin_counts(sides: Sequence[DataFrame], keys: Sequence[str], cols: Sequence[str], bins: int) -> DataFrame:
    """``(keys..., feature, bin, filled, side, rows)`` of each side's codes.  Every side is counted where it is
    read, before the union.  Bounded (#groups x #features x (bins + 2) rows a side), so it is materialised:
    rows are scanned once."""
    parts = [codes.groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("rows")).withColumn("side", F.lit(i))
             for i, codes in enumerate(sides)]
    counts = reduce(DataFrame.unionByName, parts)
    counts = counts.sparkSession.createDataFrame(counts.collect(), counts.schema)
    column, cell = F.floor(F.col("code") / (bins + 2)).cast("int"), F.col("code") % (bins + 2)
    return counts.select(*keys, F.element_at(F.array(*[F.lit(c) for c in cols]), column + 1).alias("feature"),
                         F.when(cell < bins, cell).alias("bin"), (cell != bins).alias("filled"), "side", "rows")


def numeric_psi(ref: DataFrame, cur: DataFrame, cols: Sequence[str], bins: int = 10,
                by: Sequence[str] = (), ref_by: Sequence[str] | None = None,
                quantiles: str = "exact", accuracy: int = 100000, paired_only: bool = False) -> DataFrame:
    """D1 (+A19, J5, A20, J4, A22, A23) for many columns at once.

    Returns ``(by..., feature, score, n_ref, n_cur)``; score 0 when a side
    is empty or the reference has fewer than two distinct edges.  Every
    feature of every reference group is returned, or with ``paired_only``
    those whose group has current rows.
    ``quantiles``: ``exact`` (default; distributed histogram, see
    ``ranking.exact_quantiles``), ``percentile`` (Spark's exact aggregate,
    which merges each group's value map in one task) or ``approx``."""
    by = list(by)
    ref_by = list(by if ref_by is None else ref_by)
    ps = decile_probs(bins)
    rl = _long(ref, ref_by, cols, True)
    v = F.col("v")
    if quantiles == "exact":
        # distributed histogram + prefix sums; no group is merged in one task
        edges = (exact_quantiles(rl, [*ref_by, "feature"], "v", ps)
                 .select(*ref_by, "feature", F.array_sort(F.array_distinct("q")).alias("e"),
                         F.col("n").alias("n_ref")))
    else:
        qexpr = F.percentile(v, ps) if quantiles == "percentile" else F.percentile_approx(v, ps, accuracy)
        edges = (rl.groupBy(*ref_by, "feature")
                 .agg(F.array_sort(F.array_distinct(qexpr)).alias("e"), F.count(v).alias("n_ref")))
    edges = edges.select(*ref_by, "feature", "n_ref", (F.size("e") - 1).alias("nb"),
                         F.slice("e", 2, F.greatest(F.size("e") - 2, F.lit(0))).alias("inner"))
    spark = ref.sparkSession
    held = edges.collect()  # #reference groups x #features rows, one small array each
    edges = spark.createDataFrame(held, edges.schema)
    ref_codes = _bin_codes(ref, ref_by, cols, held, edges.schema, ref_by, bins)
    cur_codes = _bin_codes(cur, by, cols, held, edges.schema, ref_by, bins)

    if ref_by == by:
        # one pass over both sides: counts per (group, feature, bin) and side
        counts = _bin_counts([ref_codes, cur_codes], by, cols, bins)
        side0, side1, rows = F.col("side") == 0, F.col("side") == 1, F.col("rows")
        counts = counts.groupBy(*by, "feature", "bin").agg(
            F.sum(F.when(side0 & F.col("filled"), rows).otherwise(0)).alias("c_ref"),
            F.sum(F.when(side1 & F.col("filled"), rows).otherwise(0)).alias("c_cur"),
            F.sum(F.when(side1, rows).otherwise(0)).alias("rows_cur"))
        tot = counts.groupBy(*by, "feature").agg(F.sum("c_ref").alias("n_ref"), F.sum("c_cur").alias("n_cur"),
                                                 F.sum("rows_cur").alias("rows_cur"))
        if not by:  # a side without rows still has every feature
            tot = _all_features(F.broadcast(tot), cols, {"n_ref": 0, "n_cur": 0, "rows_cur": 0})
        if paired_only:
            tot = tot.where(F.col("rows_cur") > 0)
        # every table from here on is as small as the edges and counts held above
        tot = tot.join(F.broadcast(edges.select(*by, "feature", "nb")), [*by, "feature"], "left")
        cells = (tot.where(F.col("nb") >= 1)
                 .select(*by, "feature", "n_ref", "n_cur",
                         F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("bin"))
                 .join(F.broadcast(counts.select(*by, "feature", "bin", "c_ref", "c_cur")), [*by, "feature", "bin"], "left"))
        terms = cells.select(*by, "feature", _psi_term(_prob(F.coalesce("c_ref", F.lit(0)), F.col("n_ref")),
                                                       _prob(F.coalesce("c_cur", F.lit(0)), F.col("n_cur"))).alias("t"))
        psi = terms.groupBy(*by, "feature").agg(F.sum("t").alias("psi"))
        out = tot.join(F.broadcast(psi), on=[*by, "feature"], how="left")
        ok = (F.col("n_ref") > 0) & (F.col("n_cur") > 0) & (F.coalesce("nb", F.lit(0)) >= 1)
        return out.select(*by, "feature", F.when(ok, F.coalesce("psi", F.lit(0.0))).otherwise(F.lit(0.0)).alias("score"),
                          F.col("n_ref").cast("long").alias("n_ref"), F.col("n_cur").cast("long").alias("n_cur"))

    # Separate reference groups (e.g. one fixed reference period): each side
    # is scanned once; both bin-count tables are bounded and materialised.
    rb = _bin_counts([ref_codes], ref_by, cols, bins)
    rb = rb.where(F.col("bin").isNotNull()).select(*ref_by, "feature", "bin", F.col("rows").alias("c_ref"))
    cb = _bin_counts([cur_codes], by, cols, bins).groupBy(*by, "feature", "bin").agg(
        F.sum(F.when(F.col("filled"), F.col("rows")).otherwise(0)).alias("c_cur"))
    cur_tot = cb.groupBy(*by, "feature").agg(F.sum("c_cur").alias("n_cur"))
    frame = (cur_tot.join(edges.select(*ref_by, "feature", "nb", "n_ref"),
                          on=[*ref_by, "feature"], how="left"))
    cells = (frame.where(F.col("nb") >= 1)
             .select(*by, "feature", "n_ref", "n_cur",
                     F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("bin")))
    cells = (cells.join(rb, on=[*ref_by, "feature", "bin"], how="left")
             .join(cb.where(F.col("bin").isNotNull()), on=[*by, "feature", "bin"], how="left"))
    terms = cells.select(*by, "feature", _psi_term(_prob(F.coalesce("c_ref", F.lit(0)), F.col("n_ref")),
                                                   _prob(F.coalesce("c_cur", F.lit(0)), F.col("n_cur"))).alias("t"))
    psi = terms.groupBy(*by, "feature").agg(F.sum("t").alias("psi"))
    out = frame.join(psi, on=[*by, "feature"], how="left")
    ok = (F.coalesce("n_ref", F.lit(0)) > 0) & (F.col("n_cur") > 0) & (F.coalesce("nb", F.lit(0)) >= 1)
    return out.select(*by, "feature", F.when(ok, F.coalesce("psi", F.lit(0.0))).otherwise(F.lit(0.0)).alias("score"),
                      F.coalesce("n_ref", F.lit(0)).cast("long").alias("n_ref"), F.col("n_cur").cast("long").alias("n_cur"))


def _all_features(totals: DataFrame, cols: Sequence[str], empty: dict[str, int]) -> DataFrame:
    """The totals with a row of zeros for every feature that has none."""
    names = totals.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in cols])).alias("feature"))
    return names.join(totals, "feature", "left").fillna(empty)


def categorical_psi(ref: DataFrame, cur: DataFrame, cols: Sequence[str],
                    by: Sequence[str] = (), ref_by: Sequence[str] | None = None,
                    paired_only: bool = False) -> DataFrame:
    """D2 (+A21, J3, U2, T6): ``(by..., feature, score, n_ref, n_cur)``; a category that a side
    lacks (any, if it has no rows) has probability EPS there.  Groups as in ``numeric_psi``."""
    by = list(by)
    ref_by = list(by if ref_by is None else ref_by)
    rl = _long(ref, ref_by, cols, False)
    cl = _long(cur, by, cols, False)
    # counts per (group, feature, value) of each side, made where it is read; totals and cells take the same
    # columns of them, so Spark scans and shuffles a side once
    rv = rl.groupBy(*ref_by, "feature", "v").agg(F.count(F.lit(1)).alias("rows"))
    cv = cl.groupBy(*by, "feature", "v").agg(F.count(F.lit(1)).alias("rows"))
    rows, filled = F.col("rows"), F.col("v").isNotNull()
    cat = F.coalesce(F.col("v"), F.lit(NA)).alias("cat")
    if ref_by == by:
        # the union of both sides' counts = the union of the two category domains
        values = rv.withColumn("_side", F.lit(0)).unionByName(cv.withColumn("_side", F.lit(1)))
        s0, s1 = F.col("_side") == 0, F.col("_side") == 1
        counts = values.groupBy(*by, "feature", cat).agg(F.sum(F.when(s0, rows).otherwise(0)).alias("c_ref"),
                                                         F.sum(F.when(s1, rows).otherwise(0)).alias("c_cur"))
        tot = (values.groupBy(*by, "feature")
               .agg(F.sum(F.when(s0, rows).otherwise(0)).alias("t_ref"), F.sum(F.when(s1, rows).otherwise(0)).alias("t_cur"),
                    F.sum(F.when(s0 & filled, rows).otherwise(0)).alias("n_ref"),
                    F.sum(F.when(s1 & filled, rows).otherwise(0)).alias("n_cur")))
        if not by:
            tot = _all_features(tot, cols, {"t_ref": 0, "t_cur": 0, "n_ref": 0, "n_cur": 0})
        if paired_only:
            tot = tot.where(F.col("t_cur") > 0)
        cells = counts.join(tot.select(*by, "feature", "t_ref", "t_cur"), [*by, "feature"], "inner")
        terms = cells.select(*by, "feature", _psi_term(_prob(F.col("c_ref"), F.col("t_ref")),
                                                       _prob(F.col("c_cur"), F.col("t_cur"))).alias("t"))
        psi = terms.groupBy(*by, "feature").agg(F.sum("t").alias("score"))
        out = tot.join(psi, on=[*by, "feature"], how="left")
        return out.select(*by, "feature", F.coalesce("score", F.lit(0.0)).alias("score"),
                          F.col("n_ref").cast("long").alias("n_ref"), F.col("n_cur").cast("long").alias("n_cur"))
    rc = rv.groupBy(*ref_by, "feature", cat).agg(F.sum("rows").alias("c_ref"))
    cc = cv.groupBy(*by, "feature", cat).agg(F.sum("rows").alias("c_cur"))
    nn = F.sum(F.when(filled, rows).otherwise(0))
    cur_keys = cv.groupBy(*by, "feature").agg(F.sum("rows").alias("t_cur"), nn.alias("n_cur"))
    ref_tot = rv.groupBy(*ref_by, "feature").agg(F.sum("rows").alias("t_ref"), nn.alias("n_ref"))
    keys = cur_keys.join(ref_tot, on=[*ref_by, "feature"], how="left")
    # reference categories expanded to each comparison group (bounded by
    # #groups x #categories); then the union of both domains.
    rside = rc.join(keys.select(*by, "feature"), on=[*ref_by, "feature"], how="inner").select(*by, "feature", "cat", "c_ref")
    cells = rside.join(cc.select(*by, "feature", "cat", "c_cur"), on=[*by, "feature", "cat"], how="full_outer")
    cells = cells.join(keys.select(*by, "feature", "t_ref", "t_cur"), on=[*by, "feature"], how="inner")
    terms = cells.select(*by, "feature", _psi_term(_prob(F.coalesce("c_ref", F.lit(0)), F.coalesce("t_ref", F.lit(0))),
                                                   _prob(F.coalesce("c_cur", F.lit(0)), F.col("t_cur"))).alias("t"))
    psi = terms.groupBy(*by, "feature").agg(F.sum("t").alias("score"))
    out = keys.join(psi, on=[*by, "feature"], how="left")
    return out.select(*by, "feature", F.coalesce("score", F.lit(0.0)).alias("score"),
                      F.coalesce("n_ref", F.lit(0)).cast("long").alias("n_ref"), F.col("n_cur").cast("long").alias("n_cur"))


def split_kinds(ref: DataFrame, cur: DataFrame, exclude: Iterable[str] = DEFAULT_EXCLUDE) -> tuple[list[str], list[str], list[str]]:
    """D3/U4: common columns in reference order; numeric only when both
    sides are numeric (booleans are categorical)."""
    cols = common_columns(ref, cur, exclude)
    rt = {f.name: f.dataType for f in ref.schema.fields}
    ct = {f.name: f.dataType for f in cur.schema.fields}
    num = [c for c in cols if is_numeric_type(rt[c]) and is_numeric_type(ct[c])]
    return cols, num, [c for c in cols if c not in num]


def drift_table(ref: DataFrame, cur: DataFrame, warn: float = WARN, alert: float = ALERT,
                exclude: Iterable[str] = DEFAULT_EXCLUDE, by: Sequence[str] = (),
                ref_by: Sequence[str] | None = None, bins: int = 10,
                quantiles: str = "exact", paired_only: bool = False) -> DataFrame:
    """``(by..., feature, kind, score, status, n_ref, n_cur, position)``."""
    ex = set(exclude) | set(by) | set(ref_by or [])
    cols, num, cat = split_kinds(ref, cur, ex)
    parts = []
    if num:
        parts.append(numeric_psi(ref, cur, num, bins, by, ref_by, quantiles, paired_only=paired_only)
                     .withColumn("kind", F.lit("numeric_psi")))
    if cat:
        parts.append(categorical_psi(ref, cur, cat, by, ref_by, paired_only).withColumn("kind", F.lit("categorical_psi")))
    if not parts:
        raise ValueError("no common columns to compare")
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    pos = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    return out.select(*by, "feature", "kind", "score", band("score", warn, alert).alias("status"),
                      "n_ref", "n_cur", pos[F.col("feature")].alias("position"))


def sort_drift(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """K4: by score descending, then reference column order."""
    return table.orderBy(*by, F.desc("score"), "position", "feature")


def drift_summary(table: DataFrame, warn: float = WARN, alert: float = ALERT,
                  by: Sequence[str] = ()) -> DataFrame:
    """Status, counts, max score and its feature, thresholds and the
    nested feature rows (bounded by the number of features)."""
    n_alert = F.count_if(F.col("status") == "alert")
    n_warn = F.count_if(F.col("status") == "warn")
    feats = F.transform(
        F.array_sort(F.collect_list(F.struct(
            (-F.col("score")).alias("k1"), F.col("position").alias("k2"),
            F.struct("feature", "kind", "score", "status", "n_ref", "n_cur").alias("row")))),
        lambda s: s.getField("row"))
    agg = table.groupBy(*by).agg(
        F.when(n_alert > 0, "alert").when(n_warn > 0, "warn").otherwise("ok").alias("status"),
        F.count(F.lit(1)).alias("n_features"),
        F.count_if(F.col("status") == "ok").alias("n_ok"), n_warn.alias("n_warn"), n_alert.alias("n_alert"),
        F.max("score").alias("max_score"),
        F.max_by("feature", F.struct(F.col("score"), -F.col("position"))).alias("max_feature"),
        feats.alias("features"))
    return agg.withColumns({"warn_threshold": F.lit(float(warn)), "alert_threshold": F.lit(float(alert))})


def drift_by_period(panel: DataFrame, period_col: str, warn: float = WARN, alert: float = ALERT,
                    reference: str | int = "previous", exclude: Iterable[str] = DEFAULT_EXCLUDE,
                    step: int = 1, quantiles: str = "exact") -> DataFrame:
    """Every period against the previous period (``reference='previous'``)
    or against one fixed period, all periods in the same jobs."""
    ex = set(exclude) | {period_col}
    if reference == "previous":
        ref = panel.withColumn(period_col, F.col(period_col) + F.lit(step))
        # only periods that have a previous period (few distinct keys)
        cur = panel.join(ref.select(period_col).distinct(), on=period_col, how="left_semi")
        return drift_table(ref, cur, warn, alert, ex, by=[period_col], quantiles=quantiles, paired_only=True)
    ref = panel.where(F.col(period_col) == F.lit(reference)).drop(period_col)
    cur = panel.where(F.col(period_col) != F.lit(reference))
    return drift_table(ref, cur, warn, alert, ex, by=[period_col], ref_by=[], quantiles=quantiles)


def with_run_stamp(df: DataFrame, col: str = "run_ts") -> DataFrame:
    """Stamp a report with the run time (append to a history table
    partitioned by ``run_ts``; 'latest' = rows of ``max(run_ts)``)."""
    return df.withColumn(col, F.current_timestamp())


def latest_report(history: DataFrame, col: str = "run_ts") -> DataFrame:
    """S10 'latest' copy: rows of the newest run (one aggregate + semi join)."""
    newest = history.agg(F.max(col).alias(col))
    return history.join(F.broadcast(newest), on=col, how="left_semi")
