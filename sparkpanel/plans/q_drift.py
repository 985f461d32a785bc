"""Step 6: PSI drift (numeric, categorical, table, summary, per period)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import drift as D
from ..operators import sketches as SK
from ..session import scratch_path
from .catalog import register
from .tables import table

R = 9
NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CAT = ["l_returnflag", "l_linestatus", "flag_hi_disc"]
CUT = "1998-01-01"
LINE_COLS = ("l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, "
             "CASE WHEN l_discount > 0.05 THEN l_returnflag END AS flag_hi_disc")


def _sides(spark, sf):
    li = table(spark, sf, "lineitem").selectExpr("l_shipdate", *[c.strip() for c in _split(LINE_COLS)])
    ref = li.where(F.col("l_shipdate") < F.lit(CUT).cast("timestamp")).drop("l_shipdate")
    cur = li.where(F.col("l_shipdate") >= F.lit(CUT).cast("timestamp")).drop("l_shipdate")
    return ref, cur


def _split(cols: str) -> list[str]:
    out, depth, buf = [], 0, ""
    for ch in cols:
        if ch == "," and depth == 0:
            out.append(buf)
            buf = ""
            continue
        depth += ch == "("
        depth -= ch == ")"
        buf += ch
    return out + [buf]


SIDES_SQL = f"""
ref AS (SELECT {LINE_COLS} FROM lineitem WHERE l_shipdate < TIMESTAMP '{CUT}'),
cur AS (SELECT {LINE_COLS} FROM lineitem WHERE l_shipdate >= TIMESTAMP '{CUT}')"""


def _kcols(keys, prefix=""):
    return "".join(f"{prefix}{k}, " for k in keys)


def _using(keys, *more):
    return "USING (" + ", ".join([*keys, *more]) + ")"


def num_psi_sql(num, keys=(), name="num") -> str:
    ps = "[" + ", ".join(repr(p) for p in D.decile_probs(10)) + "]::DOUBLE[]"
    k = _kcols(keys)
    rl = " UNION ALL ".join(f"SELECT {k}'{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM ref" for c in num)
    cl = " UNION ALL ".join(f"SELECT {k}'{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM cur" for c in num)
    return f""",
{name}_rl AS ({rl}), {name}_cl AS ({cl}),
{name}_e0 AS (SELECT {k}feature, list_sort(list_distinct(quantile_cont(v, {ps}))) AS e, COUNT(v) AS n_ref
          FROM {name}_rl WHERE v IS NOT NULL GROUP BY ALL),
{name}_e1 AS (SELECT {k}feature, n_ref, len(e) - 1 AS nb, e[2:len(e) - 1] AS inner_e FROM {name}_e0),
{name}_rb AS (SELECT {k}feature, len(list_filter(inner_e, lambda x: x < v)) AS bin, COUNT(*) AS c_ref
          FROM {name}_rl JOIN {name}_e1 {_using(keys, 'feature')} WHERE v IS NOT NULL GROUP BY ALL),
{name}_cb AS (SELECT {k}feature, len(list_filter(inner_e, lambda x: x < v)) AS bin, COUNT(*) AS c_cur
          FROM {name}_cl JOIN {name}_e1 {_using(keys, 'feature')} WHERE v IS NOT NULL GROUP BY ALL),
{name}_ct AS (SELECT {k}feature, COUNT(v) AS n_cur FROM {name}_cl GROUP BY ALL),
{name}_fr AS (SELECT * FROM {name}_ct LEFT JOIN {name}_e1 {_using(keys, 'feature')}),
{name}_cells AS (SELECT {k}feature, n_ref, n_cur, unnest(range(0, nb)) AS bin FROM {name}_fr WHERE nb >= 1),
{name}_t AS (SELECT {k}feature,
        greatest(least(CASE WHEN n_ref > 0 THEN COALESCE(c_ref, 0) / n_ref ELSE 0 END, 1.0), 1e-6) AS pr,
        greatest(least(CASE WHEN n_cur > 0 THEN COALESCE(c_cur, 0) / n_cur ELSE 0 END, 1.0), 1e-6) AS pc
      FROM {name}_cells LEFT JOIN {name}_rb {_using(keys, 'feature', 'bin')} LEFT JOIN {name}_cb {_using(keys, 'feature', 'bin')}),
{name}_psi AS (SELECT {k}feature, SUM((pc - pr) * ln(pc / pr)) AS psi FROM {name}_t GROUP BY ALL),
{name} AS (SELECT {k}feature, 'numeric_psi' AS kind,
        CASE WHEN COALESCE(n_ref, 0) > 0 AND n_cur > 0 AND COALESCE(nb, 0) >= 1 THEN COALESCE(psi, 0) ELSE 0 END AS score,
        CAST(COALESCE(n_ref, 0) AS BIGINT) AS n_ref, CAST(n_cur AS BIGINT) AS n_cur
      FROM {name}_fr LEFT JOIN {name}_psi {_using(keys, 'feature')})"""


def cat_psi_sql(cat, keys=(), name="cat") -> str:
    k = _kcols(keys)
    rl = " UNION ALL ".join(f"SELECT {k}'{c}' AS feature, CAST({c} AS VARCHAR) AS v FROM ref" for c in cat)
    cl = " UNION ALL ".join(f"SELECT {k}'{c}' AS feature, CAST({c} AS VARCHAR) AS v FROM cur" for c in cat)
    on = " AND ".join(f"a.{x} = b.{x}" for x in [*keys, "feature", "cat"])
    co = ", ".join(f"COALESCE(a.{x}, b.{x}) AS {x}" for x in [*keys, "feature"])
    return f""",
{name}_rl AS ({rl}), {name}_cl AS ({cl}),
{name}_rc AS (SELECT {k}feature, COALESCE(v, '__na__') AS cat, COUNT(*) AS c_ref, COUNT(v) AS nn FROM {name}_rl GROUP BY ALL),
{name}_cc AS (SELECT {k}feature, COALESCE(v, '__na__') AS cat, COUNT(*) AS c_cur, COUNT(v) AS nn FROM {name}_cl GROUP BY ALL),
{name}_rt AS (SELECT {k}feature, SUM(c_ref) AS t_ref, SUM(nn) AS n_ref FROM {name}_rc GROUP BY ALL),
{name}_ctt AS (SELECT {k}feature, SUM(c_cur) AS t_cur, SUM(nn) AS n_cur FROM {name}_cc GROUP BY ALL),
{name}_k AS (SELECT * FROM {name}_ctt LEFT JOIN {name}_rt {_using(keys, 'feature')}),
{name}_cells AS (SELECT {co}, a.c_ref, b.c_cur FROM
        (SELECT r.* FROM {name}_rc r JOIN {name}_k {_using(keys, 'feature')}) a FULL OUTER JOIN {name}_cc b ON {on}),
{name}_t AS (SELECT {k}feature,
        greatest(least(CASE WHEN COALESCE(t_ref, 0) > 0 THEN COALESCE(c_ref, 0) / t_ref ELSE 0 END, 1.0), 1e-6) AS pr,
        greatest(least(CASE WHEN t_cur > 0 THEN COALESCE(c_cur, 0) / t_cur ELSE 0 END, 1.0), 1e-6) AS pc
      FROM {name}_cells JOIN {name}_k {_using(keys, 'feature')}),
{name}_psi AS (SELECT {k}feature, SUM((pc - pr) * ln(pc / pr)) AS psi FROM {name}_t GROUP BY ALL),
{name} AS (SELECT {k}feature, 'categorical_psi' AS kind, COALESCE(psi, 0) AS score,
        CAST(COALESCE(n_ref, 0) AS BIGINT) AS n_ref, CAST(n_cur AS BIGINT) AS n_cur
      FROM {name}_k LEFT JOIN {name}_psi {_using(keys, 'feature')})"""


def _position(cols) -> str:
    return "CASE feature " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(cols)) + " END"


def _status(x="score") -> str:
    return f"CASE WHEN {x} >= 0.25 THEN 'alert' WHEN {x} >= 0.1 THEN 'warn' ELSE 'ok' END"


@register("psi_numeric", "WITH " + SIDES_SQL + num_psi_sql(NUM) + f"""
SELECT feature, round(score, {R}) AS score, n_ref, n_cur FROM num
""")
def psi_numeric(spark, sf):
    """Decile PSI of four numeric lineitem columns, shipped before vs
    after 1998, all columns in the same jobs."""
    ref, cur = _sides(spark, sf)
    return D.numeric_psi(ref, cur, NUM).withColumn("score", F.round("score", R))


@register("psi_categorical", "WITH " + SIDES_SQL + cat_psi_sql(CAT) + f"""
SELECT feature, round(score, {R}) AS score, n_ref, n_cur FROM cat
""")
def psi_categorical(spark, sf):
    """Categorical PSI (NULL = '__na__', union of categories)."""
    ref, cur = _sides(spark, sf)
    return D.categorical_psi(ref, cur, CAT).withColumn("score", F.round("score", R))


ALL = NUM + CAT
_TABLE_SQL = "WITH " + SIDES_SQL + num_psi_sql(NUM) + cat_psi_sql(CAT) + f""",
tbl AS (SELECT feature, kind, score, {_status()} AS status, n_ref, n_cur, {_position(ALL)} AS position
        FROM (SELECT * FROM num UNION ALL SELECT * FROM cat) u)"""


@register("drift_table", _TABLE_SQL + f"""
SELECT feature, kind, round(score, {R}) AS score, status, n_ref, n_cur, position FROM tbl
""")
def drift_table(spark, sf):
    """Per-feature drift table with status bands."""
    ref, cur = _sides(spark, sf)
    return D.drift_table(ref, cur).withColumn("score", F.round("score", R))


@register("drift_summary", _TABLE_SQL + f"""
SELECT CASE WHEN COUNT(*) FILTER (WHERE status = 'alert') > 0 THEN 'alert'
            WHEN COUNT(*) FILTER (WHERE status = 'warn') > 0 THEN 'warn' ELSE 'ok' END AS status,
       COUNT(*) AS n_features, COUNT(*) FILTER (WHERE status = 'ok') AS n_ok,
       COUNT(*) FILTER (WHERE status = 'warn') AS n_warn, COUNT(*) FILTER (WHERE status = 'alert') AS n_alert,
       round(MAX(score), {R}) AS max_score,
       (SELECT feature FROM tbl ORDER BY score DESC, position LIMIT 1) AS max_feature,
       list(feature ORDER BY score DESC, position) AS features,
       0.1::DOUBLE AS warn_threshold, 0.25::DOUBLE AS alert_threshold
FROM tbl
""")
def drift_summary(spark, sf):
    """Overall status, counts, arg-max feature, ordered features."""
    ref, cur = _sides(spark, sf)
    s = D.drift_summary(D.drift_table(ref, cur))
    return (s.withColumn("max_score", F.round("max_score", R))
            .withColumn("features", F.transform("features", lambda r: r.getField("feature"))))


ORD_NUM = ["o_totalprice"]
ORD_CAT = ["o_orderpriority", "o_orderstatus"]
_PERIOD_SQL = f"""WITH
panel AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS p, o_totalprice, o_orderpriority, o_orderstatus FROM orders),
ref AS (SELECT CAST(p + 1 AS INTEGER) AS p, o_totalprice, o_orderpriority, o_orderstatus FROM panel),
cur AS (SELECT * FROM panel WHERE p IN (SELECT p FROM ref))""" + num_psi_sql(ORD_NUM, ["p"]) + cat_psi_sql(ORD_CAT, ["p"])


@register("drift_by_period", _PERIOD_SQL + f"""
SELECT p, feature, kind, round(score, {R}) AS score, {_status()} AS status, n_ref, n_cur,
       {_position(ORD_NUM + ORD_CAT).replace('CASE feature', 'CASE feature')} AS position
FROM (SELECT * FROM num UNION ALL SELECT * FROM cat) u
""")
def drift_by_period(spark, sf):
    """Every order year against the previous year, one set of jobs."""
    o = table(spark, sf, "orders").select(F.year("o_orderdate").cast("int").alias("p"),
                                          "o_totalprice", "o_orderpriority", "o_orderstatus")
    # position follows the column order of the panel: numeric first here
    t = D.drift_by_period(o, "p")
    return t.withColumn("score", F.round("score", R))


def _fixed_sql() -> str:
    ps = "[" + ", ".join(repr(p) for p in D.decile_probs(10)) + "]::DOUBLE[]"
    return f"""WITH
panel AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS p, o_totalprice, o_orderpriority, o_orderstatus FROM orders),
ref AS (SELECT o_totalprice, o_orderpriority, o_orderstatus FROM panel WHERE p = 1995),
cur AS (SELECT * FROM panel WHERE p <> 1995),
e0 AS (SELECT list_sort(list_distinct(quantile_cont(o_totalprice, {ps}))) AS e, COUNT(o_totalprice) AS n_ref FROM ref),
e1 AS (SELECT n_ref, len(e) - 1 AS nb, e[2:len(e) - 1] AS inner_e FROM e0),
rb AS (SELECT len(list_filter(inner_e, lambda x: x < o_totalprice)) AS bin, COUNT(*) AS c_ref FROM ref, e1 GROUP BY 1),
cb AS (SELECT p, len(list_filter(inner_e, lambda x: x < o_totalprice)) AS bin, COUNT(*) AS c_cur FROM cur, e1 GROUP BY 1, 2),
ct AS (SELECT p, COUNT(o_totalprice) AS n_cur FROM cur GROUP BY p),
cells AS (SELECT ct.p, ct.n_cur, e1.n_ref, unnest(range(0, e1.nb)) AS bin FROM ct, e1),
t AS (SELECT c.p, greatest(least(COALESCE(rb.c_ref, 0) / c.n_ref, 1.0), 1e-6) AS pr,
             greatest(least(COALESCE(cb.c_cur, 0) / c.n_cur, 1.0), 1e-6) AS pc
      FROM cells c LEFT JOIN rb ON rb.bin = c.bin LEFT JOIN cb ON cb.p = c.p AND cb.bin = c.bin),
num AS (SELECT t.p, 'o_totalprice' AS feature, 'numeric_psi' AS kind, SUM((pc - pr) * ln(pc / pr)) AS score,
               (SELECT CAST(n_ref AS BIGINT) FROM e1) AS n_ref, (SELECT CAST(n_cur AS BIGINT) FROM ct WHERE ct.p = t.p) AS n_cur
        FROM t GROUP BY t.p),
cl AS (SELECT p, 'o_orderpriority' AS feature, CAST(o_orderpriority AS VARCHAR) AS v FROM cur
       UNION ALL SELECT p, 'o_orderstatus', CAST(o_orderstatus AS VARCHAR) FROM cur),
rl AS (SELECT 'o_orderpriority' AS feature, CAST(o_orderpriority AS VARCHAR) AS v FROM ref
       UNION ALL SELECT 'o_orderstatus', CAST(o_orderstatus AS VARCHAR) FROM ref),
rc AS (SELECT feature, COALESCE(v, '__na__') AS cat, COUNT(*) AS c_ref, COUNT(v) AS nn FROM rl GROUP BY ALL),
cc AS (SELECT p, feature, COALESCE(v, '__na__') AS cat, COUNT(*) AS c_cur, COUNT(v) AS nn FROM cl GROUP BY ALL),
rt AS (SELECT feature, SUM(c_ref) AS t_ref, SUM(nn) AS n_ref FROM rc GROUP BY ALL),
ctt AS (SELECT p, feature, SUM(c_cur) AS t_cur, SUM(nn) AS n_cur FROM cc GROUP BY ALL),
k AS (SELECT ctt.*, rt.t_ref, rt.n_ref FROM ctt LEFT JOIN rt USING (feature)),
rside AS (SELECT k.p, rc.feature, rc.cat, rc.c_ref FROM rc JOIN k USING (feature)),
cells2 AS (SELECT COALESCE(a.p, b.p) AS p, COALESCE(a.feature, b.feature) AS feature, a.c_ref, b.c_cur
           FROM rside a FULL OUTER JOIN cc b ON a.p = b.p AND a.feature = b.feature AND a.cat = b.cat),
t2 AS (SELECT c.p, c.feature,
         greatest(least(CASE WHEN COALESCE(k.t_ref, 0) > 0 THEN COALESCE(c.c_ref, 0) / k.t_ref ELSE 0 END, 1.0), 1e-6) AS pr,
         greatest(least(CASE WHEN k.t_cur > 0 THEN COALESCE(c.c_cur, 0) / k.t_cur ELSE 0 END, 1.0), 1e-6) AS pc
       FROM cells2 c JOIN k ON k.p = c.p AND k.feature = c.feature),
cat AS (SELECT k.p, k.feature, 'categorical_psi' AS kind, COALESCE(s.psi, 0) AS score,
               CAST(COALESCE(k.n_ref, 0) AS BIGINT) AS n_ref, CAST(k.n_cur AS BIGINT) AS n_cur
        FROM k LEFT JOIN (SELECT p, feature, SUM((pc - pr) * ln(pc / pr)) AS psi FROM t2 GROUP BY ALL) s
        ON s.p = k.p AND s.feature = k.feature)
SELECT p, feature, kind, round(score, {R}) AS score, {_status()} AS status, n_ref, n_cur,
       {_position(ORD_NUM + ORD_CAT)} AS position
FROM (SELECT * FROM num UNION ALL SELECT * FROM cat) u"""


@register("drift_fixed_reference", _fixed_sql())
def drift_fixed_reference(spark, sf):
    """D8 with a fixed reference: every order year against 1995; the
    reference side is scanned and binned once for all years."""
    o = table(spark, sf, "orders").select(F.year("o_orderdate").cast("int").alias("p"),
                                          "o_totalprice", "o_orderpriority", "o_orderstatus")
    return D.drift_by_period(o, "p", reference=1995).withColumn("score", F.round("score", R))


# Column dictionary of the drift binding (feature, description, derived).
LINE_DICTIONARY = [
    ("l_quantity", "quantity of the line", False),
    ("l_extendedprice", "price of the line before discount", False),
    ("l_discount", "discount rate", False),
    ("l_tax", "tax rate", False),
    ("l_returnflag", "return flag", False),
    ("l_linestatus", "line status", False),
    ("flag_hi_disc", "return flag of lines discounted above 5%", True),
]


def _dictionary_sql() -> str:
    rows = ", ".join(f"('{f}', '{d}', {str(x).lower()})" for f, d, x in LINE_DICTIONARY)
    return f"dict(feature, description, derived) AS (VALUES {rows})"


@register("feature_dictionary", _TABLE_SQL + f""", {_dictionary_sql()}
SELECT t.feature, t.kind, round(t.score, {R}) AS score, t.status, d.description, d.derived
FROM tbl t LEFT JOIN dict d USING (feature)
""")
def feature_dictionary(spark, sf):
    """Drift rows enriched with a feature dictionary (a dimension table
    bounded by the number of known features, joined by broadcast)."""
    from ..operators import schema as S
    ref, cur = _sides(spark, sf)
    t = D.drift_table(ref, cur).select("feature", "kind", F.round("score", R).alias("score"), "status")
    return S.describe_features(t, S.feature_dictionary(spark, LINE_DICTIONARY))


@register("drift_empty_current", f"""
WITH cats AS (SELECT 'o_orderpriority' AS feature, o_orderpriority AS c, COUNT(*) AS n FROM orders GROUP BY 2
              UNION ALL SELECT 'o_orderstatus', o_orderstatus, COUNT(*) FROM orders GROUP BY 2),
p AS (SELECT feature, CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY feature) AS pr, CAST(1e-6 AS DOUBLE) AS pc FROM cats)
SELECT feature, 'categorical_psi' AS kind,
       round(SUM((pc - greatest(pr, 1e-6)) * ln(pc / greatest(pr, 1e-6))), {R}) AS score FROM p GROUP BY feature
UNION ALL SELECT 'o_totalprice', 'numeric_psi', 0.0::DOUBLE
""")
def drift_empty_current(spark, sf):
    """A current table without rows: every feature is reported; numeric scores are 0, and
    every category counts as gone."""
    o = table(spark, sf, "orders").select("o_totalprice", "o_orderpriority", "o_orderstatus")
    t = D.drift_table(o, o.where("o_totalprice < 0"))
    return t.select("feature", "kind", F.round("score", R).alias("score"))


TOLERANCE = 0.03  # of a score from sketches


@register("drift_from_sketches", _PERIOD_SQL + """
SELECT p, feature, kind, n_ref, n_cur, true AS near FROM (SELECT * FROM num UNION ALL SELECT * FROM cat) u
""")
def drift_from_sketches(spark, sf):
    """D8 from stored sketches: one KLL sketch or count table a period and column, written once; every pair of
    neighbouring periods compared from these alone, and held against the exact scores."""
    o = table(spark, sf, "orders").select(F.year("o_orderdate").cast("int").alias("p"), *ORD_NUM, *ORD_CAT)
    base = f"{scratch_path(spark, 'sketches')}-{uuid.uuid4().hex[:12]}"
    SK.numeric_sketches(o, ["p"], ORD_NUM).write.parquet(f"{base}/numeric")
    SK.category_counts(o, ["p"], ORD_CAT).write.parquet(f"{base}/counts")
    num, cat = spark.read.parquet(f"{base}/numeric"), spark.read.parquet(f"{base}/counts")

    def before(df):
        return df.withColumn("p", F.col("p") + 1)

    found = (SK.numeric_drift(before(num), num, ["p"]).withColumn("kind", F.lit("numeric_psi"))
             .unionByName(SK.category_drift(before(cat), cat, ["p"]).withColumn("kind", F.lit("categorical_psi"))))
    exact = D.drift_by_period(o, "p").select("p", "feature", F.col("score").alias("exact"))
    near = F.abs(F.col("score") - F.col("exact")) <= TOLERANCE
    return found.join(exact, ["p", "feature"]).select("p", "feature", "kind", "n_ref", "n_cur", near.alias("near"))
