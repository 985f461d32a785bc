"""Mixing sources to target weights by entropy balancing (operator 2).

Sources by code point, null last, weigh 1, 2, 3, repeating, and share all
words; a target stops at ``CAP`` times its source's size and the excess is
shared again by weight until none is above.  The rates of documents are those
nearest to 1 (least relative entropy, rates at most CAP) whose expected words
meet every source's target: ``min(CAP, exp(lambda * size / mean size))``.  The
convex dual has one multiplier a source; each Newton iteration is one
aggregate over the counts by (source, size), kept inside a bracket that
halves whenever a step leaves it.  Rates become whole copies: the integer part,
and one more where a hash of the row lies below the fraction plus a shift.
The shift is found per source (two rounds of counting in bins) for large
documents first, then for smaller ones, which also take up what the larger ones
left, so the words taken come within about one small document of the target.

Null texts have size 0: no words, one copy, whatever their source.  A source
without words has target 0.  Null doc_ids are rows like others.  Equal rows get equal copies, so results of
reruns agree; ties in luck share their fate.  A very long text only adds its word count.
An empty table gives an empty result.  ``repeat`` carries the columns inside one struct, so extra
columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import shared

CAP = 3
WEIGHTS = (1, 2, 3)
STEPS = 60
CLOSE = 1e-7  # of a source's target
BINS = 4096
SEED = 71
SPACES = " \t\n\x0b\f\r"


def n_words(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    plain = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(plain == "", F.lit(0)).otherwise(F.size(F.split(plain, r"[\x20\x09-\x0D]+", -1))).cast("long")


def source_key(source: Column) -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def numbered(sources: DataFrame) -> DataFrame:
    """Sources with their place by code point, null last, from range partitions."""
    order = F.col("source").asc_nulls_last()
    parts = shared.keep(sources.repartitionByRange(order).sortWithinPartitions(order)
                        .withColumn("part", F.spark_partition_id())
                        .withColumn("place", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33)),
                        "sources")
    starts, total = [], 0
    for r in parts.groupBy("part").count().orderBy("part").collect():  # one row for each partition
        starts.append((r["part"], total))
        total += r["count"]
    first = parts.sparkSession.createDataFrame(starts, "part int, first long")
    return parts.join(F.broadcast(first), "part").withColumn("place", F.col("first") + F.col("place")).drop("part", "first")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """key, source_size, n, target and full (target at the cap) of each source of (source, key, size) rows."""
    sizes = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"),
                                    F.count(F.lit(1)).alias("n"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = shared.keep(numbered(sizes).withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int"))),
                          "weights")
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level, full = (total / weight if weight else 0.0), -1
    while weight:
        at_cap = F.col("weight") * F.lit(level) >= cap * F.col("source_size")
        n, taken, weight = sources.agg(F.count_if(at_cap), F.coalesce(F.sum(F.when(at_cap, cap * F.col("source_size"))), F.lit(0)),
                                       F.sum(F.when(~at_cap, F.col("weight")))).first()
        if n == full:
            break
        full = n
        level = (total - taken) / weight if weight else float("inf")
    target = F.least(F.col("weight") * F.lit(level), (cap * F.col("source_size")).cast("double"))
    return (sources.withColumn("target", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(target))
            .withColumn("full", F.col("target") >= cap * F.col("source_size")).drop("place"))


def rate(size: Column, cap: int = CAP) -> Column:
    """The rate of a document of this size from its source's multiplier."""
    tilt = F.col("multiplier") * size / F.col("mean")
    return F.when(F.col("full"), F.lit(float(cap))).when(tilt >= F.lit(2.0), F.lit(float(cap))).otherwise(
        F.least(F.lit(float(cap)), F.exp(tilt)))


def balance(sizes: DataFrame, goals: DataFrame, cap: int = CAP) -> DataFrame:
    """The goals with each source's multiplier; ``sizes`` counts documents by (key, size)."""
    state = goals.select("key", "source_size", "target", "full",
                         (F.col("source_size") / F.greatest(F.col("n"), F.lit(1))).alias("mean"),
                         F.lit(0.0).alias("multiplier"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"),
                         (F.col("full") | (F.col("source_size") == 0)).alias("done"))
    state = shared.keep(state, "dual")
    for _ in range(STEPS):
        if state.filter("not done").isEmpty():
            break
        open_ = state.filter("not done")
        r = rate(F.col("size"), cap)
        words = F.col("copies") * F.col("size")
        sums = (sizes.join(open_.select("key", "multiplier", "mean", "full"), "key").groupBy("key")
                .agg(F.sum(words * r).alias("expected"),
                     F.sum(F.when(r < cap, words * r * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope")))
        gap = F.col("expected") - F.col("target")
        bound = 1 + F.abs("multiplier")
        step = F.when(F.col("slope") > 0, gap / F.col("slope")).otherwise(F.signum(gap) * bound)
        new = F.col("multiplier") - F.greatest(-bound, F.least(bound, step))
        moved = state.join(sums, "key", "left").withColumns({
            "low": F.when(~F.col("done") & (gap < 0), F.col("multiplier")).otherwise(F.col("low")),
            "high": F.when(~F.col("done") & (gap >= 0), F.col("multiplier")).otherwise(F.col("high")),
            "near": F.col("done") | (F.abs(gap) <= CLOSE * F.col("target")), "new": new})
        middle = (F.col("low") + F.col("high")) / 2
        state = shared.keep(moved.select(
            "key", "source_size", "target", "full", "mean",
            F.when(F.col("near"), F.col("multiplier")).when((F.col("new") > F.col("low")) & (F.col("new") < F.col("high")), F.col("new"))
            .otherwise(middle).alias("multiplier"), "low", "high",
            (F.col("near") | (F.col("high") - F.col("low") < 1e-12)).alias("done")), "dual")
    return state.select("key", "source_size", "target", "full", "mean", "multiplier")


def _draw(rows: DataFrame, plan: DataFrame, cap: int = CAP) -> DataFrame:
    """Rows with their source's plan, whole (sure copies) and luck (an extra copy where it lies below the shift)."""
    joined = rows.join(plan, "key").withColumn("rate", rate(F.col("size"), cap))
    whole = F.floor("rate")
    u = shared.unit(F.col("doc_id"), F.col("key"), F.col("size"), seed=SEED)
    return joined.withColumn("whole", whole).withColumn(
        "luck", F.when(whole >= cap, F.lit(2.0)).otherwise(u - (F.col("rate") - whole)))


def size_class(size: Column, mean: Column) -> Column:
    """0 for documents of the mean size or more, then 1 and 2 for ever smaller ones."""
    return F.when(size >= mean, 0).when(size * 4 >= mean, 1).otherwise(2)


def _class_shift(drawn: DataFrame, need: DataFrame) -> DataFrame:
    """key, shift and got: the shift whose extra copies' words (got) come nearest to ``need``."""
    found = need.select("key", "need", F.lit(-1.0).alias("low"), F.lit(2.0 / BINS).alias("width"), F.lit(0.0).alias("below"))
    for last in (False, True):
        at = F.floor((F.col("luck") - F.col("low")) / F.col("width")).cast("int")
        inside = drawn.join(found, "key").filter((F.col("luck") < 1.5) & at.between(0, BINS - 1))
        bins = inside.groupBy("key", at.alias("bin")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        steps = (bins.join(found, "key").withColumn("before", F.col("below") + F.coalesce(F.sum("words").over(run), F.lit(0)))
                 .withColumn("edge", F.col("low") + F.col("bin") * F.col("width")))
        if not last:
            pick = steps.groupBy("key").agg(  # the bin that reaches the need, or the first or the last one
                F.coalesce(F.max(F.when(F.col("before") <= F.col("need"), F.struct("bin", "edge", "before"))),
                           F.min(F.struct("bin", "edge", "before"))).alias("b"),
                F.first("need").alias("need"), F.first("width").alias("width"))
            found = shared.keep(pick.select("key", "need", F.col("b.edge").alias("low"),
                                            (F.col("width") / BINS).alias("width"), F.col("b.before").alias("below")), "bins")
    ends = F.explode(F.array(F.struct(F.col("edge").alias("shift"), F.col("before").alias("got")),
                             F.struct((F.col("edge") + F.col("width")).alias("shift"),
                                      (F.col("before") + F.col("words")).alias("got")))).alias("end")
    best = F.min_by("end", F.struct(F.abs(F.col("end.got") - F.col("need")), F.col("end.shift"))).alias("end")
    return steps.select("key", "need", ends).groupBy("key").agg(best).select("key", "end.*")


def _shift(drawn: DataFrame) -> DataFrame:
    """key and the shift of each size class: large documents are rounded first, and smaller ones take up the rest."""
    drawn = shared.keep(drawn.select("key", "size", "luck", (F.col("size") * (F.col("rate") - F.col("whole"))).alias("extra"),
                                     size_class(F.col("size"), F.col("mean")).alias("class")), "drawn")
    out = shared.keep(drawn.groupBy("key").agg(F.lit(0.0).alias("carry"), *[
        F.coalesce(F.sum(F.when(F.col("class") == c, F.col("extra"))), F.lit(0.0)).alias(f"extra{c}") for c in range(3)]), "extras")
    for c in range(3):
        own = drawn.filter(F.col("class") == c)
        found = _class_shift(own, out.select("key", (F.col(f"extra{c}") + F.col("carry")).alias("need")))
        out = shared.keep(out.join(found, "key", "left").withColumns({
            "carry": F.col("carry") + F.col(f"extra{c}") - F.coalesce("got", F.lit(0.0)),
            f"shift{c}": F.coalesce("shift", F.lit(0.0))}).drop("shift", "got"), "shift")
    return out.select("key", *[f"shift{c}" for c in range(3)])


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """What each source's rows need to know their copies; ``rows`` has doc_id, source, key and size (a written table)."""
    goals = shared.keep(targets(rows, weights, cap), "goals")
    sizes = shared.keep(rows.groupBy("key", "size").agg(F.count(F.lit(1)).alias("copies")), "sizes")
    solved = balance(sizes, goals, cap)
    solved = shared.keep(solved, "solved")
    return solved.join(_shift(_draw(rows, solved, cap)), "key")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       source_key(F.col("source")).alias("key"), n_words(F.col("text")).alias("size"))


def copies(rows: DataFrame, planned: DataFrame, cap: int = CAP) -> DataFrame:
    """The rows with copies and their source's plan."""
    own = F.element_at(F.array("shift0", "shift1", "shift2"), size_class(F.col("size"), F.col("mean")) + 1)
    extra = F.col("luck") < own
    return _draw(rows, planned, cap).withColumn(
        "copies", F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("whole") + F.when(extra, 1).otherwise(0)).cast("int"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and rate of every row."""
    rows = shared.keep(sized(docs), "sized")
    return copies(rows, plan(rows)).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        "copies", "rate")


def repeat(docs: DataFrame) -> DataFrame:
    """The documents, each as often as the mix takes it, with the columns they came with."""
    planned = shared.keep(plan(shared.keep(sized(docs), "sized")), "plan")
    row = F.struct(*[F.col(c) for c in docs.columns])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("key"),
                       n_words(F.col("text")).alias("size"), row.alias("row"))
    return (copies(rows, planned).select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row"))
            .select("row.*"))
