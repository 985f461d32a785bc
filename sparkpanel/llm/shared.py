"""Tables kept in the shared folder, to cut lineage and to survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpanel.session import checkpoint_dir


def root(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and go on from the written table."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Delete the tables that this application kept; results not yet written need them."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def doc_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and the text (null: empty); other columns go, so names can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"), *[F.col(c) for c in more])


def unit(*cols: Column, seed: int) -> Column:
    """A uniform number in (0, 1) that depends on the columns and the seed alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 12)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def salted_join(rows: DataFrame, groups: DataFrame, key: list[str], salt: Column, salts: int = 32) -> DataFrame:
    """Left join of rows with one row a key, where a key may hold a third of all rows: each
    group's row is copied ``salts`` times and each row meets one copy."""
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    own = F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int")
    return rows.withColumn("_salt", own).join(copies, [*key, "_salt"], "left").drop("_salt")


def keep_rows(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The documents whose decision is kept, with the columns they came with.

    ``decisions`` has doc_id, text_hash (``text_hash`` of the text) and kept, one row a document.
    Of documents equal in both, as many stay as decisions say.
    """
    number, text, mine, stay, n = unused(docs, "doc_number", "hash_of_text", "own_hash", "n_stay", "n_rows")
    own = (decisions.groupBy(F.col("doc_id").alias(number), F.col("text_hash").alias(text))
           .agg(F.count(F.lit(1)).alias(n), F.count_if("kept").alias(stay)).filter(F.col(stay) < F.col(n)))
    own = keep(own.select(number, text, stay), "dropped")
    hashed = docs.withColumn(mine, text_hash(F.col("text")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(number)) & (F.col(mine) == F.col(text))
    out = hashed.join(own, same, "left_anti").drop(mine)
    some = own.filter(F.col(stay) > 0)
    if not some.isEmpty():  # repeated rows: one of them stays
        out = out.unionByName(hashed.join(some, same, "left_semi").dropDuplicates(["doc_id", mine]).drop(mine))
    return out


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as make it no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


FILTER_BITS = 1 << 23


def bitmap(keys: DataFrame, column: str):
    """A bitmap of FILTER_BITS (1 MB) over a long column: more keys make it less sharp, not wrong."""
    import numpy as np
    bit = F.col(column).bitwiseAND(F.lit(FILTER_BITS - 1))
    words = (keys.select(F.shiftright(bit, 5).alias("word"),
                         F.expr(f"shiftleft(1L, cast({column} & 31 as int))").alias("bits"))
             .groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas())
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def in_bitmap(bits, values):
    """Which of the int64 values have their bit set."""
    import numpy as np
    at = values.astype(np.int64) & (FILTER_BITS - 1)
    return (bits[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) != 0
