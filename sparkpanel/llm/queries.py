"""The queries of the numbered operators and of the pipeline, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (alignment, exact_dedup, importance, mining, mixing, near_dedup, packing, pii, rule_ledger, secret_scan, sharding,
               shared, token_output, tokens, toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


@register("op3_token_output")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.id_table(shared.documents(spark, sf_dir), shared.fresh(spark, "ids"),
                                 tokens.vocabulary(), end_id=2)


@register("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(shared.documents(spark, sf_dir), tokens.vocabulary(), end_id=1)


@register("op4_rule_ledger", rule_ledger.SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ledger.apply_policy(rule_ledger.ledger(shared.documents(spark, sf_dir)))


@register("op10_exact_dedup", exact_dedup.SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(shared.documents(spark, sf_dir)).drop("text_hash")


@register("op1_importance_resampling")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(shared.documents(spark, sf_dir), shared.table(spark, sf_dir, "labels"))


@register("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    return secret_scan.digest(secret_scan.scan(docs, secret_scan.learn(docs)))


@register("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(toxicity.training_rows(docs, shared.table(spark, sf_dir, "labels"))))


@register("op9_pii")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(shared.documents(spark, sf_dir)))


@register("op2_mixing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(shared.documents(spark, sf_dir))


@register("op5_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(shared.documents(spark, sf_dir)).drop("text_hash")


@register("op11_feistel_shards")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(shared.documents(spark, sf_dir))


@register("op12_hard_negatives", mining.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.hard_negatives(shared.table(spark, sf_dir, "embeddings"))


@register("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.summary(shared.documents(spark, sf_dir), tokens.vocabulary("byte_bpe_50k.json"),
                             tokens.vocabulary("piece_bpe_32k.model"))
