"""One registered query per operator, over whole tables, and the SQL that states it where it can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stopscan.llm import (
    additive_quality,
    bloom_lm,
    crf_language,
    cuckoo_dedup,
    decontamination,
    pfair_mix,
    prefix_trie,
    simhash,
    slot_sharding,
    structure_repair,
    token_counts,
    toxic_segments,
    warc_zstd,
)
from stopscan.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable:
    def keep(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


@register("op1_decontaminate")
def _decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"),
                                        table(spark, folder, "benchmark"))


@register("op2_simhash")
def _simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@register("op3_exact_dedup", cuckoo_dedup.SQL)
def _exact(spark: SparkSession, folder: str) -> DataFrame:
    return cuckoo_dedup.exact_duplicates(table(spark, folder, "documents"))


@register("op4_mix_sources", pfair_mix.SQL)
def _mix(spark: SparkSession, folder: str) -> DataFrame:
    return pfair_mix.interleave(table(spark, folder, "documents"))


@register("op8_shard")
def _shard(spark: SparkSession, folder: str) -> DataFrame:
    return slot_sharding.sharded(table(spark, folder, "documents"))


@register("op5_language")
def _language(spark: SparkSession, folder: str) -> DataFrame:
    return crf_language.languages(table(spark, folder, "documents"))


@register("op6_bloom_lm")
def _lm(spark: SparkSession, folder: str) -> DataFrame:
    return bloom_lm.scored(table(spark, folder, "documents"))


@register("op7_token_counts")
def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.counted(table(spark, folder, "documents"), "word_bpe_49k.json")


@register("op9_quality")
def _quality(spark: SparkSession, folder: str) -> DataFrame:
    return additive_quality.quality(table(spark, folder, "documents"),
                                    table(spark, folder, "labels"))


@register("op10_warc")
def _warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc_zstd.round_trip(table(spark, folder, "pages"))


@register("op11_conversation_repair")
def _repair(spark: SparkSession, folder: str) -> DataFrame:
    return structure_repair.audits(table(spark, folder, "conversations"))


@register("op12_prefix_trie")
def _trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.nodes(table(spark, folder, "conversations"))


@register("op13_toxicity")
def _toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxic_segments.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register("pipeline")
def _pipeline(spark: SparkSession, folder: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, folder)
