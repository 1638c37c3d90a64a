"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), _vocabulary())


def op5_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import lm_scores

    return lm_scores(_table(spark, sf_dir, "documents"))


def op6_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_digest

    return bpe_digest(_table(spark, sf_dir, "documents"), _vocabulary())


def op8_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(_table(spark, sf_dir, "documents"))


def op9_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii_spans

    return pii_spans(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


def op11_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import top_documents

    return top_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import COUNTS, judged

    return judged(_table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import damaged, repaired_conversations

    return repaired_conversations(damaged(_table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_quality_discriminant": op2_quality_discriminant,
        "op3_exact_topk": op3_exact_topk,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_backoff_automaton": op5_backoff_automaton,
        "op6_string_kernel_toxicity": op6_string_kernel_toxicity,
        "op7_bpe_codec": op7_bpe_codec,
        "op8_feistel_sharding": op8_feistel_sharding,
        "op9_weak_supervision_pii": op9_weak_supervision_pii,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_threshold_search": op11_threshold_search,
        "op12_quality_rules": op12_quality_rules,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return {
        "op1_ngram_jaccard_join": oracles.OP1,
        "op3_exact_topk": oracles.OP3,
        "op8_feistel_sharding": oracles.op8(),
        "op10_exact_dedup": oracles.OP10,
        "op11_threshold_search": oracles.OP11,
        "op12_quality_rules": oracles.OP12,
        "op13_conversation_repair": oracles.op13(),
    }
