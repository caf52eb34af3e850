"""The numbered queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .common import table
from .decontamination import contamination
from .html_extraction import extracted
from .importance_resampling import resampled
from .lm_scoring import scored
from .near_dedup import near_duplicates
from .prefix_trie import prefix_trie
from .quality_rules import judged
from .secret_scan import secret_digests
from .simhash_dedup import simhash_duplicates
from .source_mixing import mix
from .token_packing import packed
from .toxicity import scores
from .warc_store import archived

#: How many words a context of op2 has at most.
CONTEXT_WORDS = 3


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), threshold=85)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), longest=CONTEXT_WORDS, chunk_tokens=1_000_000)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed", "base_failed", "kept"]
    return judged(table(spark, sf_dir, "documents")).select(*digest)


def op6_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages")).drop("url")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf_dir, "documents"), distance=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_secret_scan": op3_secret_scan,
    "op4_html_extraction": op4_html_extraction,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_packing": op6_token_packing,
    "op7_warc": op7_warc,
    "op8_source_mixing": op8_source_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_decontamination": op10_decontamination,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_simhash_near_dedup": op13_simhash_near_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op5_quality_rules": oracles.OP5_RULES,
    "op7_warc": oracles.OP7_WARC,
    "op10_decontamination": oracles.OP10_DECONTAMINATION,
    "op11_prefix_trie": oracles.OP11_TRIE,
    "op12_importance_resampling": oracles.OP12_RESAMPLING,
}
