"""The registered queries of this subpackage; their SQL, where SQL can express them, is in :mod:`.oracle`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm.bpe_stream import bpe_round_trip
from lorebase.llm.changes import apply_changes
from lorebase.llm.jaccard import jaccard_components
from lorebase.llm.merkle import proofs
from lorebase.llm.mixing import mix
from lorebase.llm.oracle import oracle_sql  # noqa: F401
from lorebase.llm.pii import pii_spans
from lorebase.llm.ppm import lm_scores
from lorebase.llm.quality import quality
from lorebase.llm.search import top_k
from lorebase.llm.simhash import near_duplicates
from lorebase.llm.substring_dedup import remove_repeated_words
from lorebase.llm.suffix_dedup import remove_repeated_bytes
from lorebase.llm.token_counts import token_counts


def tokenizer(file: str) -> str:
    """Where a public vocabulary file lies on this machine; executors have the same package."""
    import public_tokenizers

    return public_tokenizers.path(file)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=3)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir), weights=(3, 1, 2), budget_share=1.5, max_epochs=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), limit=1024)


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(documents(spark, sf_dir)).drop("scored")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(documents(spark, sf_dir), length=20, payload=False)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(documents(spark, sf_dir), length=100)


def op8_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return top_k(docs, docs["doc_id"] % 20 == 0, k=10)


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir), one_in=10)


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), payload=False)


def op11_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), words=5, percent=80)


def op12_apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_changes(spark.read.parquet(f"{sf_dir}/client_changes.parquet")).drop("n")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    lost = F.when(F.crc32(docs["doc_id"].cast("string")) % 2 == 0, F.replace(docs["text"], F.lit("\n"), F.lit(""))).otherwise(docs["text"])
    return proofs(docs, {"text": lost})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_components": op1_simhash_components,
        "op2_quality_rules": op2_quality_rules,
        "op3_mix_sources": op3_mix_sources,
        "op4_token_counts": op4_token_counts,
        "op5_pii_spans": op5_pii_spans,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_suffix_array_dedup": op7_suffix_array_dedup,
        "op8_bm25_top_k": op8_bm25_top_k,
        "op9_lm_scores": op9_lm_scores,
        "op10_bpe_round_trip": op10_bpe_round_trip,
        "op11_ngram_jaccard": op11_ngram_jaccard,
        "op12_apply_changes": op12_apply_changes,
        "op13_merkle_manifest": op13_merkle_manifest,
    }
