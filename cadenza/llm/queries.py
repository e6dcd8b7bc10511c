"""One query for each corpus operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import dealt, in_few_files, parts_for, table
from .chat import TURNS, canonical_turns, digests, format_turns
from .decontam import leaks
from .mixing import mixed
from .neardup import NearDup, near_duplicates
from .quality import BASE, ledger, passes
from .ring import shard
from .secrets import secrets
from .subdedup import dedup_substrings
from .tokenstore import tokenized
from .toxicity import flag

#: Bytes of texts whose short result rows make one file.
RESULT_BYTES = 512 << 20


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The public vocabulary file's place; a parameter of the operator, looked up here only."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(dealt(table(spark, sf_dir, "documents")), NearDup(words=3, threshold=(85, 100)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return flag(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")))
    base = ~passes(BASE)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & passes()).alias("kept"), "failures")


def op3_consistent_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = canonical_turns(table(spark, sf_dir, "conversations"))
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], TURNS)
    return digests(format_turns(turns.unionByName(more)))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
    return in_few_files(kept, parts_for(docs, RESULT_BYTES))
