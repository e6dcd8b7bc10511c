"""A corpus pipeline over ``documents``: toxicity, near-duplicates, benchmark decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Rows with a null doc_id pass the filters as documents of their own;
rows that repeat a doc_id must repeat its text, and stay or go together. An empty table passes through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm._spark import dealt, stored, table
from cadenza.llm.decontam import find_leaks
from cadenza.llm.mixing import Mix, sampled
from cadenza.llm.neardup import NearDup, near_duplicates
from cadenza.llm.queries import tokenizer_path
from cadenza.llm.tokenstore import tokenized
from cadenza.llm.toxicity import ToxicityFit, score, train

#: SQL can't train the classifier, run the tokenizer or draw the signatures; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def _own(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("doc_id", "text")]


def _bare(docs: DataFrame) -> DataFrame:
    """doc_id, text and, in one struct, all other columns, so that no name of theirs meets one of an operator's."""
    rest = F.struct(*[F.col(f"`{c}`") for c in _own(docs)]) if _own(docs) else F.lit(None).cast("struct<none:string>")
    return docs.select("doc_id", "text", rest.alias("rest"))


def _same(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, in their order, from rows of ``_bare``."""
    return df.select(*[F.col(f"rest.`{c}`").alias(c) if c in _own(docs) else F.col(c) for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of these documents, doesn't reject."""
    op = ToxicityFit()
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    model = train(text, table(spark, sf_dir, "labels"), op)
    return _same(score(_bare(docs), model, with_sentences=False).where(F.col("score") < op.threshold), docs)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    gone = near_duplicates(docs, NearDup(words=5, threshold=(80, 100))).where(~F.col("kept")).select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return _same(find_leaks(_bare(docs), table(spark, sf_dir, "benchmark")).where(F.size("hits") == 0), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the raked mixture keeps."""
    return sampled(docs, Mix())


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token store and returns doc_id, start, n_tokens and ids_crc32 of each document, read back from it."""
    return tokenized(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicate),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents"))
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
