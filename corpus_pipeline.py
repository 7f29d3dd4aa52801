"""From raw documents to packed sequences: five stages, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm import exact_dedup, ngram_jaccard, packing, quality_knn, secret_scan
from cellwright.llm.queries import table, tokenizer_path
from cellwright.llm.storage import Scratch

#: Words that a worker of the last stage remembers in each of two generations: fewer than packing by itself, as memory of earlier stages is still held.
MEMO_WORDS = 200_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_knn.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact_dedup.drop_exact_copies(docs, Scratch(spark, "exact"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays."""
    return ngram_jaccard.drop_near_copies(docs, Scratch(spark, "near"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays.  ``n_chars`` follows the text."""
    out = secret_scan.redact(docs, Scratch(spark, "secrets"))
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in out.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, by piece, with the ids."""
    path = tokenizer_path("word_bpe_49k.json")
    return packing.pack(docs, Scratch(spark, "packed"), lambda: packing.memo_of(path, MEMO_WORDS).encode, keep_ids=True)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("secrets", secrets), ("packed", packed)]

#: The classifier, the tokenizer and the schedule are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet and read again.

    A stage's own tables, and the rows it has read, are removed once its rows are written.
    """
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch.scope(name):
            docs = scratch.put(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
