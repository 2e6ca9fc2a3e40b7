"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

1. toxicity: documents that the multiple-instance model rejects go.
2. near_dedup: of each component of near-duplicates (5-word shingles, similarity 0.8) the smallest id stays.
3. substring_dedup: words of passages of 20 words or more that occur earlier go; a document left without words goes.
4. mix: documents are repeated or left out so that sources meet their target weights.
5. encode: byte-level BPE ids, with a check that they decode to the text.

Rows with a null id pass the second stage untouched; a null text counts as empty in all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from memloom.llm import bpe, minhash, mixing, substrings, toxicity
from memloom.llm.queries import table, tokenizer_path
from memloom.llm.shared import cut, fold


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = minhash.near_duplicates(docs, k=5, percent=80).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    more = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    kept = substrings.remove_repeats(docs, keep=more, unchanged=True).where((F.col("n_words") == 0) | (F.col("n_removed") < F.col("n_words")))
    return kept.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.taken_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_checked(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("substring_dedup", drop_repeated_passages), ("mix", mix), ("encode", encode)]
#: Training, hashing and tokenising can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
