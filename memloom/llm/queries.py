"""The queries of the llm operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from memloom.llm import bpe, idstore, langid, media, minhash, mixing, pitmanyor, substrings, toxicity, vectors
from memloom.llm.shared import fold
from memloom.session import new_dir

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, fold("doc_id", 5) != 0)
    return langid.predict(docs, model).withColumn("held_out", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents"))


def op3_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return toxicity.score(docs, model).withColumn("held_out", F.coalesce(fold("doc_id", 5) == 0, F.lit(False))).withColumn("offending", F.to_json("offending"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, path = new_dir(spark, "idstore"), tokenizer_path()
    idstore.write_store(table(spark, sf_dir, "documents"), at, path)
    return idstore.document_digests(spark, at, bpe.codec(path).unit.str)


def op7_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitmanyor.score(table(spark, sf_dir, "documents"), rest=2, of=7)


def op9_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_media_columns": op2_media_columns,
    "op3_recompression": op3_recompression,
    "op4_toxicity": op4_toxicity,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_id_store": op6_id_store,
    "op7_superminhash": op7_superminhash,
    "op8_pitman_yor": op8_pitman_yor,
    "op9_cross_polytope": op9_cross_polytope,
    "op10_mix_sources": op10_mix_sources,
}
ORACLES: dict[str, str] = {}
