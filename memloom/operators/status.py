"""Index health."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# From where on to warn, and how many duplicates to show.
MANY_FILES, MANY_CHUNKS, SHOWN = 50, 500, 5
MANY_FILES_TEXT = "{} files are indexed; fewer, larger ones are easier to keep in order."
DUPLICATES_TEXT = "The same content is in several files ({} shown): {}"
LARGE_FILES_TEXT = "Many chunks in one file: {}. Smaller files are found more precisely."


def counts(files: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, cache: DataFrame | None = None) -> DataFrame:
    """One row."""
    out = files.agg(F.count("*").alias("files"), F.count_if(F.col("source") == "memory").alias("memory_files"), F.count_if(F.col("source") == "sessions").alias("session_files"))
    out = out.crossJoin(chunks.agg(F.count("*").alias("chunks")))
    embedded = chunks.join(vectors.select("id").distinct(), "id", "left_semi").agg(F.count("*").alias("embedded_chunks")) if vectors is not None else None
    cached = cache.agg(F.count("*").alias("embedding_cache")) if cache is not None else None
    out = out.crossJoin(embedded) if embedded is not None else out.withColumn("embedded_chunks", F.lit(0).cast("long"))
    return out.crossJoin(cached) if cached is not None else out.withColumn("embedding_cache", F.lit(0).cast("long"))


def duplicate_content(chunks: DataFrame, limit: int | None = SHOWN) -> DataFrame:
    """hash, file_count, paths: content in several files, by hash."""
    rows = chunks.select("hash", "path").distinct().groupBy("hash").agg(F.count("*").alias("file_count"), F.array_join(F.array_sort(F.collect_list("path")), ",").alias("paths")).where("file_count > 1")
    return rows.orderBy("hash").limit(limit) if limit else rows


def large_files(chunks: DataFrame, most: int = MANY_CHUNKS) -> DataFrame:
    return chunks.groupBy("path").agg(F.count("*").alias("chunks")).where(F.col("chunks") > most)


def warnings(files: DataFrame, chunks: DataFrame) -> list[str]:
    out = []
    if (n := files.count()) > MANY_FILES:
        out.append(MANY_FILES_TEXT.format(n))
    if found := duplicate_content(chunks).collect():
        out.append(DUPLICATES_TEXT.format(len(found), "; ".join(r["paths"] for r in found)))
    if found := large_files(chunks).orderBy(F.col("chunks").desc(), "path").collect():
        out.append(LARGE_FILES_TEXT.format(", ".join(f"{r['path']} ({r['chunks']} chunks)" for r in found)))
    return out
