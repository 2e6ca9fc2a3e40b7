"""Incremental sync, embedding backfill and table maintenance, as set operations on whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from memloom.functions import text as tx

EmbedFn = Callable[[list[str]], "list[list[float] | None]"]


def classify(listing: DataFrame, files: DataFrame, force: bool = False, protect_unreadable: bool = True) -> DataFrame:
    """path, source, action (skip, touch, index, delete, keep), hash, mtime_ms, size, text.

    Nothing is read of a file whose time (to the millisecond) and size are as before.  Content of an unchanged hash only
    touches the entry.  An unreadable file keeps its old rows, or loses them where that is not wanted (sessions).  A
    number `no` of files comes along.  The files are what is held of a join's two sides, so that no texts are sorted.
    """
    number = ["no"] if "no" in files.columns else []
    new = listing.select("path", "source", F.col("mtime_ms").alias("m"), F.col("size").alias("s"), "text")
    joined = new.join(files.select("path", "source", "hash", "mtime_ms", "size", *number).hint("shuffle_hash"), ["path", "source"], "full_outer")
    seen, old = F.col("m").isNotNull(), F.col("hash").isNotNull()
    same = old & (F.abs(F.col("m") - F.col("mtime_ms")) < 1) & (F.col("s") == F.col("size"))
    content = tx.content_hash(F.col("text"))
    action = (
        F.when(~seen, "delete")
        .when(same & F.lit(not force), "skip")
        .when(F.col("text").isNull(), F.when(~old, "skip").when(F.lit(protect_unreadable), "keep").otherwise("delete"))
        .when(old & (content == F.col("hash")) & F.lit(not force), "touch")
        .otherwise("index")
    )
    kept = F.when(action == "index", content).otherwise(F.col("hash"))
    changed = action.isin("index", "touch")
    return joined.select("path", "source", action.alias("action"), kept.alias("hash"), F.when(changed, F.col("m")).otherwise(F.col("mtime_ms")).alias("mtime_ms"), F.when(changed, F.col("s")).otherwise(F.col("size")).alias("size"), F.when(action == "index", F.col("text")).alias("text"), *number)


def outcome(classified: DataFrame) -> DataFrame:
    """One row: indexed, skipped, deleted. A touch counts as skipped."""
    of = lambda *a: F.count_if(F.col("action").isin(*a))
    return classified.agg(of("index").alias("indexed"), of("skip", "touch", "keep").alias("skipped"), of("delete").alias("deleted"))


def next_files(classified: DataFrame) -> DataFrame:
    return classified.where((F.col("action") != "delete") & F.col("hash").isNotNull()).select("path", "source", "hash", "mtime_ms", "size", *(c for c in classified.columns if c == "no"))


def gone(classified: DataFrame) -> DataFrame:
    """word, bits: the old numbers (`was`) of files that were indexed anew or deleted, 64 in a row."""
    by_file = classified.where("was is not null or action in ('index', 'delete')").groupBy("path", "source")
    numbers = by_file.agg(F.bool_or(F.col("action").isin("index", "delete")).alias("changed"), F.collect_set("was").alias("was")).where("changed").select(F.explode("was").alias("was"))
    return numbers.select(F.expr("shiftright(was, 6)").alias("word"), F.expr("shiftleft(1L, cast(was & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def left_of(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose number `no` isn't gone. They stay where they are: gone numbers are sent to every task, a bit each."""
    words = gone.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return rows.join(F.broadcast(words), F.expr("shiftright(no, 6)") == F.col("word"), "left").where("bits is null or getbit(bits, cast(no & 63 as int)) = 0").select(*rows.columns)


def without(rows: DataFrame, gone: DataFrame, *on: str) -> DataFrame:
    return rows.join(gone.select(*on).distinct(), list(on), "left_anti")


def keep_only(rows: DataFrame, present: DataFrame, on: str) -> DataFrame:
    return rows.join(present.select(on).distinct(), on, "left_semi")


def last_wins(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Insert or replace by key; of new rows with one key the latest `updated_at`, where there is one."""
    order = F.col("updated_at").desc() if "updated_at" in new.columns else F.lit(0)
    one = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
    return without(old, one, key).unionByName(one)


def missing_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    return without(chunks, vectors, "id")


def orphan_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    return without(vectors, chunks, "id")


def collect_cache(cache: DataFrame, chunks: DataFrame) -> DataFrame:
    """The cache without content that no chunk has."""
    return keep_only(cache, chunks, "hash")


def salvaged(vectors: DataFrame, chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """The cache with the content of chunks that have a vector, so that replaced chunks' vectors keep serving it."""
    old = vectors.join(chunks.select("id", "hash"), "id").select("hash", "embedding").dropDuplicates(["hash"])
    return cache.unionByName(without(old, cache, "hash").withColumn("updated_at", F.lit(0).cast("long")))


def embed(texts: DataFrame, embed_fn: EmbedFn, batch: int = 100) -> DataFrame:
    """hash, text -> hash, embedding; rows for which the function returns nothing are left out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), batch):
                rows = part.iloc[i : i + batch]
                got = embed_fn(rows["text"].tolist())
                keep = [v is not None and len(v) > 0 for v in got]
                yield pd.DataFrame({"hash": rows["hash"][keep], "embedding": [list(map(float, v)) for v, k in zip(got, keep, strict=True) if k]})

    return texts.select("hash", "text").mapInPandas(run, "hash string, embedding array<float>")


def backfill(chunks: DataFrame, vectors: DataFrame, cache: DataFrame, embed_fn: EmbedFn | None, now_ms: int, materialize: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """New vectors and cache: orphans swept, cached content reused by hash, the rest embedded once a hash, unused cache dropped.

    `materialize` writes a table and reads it again, so that the model runs once though two tables use its output.
    """
    kept = keep_only(vectors, chunks, "id")
    missing = missing_vectors(chunks, kept).select("id", "hash", "text")
    hits = missing.join(cache.select("hash", "embedding"), "hash").select("id", "embedding")
    new_cache = cache
    if embed_fn is not None:
        todo = without(missing, cache, "hash").dropDuplicates(["hash"])
        made = materialize(embed(todo, embed_fn))
        hits = hits.unionByName(missing.join(made, "hash").select("id", "embedding"))
        new_cache = last_wins(cache, made.withColumn("updated_at", F.lit(now_ms).cast("long")), "hash")
    return kept.unionByName(hits), collect_cache(new_cache, chunks)
