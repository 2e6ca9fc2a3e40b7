"""Sync by micro-batches: a folder of listings (as JSON or Parquet files) keeps a store up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from memloom.operators.store import Store
from memloom.schemas import LISTING

CHANGES = LISTING + ", deleted boolean"


def stream_changes(spark: SparkSession, folder: str, form: str = "json", files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_a_batch).format(form).load(folder)


def apply_changes(store: Store, changes: DataFrame) -> dict[str, dict]:
    """One batch: the last change of each file decides; files that it doesn't name stay as they are."""
    latest = Window.partitionBy("path", "source").orderBy(F.col("mtime_ms").desc(), F.coalesce("deleted", F.lit(False)).desc())
    rows = changes.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")
    done = {}
    for (source,) in rows.select("source").distinct().collect():  # memory and sessions
        own = rows.where(F.col("source") == source)
        old = store.table("files").where(F.col("source") == source)
        stay = old.join(own.select("path"), "path", "left_anti").select("path", "source", "mtime_ms", "size", F.lit(None).cast("string").alias("text"))
        done[source] = store.sync(own.where("not coalesce(deleted, false)").drop("deleted").unionByName(stay), source)
    return done


def run_sync(store: Store, changes: DataFrame, checkpoint: str, once: bool = True, every: str = "5 seconds") -> StreamingQuery:
    """Starts the stream: what is there now (`once`), or every so often. A repeated batch changes nothing more."""
    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: apply_changes(store, batch) and None)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
