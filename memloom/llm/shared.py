"""Tables cut from their lineage in the folder that the cluster shares."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession, functions as F

from memloom.session import new_dir


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as Parquet in the shared folder and read again: lost executors don't cost its lineage again."""
    at = new_dir(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def drop(table: DataFrame) -> None:
    """Deletes a table that `cut` wrote and no later step reads, and lets Spark clear the files of exchanges that are done with."""
    spark = table.sparkSession
    for at in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    free(spark)


def free(spark: SparkSession) -> None:
    """Lets Spark clear the files of exchanges that nothing refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fold(id_col: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n
