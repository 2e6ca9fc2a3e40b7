"""What a session needs so that its Python workers find this package, and rows spread over its cores."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

HERE = str(Path(__file__).resolve().parents[1])


def make_importable(spark: SparkSession) -> None:
    """Puts the package's folder on the workers' path, wherever the driver was started. On a cluster it has to be installed."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if HERE not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (HERE, have) if x)


def input_bytes(rows: DataFrame) -> int | None:
    """Bytes of the files and local rows behind a plan; None where Spark doesn't know them."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length()))
    return size if size < 1 << 60 else None


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt to all cores where Spark's own splits would be fewer than these; larger tables stay where they are.

    A file's row groups aren't split, so a table of one small file would be one task's work.  The border is Spark's own
    least split (`spark.sql.files.openCostInBytes`) a core, so this never moves more than that.
    """
    spark = rows.sparkSession
    cores, size = spark.sparkContext.defaultParallelism, input_bytes(rows)
    small = size is not None and size < cores * spark._jsparkSession.sessionState().conf().filesOpenCostInBytes()
    return rows.repartition(cores) if small else rows


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it (`spark.checkpoint.dir`).

    Where it is unset and all run on this machine, as in tests, a temporary folder, which goes when Python ends.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or "local-cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="memloom-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        at = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
