"""What Python workers need to run this package's functions, and where intermediate results lie."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started: its folder goes on their search path."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "")
    if ROOT not in paths.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, paths) if x)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder (spark.checkpoint.dir), so that later jobs neither repeat its work nor depend on one executor.

    Where no folder is set, a session on one machine takes a temporary one; executors elsewhere couldn't read that, so there it is an error.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tickforge-"))
    return df.checkpoint(eager=True)
