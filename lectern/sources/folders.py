"""Where the library keeps tables of its own."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def work_dir(spark: SparkSession) -> str:
    """The folder for tables the library keeps for itself: ``spark.checkpoint.dir``, on a local master a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="lectern-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own
