"""A folder for what a query writes and reads back; small tables dealt to all cores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, which driver and executors share; a temporary folder on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="tidemark-"))
        named = _OWN[0]
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(table: DataFrame) -> DataFrame:
    """A table of fewer splits than cores, dealt row by row to all cores; any other as it lies, without a shuffle.

    A split holds 128 MB at most, so that the bytes moved are bounded by the cores and don't grow with the data. A file with a
    single row group is one task's work however many splits it has.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table
