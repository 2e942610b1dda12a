"""Tables in the folder that the cluster shares, and unions."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where none is set and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or "file://" + tempfile.mkdtemp(prefix="spark-tables-")).rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """The table written to the folder that the cluster shares (spark.checkpoint.dir, or one of our own where none is set) and read back.

    Use it before a table that is costly to make is read several times.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, most: int | None = None) -> DataFrame:
    """A scan of fewer partitions than the cluster has cores, dealt over all of them before costly work on each row; a larger one stays as it is.

    With ``most`` it is dealt over as many as have about so many rows each, so a task doesn't grow with the table; that counts the rows, which a Parquet scan does from its footers.
    Use it on scans and on narrow steps over them: to count the partitions of a shuffled plan would run its shuffles.
    """
    parts = df.sparkSession.sparkContext.defaultParallelism
    if most:
        parts = max(parts, -(-df.count() // most))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts by column name, missing columns as null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
