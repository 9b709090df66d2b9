"""Tables that cut lineage, in the folder that driver and executors share, and groups dealt evenly over tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; one of our own only where that is unset and Spark runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tickloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/tickloom/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The same rows from a table written to the shared folder, so that a lost executor costs no recomputation; ``options`` are the Parquet writer's."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str, each: int = 4) -> DataFrame:
    """``df`` in ranges of ``keys``: a task for each group where groups are few, some ``each`` of them a task where they are many.

    The number is given, so adaptive execution does not merge small partitions whose work is long. ``df`` is read more than once.
    """
    groups = df.select(*keys).distinct().count()
    most = max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-groups // each))
    return df.repartitionByRange(max(1, min(4 * groups, most)), *keys)
