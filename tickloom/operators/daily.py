"""Signed trades, daily counts and the business-day panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.store import cut


def signed_trades(ticks: DataFrame) -> DataFrame:
    """Trades with a side: LR 1 is a buy, -1 a sell; others and nulls go."""
    return ticks.where(F.col("LR").isin(1, -1)).select("Symbol", "Date", (F.col("LR") == 1).cast("int").alias("is_Buy"), (F.col("LR") == -1).cast("int").alias("is_Sell"))


def daily_counts(ticks: DataFrame) -> DataFrame:
    """B and S by (Symbol, Date), however the ticks are spread over files; summed within tasks before the shuffle."""
    counted = signed_trades(ticks).groupBy("Symbol", "Date").agg(F.sum("is_Buy").alias("B"), F.sum("is_Sell").alias("S"))
    return counted.where("B > 0 OR S > 0")


def symbols(daily: DataFrame) -> DataFrame:
    return daily.select("Symbol").where("Symbol IS NOT NULL").distinct()


def calendar(daily: DataFrame) -> DataFrame:
    """Business days: the dates on which any symbol traded."""
    return daily.select("Date").where("Date IS NOT NULL").distinct()


def calendar_grid(daily: DataFrame) -> DataFrame:
    """Every symbol on every business day. The calendar is the broadcast side: it holds a date once, whatever the data's size."""
    return symbols(daily).crossJoin(F.broadcast(calendar(daily)))


def dense_daily(daily: DataFrame) -> DataFrame:
    """The panel with zeros on days without trades, counts as 32-bit integers.

    Symbols, calendar and counts are three readings of the daily table, so that is written first: the trades are read once.
    """
    daily = cut(daily, "daily")
    filled = calendar_grid(daily).join(daily, ["Symbol", "Date"], "left")
    return filled.select("Symbol", "Date", F.coalesce("B", F.lit(0)).cast("int").alias("B"), F.coalesce("S", F.lit(0)).cast("int").alias("S"))


def write_panel(dense: DataFrame, table: str, buckets: int) -> None:
    """The panel as a table of the catalog in ``buckets`` files by Symbol, each in the order of Symbol and Date.

    Read by ``read_panel``, windows over it and the ``bucketed`` estimators need neither shuffle nor sort. A bucket is a task
    of theirs, so there should be a few for each core, and no more than symbols.
    """
    laid = dense.repartition(buckets, "Symbol").sortWithinPartitions("Symbol", "Date")
    laid.write.mode("overwrite").option("compression", "zstd").bucketBy(buckets, "Symbol").sortBy("Symbol", "Date").saveAsTable(table)


def read_panel(spark: SparkSession, table: str) -> DataFrame:
    """The table that ``write_panel`` wrote. Sets the session to rely on the order of buckets that are one file each."""
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    return spark.table(table)
