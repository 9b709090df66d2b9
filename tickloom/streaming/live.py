"""The same bars and daily counts on a stream of ticks. Late ticks within ``late`` still count; results come once their interval has closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.bars import time_bars


def live_bars(ticks: DataFrame, every: str = "1 minute", late: str = "10 minutes", tie: str | None = None) -> DataFrame:
    """Time bars of a stream; its event time is a timestamp with zone, as watermarks need."""
    return time_bars(ticks.withWatermark("Datetime", late), every, tie)


def live_daily(ticks: DataFrame, late: str = "1 day") -> DataFrame:
    """Daily buy and sell counts of a stream of signed trades with an event time."""
    day = F.window("Datetime", "1 day").alias("w")
    counted = ticks.where(F.col("LR").isin(1, -1)).withWatermark("Datetime", late).groupBy("Symbol", day)
    return counted.agg(F.sum((F.col("LR") == 1).cast("int")).alias("B"), F.sum((F.col("LR") == -1).cast("int")).alias("S")).select("Symbol", F.to_date("w.start").alias("Date"), "B", "S")
