"""Rolling windows of trading days. A symbol's series is as long as the calendar, so no window partition grows with trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.config import Windows
from tickloom.schemas import LOW_VALID_DAYS


def frame(windows: Windows = Windows()):
    return Window.partitionBy("Symbol").orderBy("Date").rowsBetween(1 - windows.length, Window.currentRow)


def full_windows(dense: DataFrame, windows: Windows = Windows(), **totals: str) -> DataFrame:
    """Symbol, Date and the named totals of each full window; a symbol with too few days has none."""
    by = frame(windows)
    numbered = dense.withColumn("rn", F.row_number().over(Window.partitionBy("Symbol").orderBy("Date")))
    for name, of in totals.items():
        numbered = numbered.withColumn(name, F.sum(F.expr(of)).over(by))
    return numbered.where(F.col("rn") >= windows.length).select("Symbol", "Date", *totals)


def rolling_totals(dense: DataFrame, windows: Windows = Windows()) -> DataFrame:
    return full_windows(dense, windows, sum_b="B", sum_s="S")


def valid_days(dense: DataFrame, windows: Windows = Windows()) -> DataFrame:
    """Days with trades in each full window."""
    return full_windows(dense, windows, valid_days="CAST(B + S > 0 AS INT)")


def gated(dense: DataFrame, windows: Windows = Windows()) -> DataFrame:
    """Full windows with the reason why one cannot be estimated, or null."""
    return valid_days(dense, windows).withColumn("skip_reason", F.when(F.col("valid_days") < windows.min_valid, LOW_VALID_DAYS))
