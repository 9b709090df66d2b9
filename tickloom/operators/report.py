"""Summaries of panels and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def panel_summary(panel: DataFrame) -> DataFrame:
    """Rows, symbols, days, and first and last date."""
    return panel.agg(F.count("*").alias("n_rows"), F.countDistinct("Symbol").alias("n_symbols"), F.countDistinct("Date").alias("n_days"), F.min("Date").alias("first_date"), F.max("Date").alias("last_date"))


def measure_summary(result: DataFrame, measure: str) -> DataFrame:
    """Rows, symbols, and the range and mean of a measure without its nulls."""
    return result.agg(F.count("*").alias("n_rows"), F.countDistinct("Symbol").alias("n_symbols"), F.min(measure).alias("lowest"), F.max(measure).alias("highest"), F.avg(measure).alias("mean"))


def lower_names(df: DataFrame) -> DataFrame:
    """``df`` with its column names in lower case."""
    return df.toDF(*(c.lower() for c in df.columns))


def report(result: DataFrame, measure: str) -> DataFrame:
    """One row of text about a result: counts with thousands separators, the share that is estimated, and the measure's range; says so where nothing is."""
    found = F.count(measure)
    share = F.when(F.count("*") > 0, 100.0 * found / F.count("*"))
    text = lambda x: F.format_number(x, 4)
    return result.agg(
        F.format_number(F.count("*"), 0).alias("n_rows"),
        F.format_number(F.countDistinct("Symbol"), 0).alias("n_symbols"),
        F.concat(F.format_number(share, 1), F.lit("%")).alias("estimated"),
        text(F.min(measure)).alias("lowest"),
        text(F.max(measure)).alias("highest"),
        text(F.avg(measure)).alias("mean"),
        F.when(F.count("*") == 0, "no result: no symbol has enough data").when(found == 0, "no result: no estimate succeeded").otherwise("ok").alias("outcome"),
    )


def reasons(result: DataFrame) -> DataFrame:
    """How many windows have each reason; nulls are a group of their own."""
    return result.groupBy("skip_reason").agg(F.count("*").alias("n"))


def success(result: DataFrame) -> DataFrame:
    """Windows, those with an estimate, those without, and the rate."""
    good = F.sum(F.when(F.col("skip_reason") == "Success", 1).otherwise(0))
    return result.agg(F.count("*").alias("n"), good.alias("n_success"), (F.count("*") - good).alias("n_skipped"), (good / F.count("*")).alias("rate"))
