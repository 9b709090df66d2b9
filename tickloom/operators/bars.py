"""Time bars of ticks and what is asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tick_datetime(date: str = "Date", time_ns: str = "Time") -> Column:
    """Date and nanoseconds since midnight as a timestamp without zone, truncated to microseconds."""
    return F.expr(f"to_timestamp_ntz({date}) + make_dt_interval(0, 0, 0, CAST({time_ns} div 1000 AS DECIMAL(18,0)) / 1000000)")


def to_utc(local: str | Column, zone: str) -> Column:
    """A timestamp without zone that is local to ``zone``, in UTC."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)


def date_in(utc: str | Column, zone: str) -> Column:
    """The date in ``zone`` at a timestamp without zone in UTC."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc))


def time_bars(ticks: DataFrame, every: str = "1 minute", tie: str | None = None) -> DataFrame:
    """Open, Close and Volume of each interval [t, t+every) with trades of positive volume.

    Ticks have Symbol, Datetime, Price and Volume. ``tie`` orders those of one instant, which a Datetime of whole microseconds
    does not; without it that is the column Time, the nanoseconds of the tick, and an error where there is none. Price and
    volume then order what is left, so that a bar does not depend on the order of the rows. A bar is one group however its
    ticks are spread over files.
    """
    tie = tie or ("Time" if "Time" in ticks.columns else None)
    if tie is None:
        raise ValueError("ticks without a column Time need a tie, which orders ticks of one instant")
    order = F.struct("Datetime", tie, "Price", "Volume")
    bars = ticks.where("Volume > 0").groupBy("Symbol", F.window("Datetime", every).alias("w"))
    return bars.agg(F.min_by("Price", order).alias("Open"), F.max_by("Price", order).alias("Close"), F.sum("Volume").alias("Volume")).select("Symbol", F.col("w.start").alias("Datetime"), "Open", "Close", "Volume")


def clean_bars(bars: DataFrame) -> DataFrame:
    """Bars without missing or non-positive values."""
    kept = bars.where("Datetime IS NOT NULL AND Open IS NOT NULL AND Close IS NOT NULL AND Volume IS NOT NULL")
    return kept.where("NOT isnan(Open) AND NOT isnan(Close) AND NOT isnan(Volume) AND Open > 0 AND Close > 0 AND Volume > 0")


def liquid_symbols(bars: DataFrame, least: int = 500) -> DataFrame:
    """Symbols with at least ``least`` bars, and their number."""
    return bars.where("Symbol IS NOT NULL").groupBy("Symbol").agg(F.count("*").alias("n_bars")).where(F.col("n_bars") >= least)


def moved_share(bars: DataFrame) -> DataFrame:
    """Bars, those that close elsewhere than they open, and their percentage."""
    moved = F.sum(F.when(F.col("Open") != F.col("Close"), 1).otherwise(0))
    return bars.agg(F.count("*").alias("n_bars"), moved.alias("n_moved"), (F.lit(100.0) * moved / F.count("*")).alias("pct_moved"))


def pseudo_ticks(bars: DataFrame) -> DataFrame:
    """Each bar as a tick of no volume at its opening and one of its volume a second later at its close."""
    two = F.array(
        F.struct(F.col("Datetime").alias("ts"), F.col("Open").alias("price"), F.lit(0.0).alias("volume")),
        F.struct((F.col("Datetime") + F.expr("INTERVAL 1 SECOND")).alias("ts"), F.col("Close").alias("price"), F.col("Volume").alias("volume")),
    )
    return bars.select("Symbol", F.explode(two).alias("t")).select("Symbol", "t.ts", "t.price", "t.volume")


def in_order(bars: DataFrame) -> DataFrame:
    """Bars by symbol and time, over all partitions in their order; a symbol with many bars may reach over several."""
    return bars.repartitionByRange("Symbol", "Datetime").sortWithinPartitions("Symbol", "Datetime")
