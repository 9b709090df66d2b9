"""Volume-synchronised probability of informed trading, as one DataFrame plan without Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.config import VpinConfig
from tickloom.functions.normal import cdf
from tickloom.operators.bars import clean_bars, liquid_symbols

#: What rounding may do to a cumulative volume, in buckets.
SLACK = 1e-9


def least_bars(config: VpinConfig) -> int:
    return max(config.min_bars, -(-config.min_ticks // 2))


def usable_bars(bars: DataFrame, config: VpinConfig = VpinConfig()) -> DataFrame:
    """Clean bars of symbols that have enough of them."""
    cleaned = clean_bars(bars)
    return cleaned.join(liquid_symbols(cleaned, least_bars(config)).select("Symbol"), "Symbol", "left_semi")


def bucket_sizes(bars: DataFrame, config: VpinConfig = VpinConfig()) -> DataFrame:
    """vbs, the volume of one bucket on an average day, and sdp, the deviation of the bars' price changes, of each symbol."""
    days = F.countDistinct(F.to_date("Datetime"))
    return bars.groupBy("Symbol").agg((F.sum("Volume") / days / F.lit(float(config.buckets))).alias("vbs"), F.stddev_samp(F.col("Close") - F.col("Open")).alias("sdp"))


def volume_clock(bars: DataFrame) -> DataFrame:
    """Bars with the cumulative volume of their symbol before (lo) and after (hi) them.

    The window runs over a symbol's bars, whose number the calendar bounds, not the number of trades.
    """
    by = Window.partitionBy("Symbol").orderBy("Datetime").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return bars.withColumn("hi", F.sum("Volume").over(by)).withColumn("lo", F.col("hi") - F.col("Volume"))


def bucket_pieces(bars: DataFrame, config: VpinConfig = VpinConfig()) -> DataFrame:
    """The part of each bar in each bucket it reaches: bucket, piece, and buy, the share bulk classification gives to buyers."""
    sized = volume_clock(bars).join(bucket_sizes(bars, config), "Symbol").where("vbs > 0")
    scored = sized.withColumn("z", F.try_divide(F.col("Close") - F.col("Open"), F.col("sdp"))).where("z IS NOT NULL").withColumn("buy", cdf("z"))
    first = F.floor(F.col("lo") / F.col("vbs") + SLACK)
    last = F.ceil(F.col("hi") / F.col("vbs") - SLACK) - 1
    spread = scored.withColumn("bucket", F.explode(F.sequence(first, F.greatest(first, last))))
    piece = F.least("hi", (F.col("bucket") + 1) * F.col("vbs")) - F.greatest("lo", F.col("bucket") * F.col("vbs"))
    return spread.withColumn("piece", piece)


def buckets(bars: DataFrame, config: VpinConfig = VpinConfig()) -> DataFrame:
    """Full buckets with their buy and sell volume, imbalance and the times of the bars that they touch."""
    grouped = bucket_pieces(bars, config).groupBy("Symbol", "bucket").agg(
        F.min("Datetime").alias("Starttime"),
        F.max("Datetime").alias("Endtime"),
        F.sum(F.col("piece") * F.col("buy")).alias("AggBuyVol"),
        F.sum(F.col("piece") * (1 - F.col("buy"))).alias("AggSellVol"),
        F.sum("piece").alias("filled"),
        F.max("vbs").alias("vbs"),
    )
    full = grouped.where(F.col("filled") >= F.col("vbs") * (1 - 1e-6))
    return full.withColumn("AOI", F.abs(F.col("AggBuyVol") - F.col("AggSellVol")))


def vpin(bars: DataFrame, config: VpinConfig = VpinConfig(), drop_short: bool = False) -> DataFrame:
    """VPIN of each full bucket over the last ``sample`` buckets; null (or, on wish, no row) for the first ones of a symbol.

    Bucket numbers are given before rows without VPIN go.
    """
    by = Window.partitionBy("Symbol").orderBy("bucket")
    last = by.rowsBetween(1 - config.sample, Window.currentRow)
    rolled = buckets(bars, config).withColumn("rn", F.row_number().over(by)).withColumn("total", F.sum("AOI").over(last))
    value = F.when(F.col("rn") >= config.sample, F.col("total") / (config.sample * F.col("vbs")))
    out = rolled.select("Symbol", (F.col("bucket") + 1).cast("int").alias("BucketNo"), F.to_date("Endtime").alias("Date"), "Starttime", "Endtime", "AggBuyVol", "AggSellVol", "AOI", value.alias("VPIN"))
    return out.where("VPIN IS NOT NULL") if drop_short else out


def without_result(bars: DataFrame, results: DataFrame, config: VpinConfig = VpinConfig()) -> DataFrame:
    """Symbols that have bars but no VPIN, with the first reason that holds."""
    cleaned = clean_bars(bars).groupBy("Symbol").agg(F.count("*").alias("n"), F.sum("Volume").alias("volume"), F.stddev_samp(F.col("Close") - F.col("Open")).alias("sdp"))
    done = results.where("VPIN IS NOT NULL").select("Symbol").distinct()
    left = bars.select("Symbol").where("Symbol IS NOT NULL").distinct().join(done, "Symbol", "left_anti").join(cleaned, "Symbol", "left")
    error = (
        F.when(F.col("n").isNull(), "no usable bars")
        .when(F.col("n") < config.min_bars, F.concat(F.lit(f"fewer than {config.min_bars} usable bars: "), F.col("n").cast("string")))
        .when(F.col("n") * 2 < config.min_ticks, F.concat(F.lit(f"fewer than {config.min_ticks} ticks: "), (F.col("n") * 2).cast("string")))
        .when(F.coalesce("sdp", F.lit(0.0)) == 0, "price changes do not vary")
        .otherwise(f"no {config.sample} full volume buckets")
    )
    return left.select("Symbol", error.alias("error"))
