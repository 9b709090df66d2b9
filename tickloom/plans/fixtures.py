"""Ticks made of the driver's tables by Spark, and the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lineitem_ticks(spark: SparkSession, sf_dir: str, symbol: str) -> DataFrame:
    sold = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    lr = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1)
    return sold.select(F.expr(symbol).alias("Symbol"), F.to_date("l_shipdate").alias("Date"), lr.cast("tinyint").alias("LR"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("Price"), F.col("l_quantity").alias("Volume"))


def nation_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol for each nation of a supplier."""
    return _lineitem_ticks(spark, sf_dir, "n_name")


def region_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol for each region: fewer and denser series."""
    return _lineitem_ticks(spark, sf_dir, "CAST(n_regionkey AS STRING)")


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol for each event type."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("Symbol"), F.col("ts").alias("Datetime"), F.col("value").alias("Price"), F.col("value").alias("Volume"), "event_id")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a raw numeric export: days since 1960, seconds since midnight, padded symbols, sides as doubles, some of all missing as null or NaN."""
    events = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    user, nan = F.col("user_id"), F.lit(float("nan"))

    def missing(value, k: int):
        return F.when(user % 11 == k, nan).when(user % 13 != k, value)

    micros = F.expr("unix_micros(CAST(ts AS TIMESTAMP)) - unix_date(to_date(ts)) * 86400000000")
    return events.select(
        "event_id",
        missing(F.datediff(day, F.lit("1960-01-01").cast("date")).cast("double") + 0.25, 1).alias("Date"),
        missing(micros / 1e6, 2).alias("Time"),
        F.when(F.col("user_id") % 7 == 0, "nan").otherwise(F.concat(F.lit(" \t"), "event_type", F.lit("  "))).alias("Symbol"),
        F.when(user % 17 == 0, nan).when(user % 3 == 0, 1.0).when(user % 3 == 1, -1.0).alias("LR"),
        F.col("value").alias("Price"),
        F.col("value").cast("float").alias("Volume"),
    )


def _lineitem_sql(symbol: str) -> str:
    return f"""ticks AS (SELECT {symbol} AS Symbol, CAST(l_shipdate AS DATE) AS Date, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 END AS LR
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
daily AS (SELECT Symbol, Date, sum((LR = 1)::INT)::BIGINT AS B, sum((LR = -1)::INT)::BIGINT AS S FROM ticks WHERE LR IN (1, -1) GROUP BY ALL),
dense AS (SELECT s.Symbol, c.Date, coalesce(B, 0)::INT AS B, coalesce(S, 0)::INT AS S FROM (SELECT DISTINCT Symbol FROM daily) s CROSS JOIN (SELECT DISTINCT Date FROM daily) c
    LEFT JOIN daily d ON d.Symbol = s.Symbol AND d.Date = c.Date)"""


NATION_SQL = _lineitem_sql("n_name")
REGION_SQL = _lineitem_sql("CAST(n_regionkey AS VARCHAR)")
EVENT_SQL = "ticks AS (SELECT event_type AS Symbol, ts AS Datetime, value AS Price, value AS Volume, event_id FROM events)"
RAW_SQL = """raw AS (SELECT event_id, CASE WHEN user_id % 11 = 1 THEN 'nan'::DOUBLE WHEN user_id % 13 <> 1 THEN date_diff('day', DATE '1960-01-01', CAST(ts AS DATE))::DOUBLE + 0.25 END AS Date,
    CASE WHEN user_id % 11 = 2 THEN 'nan'::DOUBLE WHEN user_id % 13 <> 2 THEN (epoch_us(ts) - epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP)))::DOUBLE / 1e6 END AS Time,
    CASE WHEN user_id % 7 = 0 THEN 'nan' ELSE chr(32) || chr(9) || event_type || '  ' END AS Symbol,
    CASE WHEN user_id % 17 = 0 THEN 'nan'::DOUBLE WHEN user_id % 3 = 0 THEN 1.0 WHEN user_id % 3 = 1 THEN -1.0 END::DOUBLE AS LR, value AS Price, value::FLOAT AS Volume FROM events)"""


def bars_sql(every: str) -> str:
    return f"""{EVENT_SQL}, bars AS (SELECT Symbol, time_bucket(INTERVAL '{every}', Datetime) AS Datetime, first(Price ORDER BY Datetime, event_id) AS Open,
    last(Price ORDER BY Datetime, event_id) AS Close, sum(Volume) AS Volume FROM ticks WHERE Volume > 0 GROUP BY Symbol, time_bucket(INTERVAL '{every}', Datetime))"""
