"""Queries over the driver's tables, and the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom import config
from tickloom.functions.store import cut
from tickloom.operators import bars, daily, estimates, likelihood, report, rolling, runs, vpin
from tickloom.plans import fixtures as fx
from tickloom.sources import ticks as sources

#: Hourly bars and 20 buckets a day suit the density of the events.
VPIN_CONFIG = config.VpinConfig(bar="1 hour", buckets=20, sample=50, min_bars=500)
PIN_POINT = {"a": 0.4, "d": 0.5, "u": 1.5, "eb": 1.2, "es": 1.1}
APIN_POINT = {"a": 0.4, "d": 0.5, "t1": 0.2, "t2": 0.3, "ub": 1.5, "us": 1.2, "eb": 1.1, "es": 1.0, "pb": 0.8, "ps": 0.7}

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL where there is one."""

    def keep(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return keep


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def nation_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.daily_counts(fx.nation_ticks(spark, sf_dir))


def nation_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.dense_daily(nation_daily(spark, sf_dir))


def region_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.dense_daily(daily.daily_counts(fx.region_ticks(spark, sf_dir)))


def event_bars(spark: SparkSession, sf_dir: str, every: str = "1 hour") -> DataFrame:
    return bars.time_bars(fx.event_ticks(spark, sf_dir), every, "event_id")


# Raw conversion


_DATE = "CASE WHEN NOT isnan(Date) THEN (DATE '1960-01-01' + floor(Date)::INT)::DATE END"
_NANOS = "CASE WHEN NOT isnan(Time) THEN round_even(Time * 1e9, 0)::BIGINT END"
_STAMP = f"make_timestamp(epoch_us(({_DATE})::TIMESTAMP) + ({_NANOS}) // 1000)"


@query(f"WITH {fx.RAW_SQL} SELECT event_id, {_DATE} AS Date FROM raw")
def sas_date(spark, sf_dir):
    return sources.convert_raw(fx.raw_events(spark, sf_dir)).select("event_id", "Date")


@query(f"WITH {fx.RAW_SQL} SELECT event_id, {_NANOS} AS Time FROM raw")
def sas_time_ns(spark, sf_dir):
    return sources.convert_raw(fx.raw_events(spark, sf_dir)).select("event_id", "Time")


@query(f"WITH {fx.RAW_SQL} SELECT event_id, nullif(regexp_replace(Symbol, '^\\s+|\\s+$', '', 'g'), 'nan') AS Symbol FROM raw")
def symbol_clean(spark, sf_dir):
    return sources.convert_raw(fx.raw_events(spark, sf_dir)).select("event_id", "Symbol")


@query(f"WITH {fx.RAW_SQL} SELECT event_id, CASE WHEN NOT isnan(LR) THEN LR::TINYINT END AS LR, Price, Volume::DOUBLE AS Volume FROM raw")
def raw_sides(spark, sf_dir):
    return sources.convert_raw(fx.raw_events(spark, sf_dir)).select("event_id", "LR", "Price", "Volume")


@query(f"WITH {fx.RAW_SQL} SELECT event_id, {_STAMP} AS Datetime FROM raw")
def tick_datetime(spark, sf_dir):
    return sources.convert_raw(fx.raw_events(spark, sf_dir)).select("event_id", bars.tick_datetime().alias("Datetime"))


@query(f"WITH {fx.RAW_SQL} SELECT event_id, {_STAMP} - INTERVAL 9 HOUR AS Utc, CAST({_STAMP} AS DATE) AS Local FROM raw")
def tick_zone(spark, sf_dir):
    utc = bars.to_utc(bars.tick_datetime(), "Asia/Seoul")
    return sources.convert_raw(fx.raw_events(spark, sf_dir)).select("event_id", utc.alias("Utc"), bars.date_in(utc, "Asia/Seoul").alias("Local"))


# Daily counts and windows


@query(f"WITH {fx.NATION_SQL} SELECT Symbol, Date, (LR = 1)::INT AS is_Buy, (LR = -1)::INT AS is_Sell FROM ticks WHERE LR IN (1, -1)")
def signed_trades(spark, sf_dir):
    return daily.signed_trades(fx.nation_ticks(spark, sf_dir))


@query(f"WITH {fx.NATION_SQL} SELECT Symbol, Date, B, S FROM daily")
def daily_bs(spark, sf_dir):
    return nation_daily(spark, sf_dir)


@query(f"WITH {fx.NATION_SQL} SELECT DISTINCT Symbol FROM daily")
def symbols(spark, sf_dir):
    return daily.symbols(nation_daily(spark, sf_dir))


@query(f"WITH {fx.NATION_SQL} SELECT DISTINCT Date FROM daily")
def calendar(spark, sf_dir):
    return daily.calendar(nation_daily(spark, sf_dir))


@query(f"WITH {fx.NATION_SQL} SELECT Symbol, Date FROM dense")
def calendar_grid(spark, sf_dir):
    return daily.calendar_grid(nation_daily(spark, sf_dir))


@query(f"WITH {fx.NATION_SQL} SELECT Symbol, Date, B, S FROM dense")
def dense_daily(spark, sf_dir):
    return nation_dense(spark, sf_dir)


@query(f"WITH {fx.NATION_SQL} SELECT count(*) AS n_rows, count(DISTINCT Symbol) AS n_symbols, count(DISTINCT Date) AS n_days, min(Date) AS first_date, max(Date) AS last_date FROM dense")
def panel_summary(spark, sf_dir):
    return report.panel_summary(nation_dense(spark, sf_dir))


def _windows_sql(base: str, columns: str, where: str = "") -> str:
    return f"""WITH {base}, w AS (SELECT *, row_number() OVER (PARTITION BY Symbol ORDER BY Date) AS rn, sum(B) OVER f AS sum_b, sum(S) OVER f AS sum_s, sum((B + S > 0)::INT) OVER f AS valid_days
    FROM dense WINDOW f AS (PARTITION BY Symbol ORDER BY Date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) SELECT {columns} FROM w WHERE rn >= 60 {where}"""


@query(_windows_sql(fx.NATION_SQL, "Symbol, Date, sum_b::BIGINT AS sum_b, sum_s::BIGINT AS sum_s"))
def rolling_window(spark, sf_dir):
    return rolling.rolling_totals(nation_dense(spark, sf_dir))


@query(_windows_sql(fx.NATION_SQL, "Symbol, Date, valid_days::BIGINT AS valid_days"))
def valid_days(spark, sf_dir):
    return rolling.valid_days(nation_dense(spark, sf_dir))


@query(_windows_sql(fx.NATION_SQL, "Symbol, Date, valid_days::BIGINT AS valid_days, CASE WHEN valid_days < 30 THEN 'Low_Valid_Days' END AS skip_reason"))
def window_gate(spark, sf_dir):
    return rolling.gated(nation_dense(spark, sf_dir))


@query(f"SELECT skip_reason, count(*) AS n FROM ({_windows_sql(fx.NATION_SQL, "CASE WHEN valid_days < 30 THEN 'Low_Valid_Days' END AS skip_reason")}) GROUP BY skip_reason")
def skip_reason_dist(spark, sf_dir):
    return report.reasons(rolling.gated(nation_dense(spark, sf_dir)))


@query(f"SELECT count(*) AS n, sum(good)::BIGINT AS n_success, sum(1 - good)::BIGINT AS n_skipped, round(avg(good), 6) AS rate FROM ({_windows_sql(fx.NATION_SQL, '(valid_days >= 30)::INT AS good')})")
def success_rate(spark, sf_dir):
    gated = rolling.gated(nation_dense(spark, sf_dir)).na.fill("Success", ["skip_reason"])
    return rounded(report.success(gated), "rate")


@query(f"WITH {fx.NATION_SQL} SELECT Symbol, Date, B, S FROM dense ORDER BY Symbol, Date LIMIT 1000")
def sample1000(spark, sf_dir):
    return nation_dense(spark, sf_dir).orderBy("Symbol", "Date").limit(1000)


@query(f"WITH {fx.NATION_SQL} SELECT DISTINCT Symbol FROM daily EXCEPT SELECT Symbol FROM ({_windows_sql(fx.NATION_SQL, 'Symbol', 'AND valid_days >= 30')})")
def remaining_symbols(spark, sf_dir):
    counted = cut(nation_daily(spark, sf_dir), "daily")
    done = rolling.gated(daily.dense_daily(counted)).where("skip_reason IS NULL")
    return runs.remaining(daily.symbols(counted), done)


# Bars and VPIN


@query(f"WITH {fx.bars_sql('1 minute')} SELECT Symbol, Datetime, Open, Close, round(Volume, 6) AS Volume FROM bars")
def minute_bars(spark, sf_dir):
    return rounded(event_bars(spark, sf_dir, "1 minute"), "Volume")


@query(f"WITH {fx.bars_sql('1 hour')} SELECT Symbol, Datetime, Open, Close, round(Volume, 6) AS Volume FROM bars")
def hour_bars(spark, sf_dir):
    return rounded(event_bars(spark, sf_dir), "Volume")


_CLEAN = f"{fx.bars_sql('1 hour')}, cleaned AS (SELECT * FROM bars WHERE Datetime IS NOT NULL AND Open > 0 AND Close > 0 AND Volume > 0 AND NOT isnan(Open) AND NOT isnan(Close) AND NOT isnan(Volume))"


@query(f"WITH {_CLEAN} SELECT Symbol, Datetime, Open, Close, round(Volume, 6) AS Volume FROM cleaned")
def bars_clean(spark, sf_dir):
    return rounded(bars.clean_bars(event_bars(spark, sf_dir)), "Volume")


@query(f"WITH {_CLEAN} SELECT Symbol, count(*) AS n_bars FROM cleaned GROUP BY Symbol HAVING count(*) >= {VPIN_CONFIG.min_bars}")
def liquid_symbols(spark, sf_dir):
    return bars.liquid_symbols(bars.clean_bars(event_bars(spark, sf_dir)), VPIN_CONFIG.min_bars)


@query(f"WITH {_CLEAN} SELECT count(*) AS n_bars, sum((Open <> Close)::INT)::BIGINT AS n_moved, round(100.0 * sum((Open <> Close)::INT) / count(*), 6) AS pct_moved FROM bars")
def dp_nonzero_share(spark, sf_dir):
    return rounded(bars.moved_share(event_bars(spark, sf_dir)), "pct_moved")


@query(f"""WITH {_CLEAN} SELECT Symbol, Datetime AS ts, Open AS price, 0.0::DOUBLE AS volume FROM cleaned
UNION ALL SELECT Symbol, Datetime + INTERVAL 1 SECOND, Close, round(Volume, 6) FROM cleaned""")
def pseudo_ticks(spark, sf_dir):
    return rounded(bars.pseudo_ticks(bars.clean_bars(event_bars(spark, sf_dir))), "volume")


def _series(z: str, terms: int = 150) -> str:
    """SQL of the normal distribution by its power series, which shares nothing with the library's approximation."""
    inner = "1e0"
    for k in range(terms, 0, -1):
        inner = f"(1e0 + q / {2 * k + 1}e0 * {inner})"
    return f"(0.5e0 + {z} * exp(-q / 2e0) / sqrt(2e0 * pi()) * {inner})"


_USABLE = f"{_CLEAN}, usable AS (SELECT * FROM cleaned WHERE Symbol IN (SELECT Symbol FROM cleaned GROUP BY Symbol HAVING count(*) >= {VPIN_CONFIG.min_bars}))"
_SIZED = f"{_USABLE}, sized AS (SELECT Symbol, sum(Volume) / count(DISTINCT CAST(Datetime AS DATE)) / {float(VPIN_CONFIG.buckets)}::DOUBLE AS vbs, stddev_samp(Close - Open) AS sdp FROM usable GROUP BY Symbol)"
_CLOCK = f"{_SIZED}, clock AS (SELECT *, hi - Volume AS lo FROM (SELECT *, sum(Volume) OVER (PARTITION BY Symbol ORDER BY Datetime ROWS UNBOUNDED PRECEDING) AS hi FROM usable))"
_BUCKETS = f"""{_CLOCK}, scored AS (SELECT *, {_series('z')} AS buy, floor(lo / vbs + 1e-9)::BIGINT AS k0, ceil(hi / vbs - 1e-9)::BIGINT - 1 AS k1
    FROM (SELECT *, z * z AS q FROM (SELECT clock.*, vbs, (Close - Open) / nullif(sdp, 0) AS z FROM clock JOIN sized USING (Symbol))) WHERE z IS NOT NULL),
pieces AS (SELECT *, least(hi, (bucket + 1) * vbs) - greatest(lo, bucket * vbs) AS piece FROM (SELECT *, unnest(generate_series(k0, greatest(k0, k1))) AS bucket FROM scored)),
buckets AS (SELECT Symbol, bucket, min(Datetime) AS Starttime, max(Datetime) AS Endtime, sum(piece * buy) AS AggBuyVol, sum(piece * (1 - buy)) AS AggSellVol, sum(piece) AS filled, max(vbs) AS vbs FROM pieces GROUP BY ALL
    HAVING sum(piece) >= max(vbs) * (1 - 1e-6)),
result AS (SELECT Symbol, (bucket + 1)::INT AS BucketNo, CAST(Endtime AS DATE) AS Date, Starttime, Endtime, AggBuyVol, AggSellVol, abs(AggBuyVol - AggSellVol) AS AOI,
    CASE WHEN row_number() OVER (PARTITION BY Symbol ORDER BY bucket) >= {VPIN_CONFIG.sample}
    THEN sum(abs(AggBuyVol - AggSellVol)) OVER (PARTITION BY Symbol ORDER BY bucket ROWS BETWEEN {VPIN_CONFIG.sample - 1} PRECEDING AND CURRENT ROW) / ({VPIN_CONFIG.sample} * vbs) END AS VPIN FROM buckets)"""


def _usable(spark, sf_dir):
    return vpin.usable_bars(event_bars(spark, sf_dir), VPIN_CONFIG)


@query(f"WITH {_SIZED} SELECT Symbol, round(vbs, 6) AS vbs, round(sdp, 6) AS sdp FROM sized")
def vbs_sdp(spark, sf_dir):
    return rounded(vpin.bucket_sizes(_usable(spark, sf_dir), VPIN_CONFIG), "vbs", "sdp")


@query(f"WITH {_CLOCK} SELECT Symbol, Datetime, round(lo, 6) AS lo, round(hi, 6) AS hi FROM clock")
def volume_clock(spark, sf_dir):
    return rounded(vpin.volume_clock(_usable(spark, sf_dir)).select("Symbol", "Datetime", "lo", "hi"), "lo", "hi")


@query(f"WITH {_BUCKETS} SELECT Symbol, bucket, Starttime, Endtime, round(AggBuyVol, 6) AS AggBuyVol, round(AggSellVol, 6) AS AggSellVol, round(abs(AggBuyVol - AggSellVol), 6) AS AOI FROM buckets")
def bvc_buckets(spark, sf_dir):
    found = vpin.buckets(_usable(spark, sf_dir), VPIN_CONFIG)
    return rounded(found.select("Symbol", "bucket", "Starttime", "Endtime", "AggBuyVol", "AggSellVol", "AOI"), "AggBuyVol", "AggSellVol", "AOI")


@query(f"WITH {_BUCKETS} SELECT Symbol, BucketNo, Date, Starttime, Endtime, round(AggBuyVol, 6) AS AggBuyVol, round(AggSellVol, 6) AS AggSellVol, round(AOI, 6) AS AOI, round(VPIN, 6) AS VPIN FROM result")
def vpin_buckets(spark, sf_dir):
    return rounded(vpin.vpin(_usable(spark, sf_dir), VPIN_CONFIG), "AggBuyVol", "AggSellVol", "AOI", "VPIN")


@query(f"WITH {_BUCKETS} SELECT count(*) AS n_rows, count(DISTINCT Symbol) AS n_symbols, round(min(VPIN), 6) AS lowest, round(max(VPIN), 6) AS highest, round(avg(VPIN), 6) AS mean FROM result WHERE VPIN IS NOT NULL")
def vpin_summary(spark, sf_dir):
    return rounded(report.measure_summary(vpin.vpin(_usable(spark, sf_dir), VPIN_CONFIG, drop_short=True), "VPIN"), "lowest", "highest", "mean")


@query(f"""WITH {_BUCKETS} SELECT format('{{:,}}', count(*)) AS n_rows, format('{{:,}}', count(DISTINCT Symbol)) AS n_symbols, format('{{:.1f}}%', 100.0 * count(VPIN) / count(*)) AS estimated,
    format('{{:.4f}}', min(VPIN)) AS lowest, format('{{:.4f}}', max(VPIN)) AS highest, format('{{:.4f}}', avg(VPIN)) AS mean, CASE WHEN count(VPIN) = 0 THEN 'no result: no estimate succeeded' ELSE 'ok' END AS outcome FROM result HAVING count(*) > 0
UNION ALL SELECT '0', '0', NULL, NULL, NULL, NULL, 'no result: no symbol has enough data' WHERE NOT EXISTS (SELECT * FROM result)""")
def vpin_report(spark, sf_dir):
    return report.report(vpin.vpin(_usable(spark, sf_dir), VPIN_CONFIG), "VPIN")


@query(f"""WITH {_BUCKETS}, n AS (SELECT Symbol, count(*) AS n FROM cleaned GROUP BY Symbol) SELECT Symbol, CASE WHEN n < 1000000 THEN 'fewer than 1000000 usable bars: ' || n END AS error
FROM (SELECT DISTINCT Symbol FROM bars) LEFT JOIN n USING (Symbol)""")
def vpin_errors(spark, sf_dir):
    """Of a demand that no symbol meets."""
    every, strict = event_bars(spark, sf_dir), config.VpinConfig(bar="1 hour", buckets=20, sample=50, min_bars=1_000_000)
    return vpin.without_result(every, vpin.vpin(vpin.usable_bars(every, strict), strict), strict)


#: Demands between which the symbols of ``vpin_error_kinds`` fall.
_KINDS = config.VpinConfig(bar="1 hour", buckets=20, sample=1_000_000, min_bars=40, min_ticks=200)


@query(f"""WITH {fx.bars_sql('1 hour')}, k AS (SELECT *, dense_rank() OVER (ORDER BY Symbol) AS k, row_number() OVER (PARTITION BY Symbol ORDER BY Datetime) AS r FROM bars),
spoilt AS (SELECT Symbol, Datetime, Open, CASE WHEN k = 2 THEN Open ELSE Close END AS Close, CASE WHEN k <> 1 THEN Volume END AS Volume FROM k WHERE (k <> 3 OR r <= 30) AND (k <> 4 OR r <= 80)),
n AS (SELECT Symbol, count(*) AS n, max(Close <> Open) AS moves FROM spoilt WHERE Volume > 0 GROUP BY Symbol)
SELECT Symbol, CASE WHEN n IS NULL THEN 'no usable bars' WHEN n < 40 THEN 'fewer than 40 usable bars: ' || n WHEN 2 * n < 200 THEN 'fewer than 200 ticks: ' || 2 * n
    WHEN NOT moves THEN 'price changes do not vary' ELSE 'no 1000000 full volume buckets' END AS error FROM (SELECT DISTINCT Symbol FROM spoilt) LEFT JOIN n USING (Symbol)""")
def vpin_error_kinds(spark, sf_dir):
    """Each reason once: bars of one symbol lose their volume, those of another their moves, two more all but their first 30 and 80."""
    place = F.row_number().over(Window.partitionBy("Symbol").orderBy("Datetime"))
    every = cut(event_bars(spark, sf_dir).withColumn("r", place), "bars")
    names = every.select("Symbol").distinct()
    ranked = every.join(F.broadcast(names.withColumn("k", F.row_number().over(Window.orderBy("Symbol")))), "Symbol")  # one row for each event type
    kept = ranked.where("(k <> 3 OR r <= 30) AND (k <> 4 OR r <= 80)")
    spoilt = kept.select("Symbol", "Datetime", "Open", F.expr("IF(k = 2, Open, Close)").alias("Close"), F.expr("IF(k <> 1, Volume, NULL)").alias("Volume"))
    return vpin.without_result(spoilt, vpin.vpin(vpin.usable_bars(spoilt, _KINDS), _KINDS), _KINDS)


@query(f"WITH {_CLEAN} SELECT Symbol AS symbol, Datetime AS datetime, Open AS open, Close AS close, round(Volume, 6) AS volume FROM cleaned")
def lower_names(spark, sf_dir):
    return report.lower_names(rounded(bars.clean_bars(event_bars(spark, sf_dir)), "Volume"))


# Likelihoods and single steps. The SQL is written by hand, with the branches at the fixed points spelt out.


_PIN_BRANCHES = "(0, 0.6, 1.2, 1.1), (1, 0.2, 1.2, 2.6), (2, 0.2, 2.7, 1.1)"
_APIN_BRANCHES = "(0, 0.48, 1.1, 1.0), (1, 0.12, 1.9, 1.7), (2, 0.14, 1.1, 2.2), (3, 0.06, 1.9, 2.9), (4, 0.14, 2.6, 1.0), (5, 0.06, 3.4, 1.7)"
_LAST60 = "ORDER BY Date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW"


def _terms_sql(branches: str) -> str:
    """Days by branches: v, the log chance of a day's counts in a branch, and ll, that of the day."""
    return f"""{fx.REGION_SQL}, branch AS (SELECT * FROM (VALUES {branches}) x(k, c, x, y)),
    t AS (SELECT Symbol, Date, B, S, k, ln(c::DOUBLE) - x::DOUBLE - y::DOUBLE + B * ln(x::DOUBLE) + S * ln(y::DOUBLE) AS v FROM dense, branch),
    m AS (SELECT Symbol, Date, max(v) AS top FROM t GROUP BY ALL),
    l AS (SELECT Symbol, Date, any_value(top) + ln(sum(exp(v - top))) AS ll FROM t JOIN m USING (Symbol, Date) GROUP BY Symbol, Date)"""


def _likelihood_sql(branches: str) -> str:
    return f"WITH {_terms_sql(branches)} SELECT Symbol, Date, round(loglik, 6) AS loglik FROM (SELECT *, sum(ll) OVER w AS loglik, count(*) OVER w AS n FROM l WINDOW w AS (PARTITION BY Symbol {_LAST60})) WHERE n = 60"


def _step_sql(branches: str, updates: dict[str, str]) -> str:
    count = branches.count("(")
    sums = ", ".join(f"max({x}) FILTER (k = {k}) AS {x}{k}" for x in "wbs" for k in range(count))
    return f"""WITH {_terms_sql(branches)}, p AS (SELECT Symbol, Date, k, exp(v - ll) AS w, exp(v - ll) * B AS b, exp(v - ll) * S AS s FROM t JOIN l USING (Symbol, Date)),
    r AS (SELECT Symbol, Date, k, sum(w) OVER o AS w, sum(b) OVER o AS b, sum(s) OVER o AS s, count(*) OVER o AS n FROM p WINDOW o AS (PARTITION BY Symbol, k {_LAST60})),
    e AS (SELECT Symbol, Date, {sums} FROM r WHERE n = 60 GROUP BY Symbol, Date)
    SELECT Symbol, Date, {", ".join(f"round({of}, 6) AS {name}" for name, of in updates.items())} FROM e"""


@query(_likelihood_sql(_PIN_BRANCHES))
def pin_loglik_fixed(spark, sf_dir):
    return rounded(likelihood.window_likelihood(region_dense(spark, sf_dir), PIN_POINT), "loglik")


@query(_likelihood_sql(_APIN_BRANCHES))
def adjpin_loglik_fixed(spark, sf_dir):
    return rounded(likelihood.window_likelihood(region_dense(spark, sf_dir), APIN_POINT), "loglik")


@query(
    _step_sql(
        _PIN_BRANCHES,
        {
            "a": "(w1 + w2) / 60e0",
            "d": "w1 / (w1 + w2)",
            "u": "(b2 * 1.5e0 / 2.7e0 + s1 * 1.5e0 / 2.6e0) / (w1 + w2)",
            "eb": "(b0 + b1 + b2 * 1.2e0 / 2.7e0) / 60e0",
            "es": "(s0 + s2 + s1 * 1.1e0 / 2.6e0) / 60e0",
        },
    )
)
def pin_em_step(spark, sf_dir):
    return rounded(likelihood.em_step(region_dense(spark, sf_dir), PIN_POINT), *PIN_POINT)


@query(
    _step_sql(
        _APIN_BRANCHES,
        {
            "a": "(w2 + w3 + w4 + w5) / 60e0",
            "d": "(w2 + w3) / (w2 + w3 + w4 + w5)",
            "t1": "w1 / (w0 + w1)",
            "t2": "(w3 + w5) / (w2 + w3 + w4 + w5)",
            "ub": "(b4 * 1.5e0 / 2.6e0 + b5 * 1.5e0 / 3.4e0) / (w4 + w5)",
            "us": "(s2 * 1.2e0 / 2.2e0 + s3 * 1.2e0 / 2.9e0) / (w2 + w3)",
            "eb": "(b0 + b2 + (b1 + b3) * 1.1e0 / 1.9e0 + b4 * 1.1e0 / 2.6e0 + b5 * 1.1e0 / 3.4e0) / 60e0",
            "es": "(s0 + s4 + (s1 + s5) / 1.7e0 + s2 / 2.2e0 + s3 / 2.9e0) / 60e0",
            "pb": "((b1 + b3) * 0.8e0 / 1.9e0 + b5 * 0.8e0 / 3.4e0) / (w1 + w3 + w5)",
            "ps": "((s1 + s5) * 0.7e0 / 1.7e0 + s3 * 0.7e0 / 2.9e0) / (w1 + w3 + w5)",
        },
    )
)
def adjpin_em_step(spark, sf_dir):
    return rounded(likelihood.em_step(region_dense(spark, sf_dir), APIN_POINT), *APIN_POINT)


_LEVELS = ", ".join(f"({a}::DOUBLE)" for a in (0.1, 0.5, 0.9))


@query(f"""WITH {fx.REGION_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY Symbol ORDER BY Date) AS rn, sum((B + S > 0)::INT) OVER f AS valid, sum(B) OVER f / 60.0::DOUBLE AS mb, sum(S) OVER f / 60.0::DOUBLE AS ms
    FROM dense WINDOW f AS (PARTITION BY Symbol ORDER BY Date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
ends AS (SELECT * FROM n WHERE rn >= 60 AND valid >= 30),
counted AS (SELECT e.Symbol, e.Date, d.B, d.S, count(*)::DOUBLE AS n FROM ends e JOIN n d ON d.Symbol = e.Symbol AND d.rn BETWEEN e.rn - 59 AND e.rn GROUP BY ALL),
l(v) AS (VALUES {_LEVELS}),
points AS (SELECT *, ms - a * d * u AS es FROM (SELECT Symbol, Date, mb, ms, a, d, g, g * mb AS eb, (mb - g * mb) / (a * (1e0 - d)) AS u FROM ends, (SELECT x.v AS a, y.v AS d, z.v AS g FROM l x, l y, l z))),
scored AS (SELECT Symbol, Date, a, d, g, round(sum(n * ln((1e0 - a) * exp(-eb - es) * pow(eb, B) * pow(es, S) + a * d * exp(-eb - es - u) * pow(eb, B) * pow(es + u, S) + a * (1e0 - d) * exp(-eb - es - u) * pow(eb + u, B) * pow(es, S))), 6) AS loglik FROM points JOIN counted USING (Symbol, Date) WHERE es > 0 AND eb > 0 AND u > 0 GROUP BY ALL)
SELECT Symbol, Date, a, d, g, loglik FROM (SELECT *, row_number() OVER (PARTITION BY Symbol, Date ORDER BY loglik DESC, a, d, g) AS r FROM scored) WHERE r = 1""")
def pin_grid(spark, sf_dir):
    return likelihood.pin_grid(region_dense(spark, sf_dir))


# Estimates


@query()
def pin_rolling(spark, sf_dir):
    return estimates.pin(region_dense(spark, sf_dir))


_OUTCOMES = f"SELECT Symbol, skip_reason, count(*) AS n, count(*) FILTER (skip_reason = 'Success') AS sound FROM ({_windows_sql(fx.REGION_SQL, "Symbol, CASE WHEN valid_days < 30 THEN 'Low_Valid_Days' ELSE 'Success' END AS skip_reason")}) GROUP BY ALL"


@query(_OUTCOMES)
def pin_outcomes(spark, sf_dir):
    """What became of each symbol's windows: every one with enough days with trades has an estimate, and how many are sound."""
    sound = F.count_if(F.expr("a BETWEEN 0 AND 1 AND d BETWEEN 0 AND 1 AND u > 0 AND eb > 0 AND es > 0 AND abs(PIN - a * u / (a * u + eb + es)) < 1e-9"))
    return estimates.pin(region_dense(spark, sf_dir)).groupBy("Symbol", "skip_reason").agg(F.count("*").alias("n"), sound.alias("sound"))


@query(_OUTCOMES)
def adjpin_outcomes(spark, sf_dir):
    sound = F.count_if(F.expr("least(a, d, t1, t2) >= 0 AND greatest(a, d, t1, t2) <= 1 AND least(ub, us, eb, es, pb, ps) > 0 AND least(APIN, PSOS) >= 0 AND APIN + PSOS <= 1"))
    return estimates.apin(region_dense(spark, sf_dir), config.APIN_SKIP).groupBy("Symbol", "skip_reason").agg(F.count("*").alias("n"), sound.alias("sound"))


@query()
def adjpin_rolling(spark, sf_dir):
    return estimates.apin(region_dense(spark, sf_dir), config.APIN_BASE)


@query()
def adjpin_skip(spark, sf_dir):
    return estimates.apin(region_dense(spark, sf_dir), config.APIN_SKIP)


@query()
def adjpin_theta(spark, sf_dir):
    return estimates.apin(region_dense(spark, sf_dir), config.APIN_THETA)


@query()
def adjpin_warm(spark, sf_dir):
    return estimates.apin(region_dense(spark, sf_dir), config.APIN_WARM)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VPIN of the events, also where symbols have few bars."""
    few = config.VpinConfig(bar="1 hour", buckets=20, sample=50, min_bars=50)
    return vpin.vpin(vpin.usable_bars(event_bars(spark, sf_dir), few), few)
