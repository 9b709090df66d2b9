import datetime as dt
import itertools

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tickloom.operators import bars, daily
from tickloom.sources import ticks


def test_worked_conversion_example(spark):
    raw = spark.createDataFrame([(20836.5, 34300.914478218, " \t258540 ", -1.0, 16950.0, 2.0, "x"), (None, None, "nan", None, None, None, None), (float("nan"), float("nan"), None, float("nan"), 1.0, 1.0, None)], "Date double, Time double, Symbol string, LR double, Price double, Volume double, Note string")
    first, second, third = ticks.convert_raw(raw).collect()
    assert (first.Date, first.Time, first.Symbol, first.LR, first.Note) == (dt.date(2017, 1, 17), 34300914478218, "258540", -1, "x")
    assert tuple(second) == (None,) * 7 and (third.Date, third.Time, third.LR, third.Symbol) == (None,) * 4
    assert ticks.convert_raw(raw).columns == raw.columns


def test_a_side_that_is_not_whole_raises(spark):
    with pytest.raises(Exception, match="not whole"):
        spark.createDataFrame([(0.5,)], "LR double").select(ticks.side("LR")).collect()


def test_folders_files_and_nanosecond_times(spark, tmp_path):
    for year, time in ((2018, 33705197972089), (2017, 34300914478218)):
        folder = tmp_path / f"KOR_{year}"
        folder.mkdir()
        pq.write_table(pa.table({"Symbol": ["a", None], "Date": pa.array([dt.date(year, 1, 17), None], pa.date32()), "Time": pa.array([time, None], pa.time64("ns")), "Price": [1.0, None], "Volume": [2.0, None], "LR": pa.array([-1, None], pa.int8())}), folder / "t.parquet")
    (tmp_path / "KOR_notes").mkdir()
    (tmp_path / "US_2017").mkdir()
    base = f"file://{tmp_path}"
    files = ticks.tick_files(spark, base, "KOR")
    assert [f.rpartition("KOR_")[2] for f in files] == ["2017/t.parquet", "2018/t.parquet"]
    rows = ticks.with_origin(ticks.read_ticks(spark, files)).where("Time IS NOT NULL").orderBy("year").collect()
    assert [(r.Time, r.LR, r.country, r.year) for r in rows] == [(34300914478218, -1, "KOR", 2017), (33705197972089, -1, "KOR", 2018)]
    stamp = ticks.read_ticks(spark, files[:1]).where("Time IS NOT NULL").select(bars.tick_datetime().alias("t")).first().t
    assert stamp == dt.datetime(2017, 1, 17, 9, 31, 40, 914478)
    with pytest.raises(FileNotFoundError):
        ticks.tick_files(spark, base, "US")
    with pytest.raises(ValueError):
        ticks.tick_files(spark, base, "XX")


def test_exports_are_converted_once(spark, tmp_path):
    folder = tmp_path / "UK_2020"
    folder.mkdir()
    (folder / "a.sas7bdat").write_bytes(b"")
    made = []

    def read_raw(path):
        made.append(path)
        return spark.createDataFrame([(21915.0, 1.5)], "Date double, Price double")

    base = f"file://{tmp_path}"
    assert set(ticks.convert_folders(spark, base, read_raw).values()) == {"converted"}
    assert set(ticks.convert_folders(spark, base, read_raw).values()) == {"kept"} and len(made) == 1
    assert spark.read.parquet(f"{base}/UK_2020/a.parquet").first().Date == dt.date(2020, 1, 1)


def test_worked_bar_example(spark):
    at = dt.datetime(2020, 1, 2, 9, 0)
    rows = [("s", at.replace(second=3), 50000.0, 1.0, 1), ("s", at.replace(second=47), 50100.0, 2.0, 2), ("s", at.replace(second=50), 1.0, 0.0, 3), ("s", at.replace(minute=1), 7.0, 1.0, 5), ("s", at.replace(minute=1), 8.0, 1.0, 4)]
    frame = spark.createDataFrame(rows, "Symbol string, Datetime timestamp_ntz, Price double, Volume double, n long")
    out = bars.time_bars(frame, "1 minute", "n").orderBy("Datetime").collect()
    assert [(r.Datetime.minute, r.Open, r.Close, r.Volume) for r in out] == [(0, 50000.0, 50100.0, 3.0), (1, 8.0, 7.0, 2.0)]
    pairs = bars.pseudo_ticks(bars.time_bars(frame, "1 minute", "n")).orderBy("ts").collect()
    assert [(r.ts, r.price, r.volume) for r in pairs[:2]] == [(at, 50000.0, 0.0), (at.replace(second=1), 50100.0, 3.0)]


def test_streamed_bars_equal_batch_bars(spark, tmp_path):
    from tickloom.streaming.live import live_bars

    rows = [("s", dt.datetime(2020, 1, 2, 9, m, s), float(m + s), 1.0) for m in range(5) for s in (1, 30)]
    frame = spark.createDataFrame(rows, "Symbol string, Datetime timestamp, Price double, Volume double")
    frame.write.parquet(f"file://{tmp_path}/in")
    stream = live_bars(spark.readStream.schema(frame.schema).parquet(f"file://{tmp_path}/in"), late="0 seconds", tie="Price")
    query = stream.writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/ck").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.Datetime, r.Open, r.Close) for r in spark.table("live").collect()}
    want = {(r.Datetime, r.Open, r.Close) for r in bars.time_bars(frame, tie="Price").collect()}
    assert got <= want and len(got) >= 4


def test_bars_keep_the_order_of_ticks_of_one_microsecond(spark):
    rows = [("s", dt.date(2020, 1, 2), 33_000_000_000_000 + 100 * k, 100.0 + k, 1.0) for k in range(3)]
    for order in itertools.permutations(rows):
        frame = spark.createDataFrame(order, "Symbol string, Date date, Time long, Price double, Volume double").coalesce(1).withColumn("Datetime", bars.tick_datetime())
        bar = bars.time_bars(frame).first()
        assert (bar.Open, bar.Close, bar.Volume) == (100.0, 102.0, 3.0)
    with pytest.raises(ValueError, match="tie"):
        bars.time_bars(frame.drop("Time"))


def scanned(frame):
    """Files that the plan's scans read."""
    frame.collect()
    leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
    return [leaves.apply(k).metrics().apply("numFiles").value() for k in range(leaves.size())]


def test_a_filter_on_the_folder_reads_its_files_only(spark, tmp_path):
    for folder in ("KOR_2017", "KOR_2018", "US_2017"):
        for name in ("a", "b"):  # one as Spark writes it, one plain file
            spark.createDataFrame([(folder + name, 1.0)], "Symbol string, Price double").coalesce(1).write.parquet(f"file://{tmp_path}/{folder}/{name}.parquet")
        pq.write_table(pa.table({"Symbol": [folder + "c"]}), tmp_path / folder / "c.parquet")
    every = ticks.read_folders(spark, f"file://{tmp_path}", ["KOR", "US"])
    assert scanned(every.select("Symbol")) == [3, 3, 3] and scanned(every.where("year = 2017").select("Symbol")) == [3, 3]
    assert scanned(every.where("country = 'KOR' AND year = 2018").select("Symbol")) == [3]
    assert all(r.Symbol[:-1] == f"{r.country}_{r.year}" for r in every.select("Symbol", "country", "year").collect())
    files = ticks.tick_files(spark, f"file://{tmp_path}", "KOR")
    assert {(r.country, r.year) for r in ticks.with_origin(ticks.read_ticks(spark, files)).collect()} == {("KOR", 2017), ("KOR", 2018)}
    with pytest.raises(FileNotFoundError):
        ticks.read_folders(spark, f"file://{tmp_path}", ["KOR", "JP"])


def test_live_daily_counts_equal_those_of_a_table(spark, tmp_path):
    from tickloom.streaming.live import live_daily

    rows = [(s, dt.datetime(2020, 1, d, 9, 0, k), (-1, 0, 1, 1)[k % 4]) for s in "ab" for d in (2, 3, 6) for k in range(d * 5)] + [("a", dt.datetime(2020, 1, 2, 9), None)]
    frame = spark.createDataFrame(rows, "Symbol string, Datetime timestamp, LR int")
    frame.write.parquet(f"file://{tmp_path}/in")
    stream = live_daily(spark.readStream.schema(frame.schema).parquet(f"file://{tmp_path}/in"), late="0 seconds")
    query = stream.writeStream.format("memory").queryName("live_days").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/ck").start()
    query.processAllAvailable()
    query.stop()
    got = {tuple(r) for r in spark.table("live_days").collect()}
    want = {tuple(r) for r in daily.daily_counts(frame.withColumn("Date", F.to_date("Datetime"))).select("Symbol", "Date", "B", "S").collect()}
    assert {r for r in want if r[1] < dt.date(2020, 1, 6)} == got  # the last day is open still


STUB = """
import pandas as pd
from types import SimpleNamespace

def read_sas7bdat(path, metadataonly=False, **_):
    assert metadataonly
    return None, SimpleNamespace(column_names=["Symbol", "Date", "LR"], readstat_variable_types={"Symbol": "string", "Date": "double", "LR": "double"})

def read_file_in_chunks(reader, path, chunksize, disable_datetime_conversion):
    assert reader is read_sas7bdat and disable_datetime_conversion
    rows = pd.DataFrame({"LR": [1.0, float("nan"), -1.0], "Date": [20836.0, float("nan"), 20837.0], "Symbol": [" a", None, "nan"]})
    rows = rows.drop(columns="LR") if path.endswith("b") else rows
    for k in range(0, len(rows), chunksize):
        yield rows.iloc[k : k + chunksize], None
"""


def test_exports_are_read_by_name_and_missing_numbers_are_null(spark, tmp_path, monkeypatch):
    (tmp_path / "pyreadstat.py").write_text(STUB)
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "pyreadstat.py"))
    spark.dataSource.register(ticks.sas_source())
    raw = spark.read.format("sas7bdat").option("path", "/a,/b").option("chunksize", "2").load()
    assert raw.columns == ["Symbol", "Date", "LR"]
    rows = [tuple(r) for r in ticks.convert_raw(raw).collect()]
    assert rows[:3] == [("a", dt.date(2017, 1, 17), 1), (None, None, None), (None, dt.date(2017, 1, 18), -1)]
    assert rows[3:] == [("a", dt.date(2017, 1, 17), None), (None, None, None), (None, dt.date(2017, 1, 18), None)]


def test_zones(spark):
    frame = spark.createDataFrame([(dt.datetime(2020, 1, 2, 3, 0),)], "t timestamp_ntz")
    utc = bars.to_utc("t", "Asia/Seoul")
    assert frame.select(utc.alias("u"), bars.date_in(utc, "Asia/Seoul").alias("d")).first() == (dt.datetime(2020, 1, 1, 18, 0), dt.date(2020, 1, 2))


def test_bars_in_order(spark):
    rows = [(s, dt.datetime(2020, 1, 2, 9, m)) for m in (3, 1, 2) for s in "ba"]
    assert [tuple(r) for r in bars.in_order(spark.createDataFrame(rows, "Symbol string, Datetime timestamp_ntz")).collect()] == sorted(rows)
