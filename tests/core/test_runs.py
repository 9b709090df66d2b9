"""Runs that keep each finished symbol, stand a poisoned one, and go on with appended days."""

import os
import signal
import subprocess
import sys
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.core.test_estimators import panel
from tickloom import config
from tickloom.operators import daily, estimates, runs


def many(symbols, days, seed=7):
    rng = np.random.default_rng(seed)
    return pd.concat([panel(rng.poisson(4, days), rng.poisson(4, days), f"s{k:03}") for k in range(symbols)])


def test_one_poisoned_symbol_costs_one_symbol(spark, tmp_path):
    frame = spark.createDataFrame(many(40, 3))
    jobs, poison = [], ["s023"]

    def estimate(part):
        jobs.append(part.select("Symbol").distinct().count())
        bad = list(poison)

        def one(days):
            if days.Symbol.iloc[0] in bad:
                raise ValueError("poisoned")
            return pd.DataFrame({"Symbol": [days.Symbol.iloc[0]], "n": [len(days)]})

        return part.groupBy("Symbol").applyInPandas(one, "Symbol string, n long")

    path, told = f"file://{tmp_path}/run", []
    found, failed = runs.resumable(spark, frame, estimate, path, "k", told.append)
    assert found.count() == found.select("Symbol").distinct().count() == 39
    assert [r.Symbol for r in failed.collect()] == ["s023"] and failed.first().error
    assert jobs[0] == 40 and len(jobs) < 25 and len(told) == len(jobs)
    again = len(jobs)
    poison.clear()
    found, failed = runs.resumable(spark, frame, estimate, path, "k")
    assert jobs[again:] == [1] and found.count() == 40 and failed.count() == 0
    with pytest.raises(FileNotFoundError):
        runs.Run(spark, path, "another key").results()


def test_estimators_are_kept_by_symbol(spark, tmp_path):
    thin = panel(np.zeros(61), np.ones(61), "thin")
    thin["S"] = (np.arange(61) % 5 == 0).astype(int)
    frame = spark.createDataFrame(pd.concat([many(5, 63), panel(np.ones(9), np.ones(9), "short"), thin]))
    for name, marked, plain in (
        ("pin", lambda p: estimates.pin_marked(p, config.PinConfig(slab=2)), estimates.pin(frame)),
        ("apin", lambda p: estimates.apin_marked(p), estimates.apin(frame)),
    ):
        scans = []
        found, failed = runs.resumable(spark, frame, lambda p: scans.append(1) or marked(p), f"file://{tmp_path}/{name}", "k")
        assert len(scans) == 1 and failed.count() == 0
        want, got = (f.toPandas().sort_values(["Symbol", "Date"]).reset_index(drop=True) for f in (plain, found.select(*plain.columns)))
        pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=1e-5, rtol=1e-4)
        run = runs.Run(spark, f"file://{tmp_path}/{name}", "k")
        progress = {r.Symbol: r for r in run.progress().collect()}
        assert len(progress) == 7 and all(r.part == r.parts for r in progress.values())
        assert {s: r.windows for s, r in progress.items()} == {**{f"s{k:03}": 4 for k in range(5)}, "short": 0, "thin": 2}
        assert all(r.seconds > 0 for s, r in progress.items() if s.startswith("s0"))
        runs.resumable(spark, frame, lambda p: scans.append(1) or marked(p), f"file://{tmp_path}/{name}", "k")
        assert len(scans) == 1  # nothing is left, so no job is begun


KILLED = """
import sys, time
from pyspark.sql import SparkSession
from tickloom.operators import runs
where = sys.argv[1]
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", f"file://{where}/shared").getOrCreate()
frame = spark.createDataFrame([(f"s{k}",) for k in range(6)], "Symbol string").coalesce(1).sortWithinPartitions("Symbol")

def slow(rows):
    import numpy as np, pandas as pd
    for batch in rows:
        for symbol in batch.Symbol:
            if symbol >= "s3":
                time.sleep(600)
            yield pd.DataFrame({"Symbol": symbol, "x": np.random.rand(5000), "done": [None] * 4999 + [True], "part": 0, "parts": 1, "windows": 1, "seconds": 0.5})

spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
runs.resumable(spark, frame, lambda p: p.coalesce(1).sortWithinPartitions("Symbol").mapInPandas(slow, "Symbol string, x double, done boolean, part int, parts int, windows int, seconds double"), f"file://{where}/run", "k")
"""


def test_a_killed_run_keeps_the_symbols_that_were_finished(spark, tmp_path):
    env = os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)}
    job = subprocess.Popen([sys.executable, "-c", KILLED, str(tmp_path)], env=env, start_new_session=True, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    try:
        until = time.monotonic() + 120
        while time.monotonic() < until and len(list(tmp_path.glob("run/k/units/*.parquet"))) < 1 and job.poll() is None:
            time.sleep(0.5)
        run = runs.Run(spark, f"file://{tmp_path}/run", "k")
        early = sorted(r.Symbol for r in run.progress().collect())  # while it goes on
    finally:
        os.killpg(job.pid, signal.SIGKILL)
        job.wait()
    kept = sorted(r.Symbol for r in run.finished().collect())
    # The last ones may lie between the workers still, as rows go from one to the other in batches.
    assert {"s0"} <= set(early) <= set(kept) <= {"s0", "s1", "s2"} and run.results().count() == 4999 * len(kept)
    calls = []

    def quick(part):
        calls.extend(r.Symbol for r in part.collect())
        return part.withColumn("x", F.lit(1.0))

    frame = spark.createDataFrame([(f"s{k}",) for k in range(6)], "Symbol string")
    marks = "part int, parts int, windows int, seconds double"
    found, _ = runs.resumable(spark, frame, lambda p: runs.marked(quick(p), p).select("Symbol", "x", "done", *(m.split()[0] for m in marks.split(", "))), f"file://{tmp_path}/run", "k")
    assert set(calls) == {f"s{k}" for k in range(6)} - set(kept) and found.select("Symbol").distinct().count() == 6


def test_appended_days_give_what_one_run_gives(spark):
    frame = many(3, 75)
    short = panel(np.full(70, 3), np.arange(70) % 7, "later")
    short["Date"] = sorted(frame.Date.unique())[5:75]
    frame = pd.concat([frame, short])
    dates = sorted(frame.Date.unique())
    for preset in (config.APIN_SKIP, config.APIN_WARM, config.APIN_BASE):
        whole = estimates.apin(spark.createDataFrame(frame), preset).toPandas().sort_values(["Symbol", "Date"]).reset_index(drop=True)
        state, parts = None, []
        for a, b in ((0, 40), (38, 66), (66, 66), (60, 75)):  # overlaps and a part without days
            new = frame[frame.Date.isin(dates[a:b])]
            days = spark.createDataFrame(new if len(new) else frame.head(1), "Symbol string, Date date, B int, S int")
            rows, state = estimates.apin_continued(days if len(new) else days.limit(0), state, preset)
            parts.append(rows.toPandas())
            state = spark.createDataFrame(state.collect(), state.schema)
        got = pd.concat([p for p in parts if len(p)]).sort_values(["Symbol", "Date"]).reset_index(drop=True)
        pd.testing.assert_frame_equal(got, whole, check_dtype=False, atol=1e-6, rtol=1e-5)
        assert {r.Symbol: len(r.Dates) for r in state.collect()} == {"s000": 59, "s001": 59, "s002": 59, "later": 59}
    first, state = estimates.pin_continued(spark.createDataFrame(frame[frame.Date.isin(dates[:65])]))
    state = spark.createDataFrame(state.collect(), state.schema)
    second, _ = estimates.pin_continued(spark.createDataFrame(frame[frame.Date.isin(dates[60:])]), state)
    got, want = (f.toPandas().sort_values(["Symbol", "Date"]).reset_index(drop=True) for f in (first.unionByName(second), estimates.pin(spark.createDataFrame(frame))))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=1e-6, rtol=1e-5)


def test_a_bucketed_panel_is_read_without_shuffle_or_sort(spark):
    frame = spark.createDataFrame(many(7, 63))
    daily.write_panel(frame, "panel_of_test", 3)
    kept = spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering")
    try:
        panel_ = daily.read_panel(spark, "panel_of_test")
        from tickloom.operators import rolling

        for found, plain in ((estimates.pin(panel_, bucketed=True), estimates.pin(frame)), (estimates.apin(panel_, bucketed=True), estimates.apin(frame)), (rolling.rolling_totals(panel_), rolling.rolling_totals(frame))):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Sort" not in plan.replace("SortOrder", "") and "Bucketed: true" in found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
            got, want = (f.toPandas().sort_values(["Symbol", "Date"]).reset_index(drop=True) for f in (found, plain))
            pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=1e-5, rtol=1e-4)
    finally:
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", kept)
        spark.sql("DROP TABLE panel_of_test")


def test_keys_follow_from_the_list_of_files_alone(spark, tmp_path):
    where = tmp_path / "ticks"
    spark.range(10).write.parquet(f"file://{where}")
    key = lambda model="apin", cfg=config.APIN_SKIP: runs.fingerprint(spark, [f"file://{where}"], cfg, model)
    first, made = key(), []

    def make():
        made.append(1)
        return spark.read.parquet(f"file://{where}")

    assert first == key() != key("pin") and first != key(cfg=config.APIN_THETA)
    assert runs.cached(spark, make, f"file://{tmp_path}/cache", first).count() == 10 and len(made) == 1
    part = next(where.glob("*.parquet"))
    part.chmod(0)  # a key needs no file's content, and a hit does not either
    assert runs.cached(spark, make, f"file://{tmp_path}/cache", key()).count() == 10 and len(made) == 1
    part.chmod(0o644)
    spark.range(11).write.mode("overwrite").parquet(f"file://{where}")
    assert key() != first
    assert runs.cached(spark, make, f"file://{tmp_path}/cache", key()).count() == 11 and len(made) == 2
    assert runs.cached(spark, make, f"file://{tmp_path}/cache", key(), force=True).count() == 11 and len(made) == 3


def test_counters_are_those_of_the_written_result(spark, tmp_path):
    frame = spark.createDataFrame(pd.concat([many(2, 63), panel(np.zeros(61), (np.arange(61) % 5 == 0), "thin")]))
    found, seen = runs.counted(estimates.pin(frame))
    found.write.parquet(f"file://{tmp_path}/r")
    reasons = {r.skip_reason: r["count"] for r in spark.read.parquet(f"file://{tmp_path}/r").groupBy("skip_reason").count().collect()}
    assert seen.get == {"windows": 10, "Success": reasons["Success"], "Low_Valid_Days": reasons["Low_Valid_Days"], "Est_Error": 0, "Timeout": 0}


def test_names_and_error_lines(spark, tmp_path):
    from datetime import datetime

    assert runs.run_name("pin", "UK", datetime(2024, 3, 5, 7, 9)) == "pin_UK_20240305_0709"
    with pytest.raises(ValueError):
        runs.run_name("pin", "Atlantis", datetime(2024, 3, 5))
    runs.write_errors(spark.createDataFrame([("a", "no usable bars"), ("b", None)], "Symbol string, error string"), f"file://{tmp_path}/errors")
    assert sorted("".join(p.read_text() for p in (tmp_path / "errors").glob("part*")).splitlines()) == ["a : no usable bars", "b"]
