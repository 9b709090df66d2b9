import dataclasses
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom import config
from tickloom.functions import kernels, starts
from tickloom.functions.normal import cdf
from tickloom.operators import daily, estimates, likelihood, report, runs, vpin


def simulated(model, p, days, seed=0):
    rng = np.random.default_rng(seed)
    p = np.array([p], float)
    branch = rng.choice(len(model.buy), days, p=model.weights(p)[0])
    rates = p[0, model.chances :]
    return rng.poisson((model.buy @ rates)[branch]).astype(float), rng.poisson((model.sell @ rates)[branch]).astype(float)


def panel(buys, sells, symbol="s"):
    return pd.DataFrame({"Symbol": symbol, "Date": pd.date_range("2020-01-01", periods=len(buys)).date, "B": buys.astype(int), "S": sells.astype(int)})


def test_pin_parameters_are_recovered():
    true = [0.4, 0.3, 80, 100, 90]
    b, s = simulated(kernels.PIN, true, 3000)
    first = starts.pin_ea(b[:200], s[:200])
    p, l, fate = kernels.maximise(kernels.PIN, first, b[None], s[None], 5000, 1e-10, np.zeros(len(first), int))
    assert fate[l.argmax()] == kernels.CONVERGED
    assert np.allclose(p[l.argmax()], true, rtol=0.06)


@pytest.mark.parametrize("tied", [False, True])
def test_adjpin_parameters_are_recovered(tied):
    true = [0.4, 0.3, 0.25, 0.25, 100, 90, 80, 120, 60, 70]
    model = kernels.adjusted(tied)
    b, s = simulated(model, true, 4000)
    first = starts.apin_starts(model, b, s, 3)
    p, l, _ = kernels.maximise(model, first, b[None], s[None], 300, 1e-10, np.zeros(len(first), int))
    best = p[l.argmax()]
    assert np.allclose(best, true, rtol=0.15, atol=0.03)
    assert not tied or best[2] == best[3]


def test_every_step_raises_the_likelihood():
    rng = np.random.default_rng(1)
    for model in (kernels.PIN, kernels.adjusted(), kernels.adjusted(True)):
        b, s = rng.poisson(3, (5, 60)).astype(float), rng.poisson(4, (5, 60)).astype(float)
        p = model.clamp(np.column_stack([rng.uniform(0.1, 0.9, (5, model.chances)), rng.uniform(0.5, 5, (5, model.buy.shape[1]))]))
        if model.tied:
            p[:, 3] = p[:, 2]
        before = None
        for _ in range(30):
            p, now = kernels.step(model, p, *kernels.collapsed(b, s))
            assert before is None or (now >= before - 1e-9).all()
            before = now


def test_kernel_and_expressions_agree(spark):
    rng = np.random.default_rng(2)
    days = panel(rng.poisson(2, 60), rng.poisson(3, 60))
    frame = spark.createDataFrame(days)
    for point, model in (({"a": 0.4, "d": 0.5, "u": 1.5, "eb": 1.2, "es": 1.1}, kernels.PIN), ({"a": 0.4, "d": 0.5, "t1": 0.2, "t2": 0.3, "ub": 1.5, "us": 1.2, "eb": 1.1, "es": 1.0, "pb": 0.8, "ps": 0.7}, kernels.adjusted())):
        p, l = kernels.step(model, np.array([[point[n] for n in model.names]]), *kernels.collapsed(days.B.to_numpy(float)[None], days.S.to_numpy(float)[None]))
        assert abs(likelihood.window_likelihood(frame, point).first().loglik - l[0]) < 1e-8
        row = likelihood.em_step(frame, point).first()
        assert np.allclose([row[n] for n in model.names], p[0], atol=1e-10)


def test_line_clusters_are_complete_linkage():
    assert starts.clusters(np.array([0.0, 1.0, 9.0, 10.0, 30.0]), 3).tolist() == [0, 0, 1, 1, 2]
    assert starts.clusters(np.array([5.0, 5.0, 5.0]), 3).max() == 2


def test_pin_rows_and_slabs(spark):
    rng = np.random.default_rng(3)
    whole = panel(rng.poisson(4, 150), rng.poisson(5, 150), "a")
    thin = panel(np.where(np.arange(70) % 5 == 0, 1, 0), np.zeros(70), "thin")
    short = panel(rng.poisson(4, 59), rng.poisson(4, 59), "short")
    frame = spark.createDataFrame(pd.concat([whole, thin, short]))
    one = estimates.pin(frame, config.PinConfig(slab=1000)).toPandas().sort_values(["Symbol", "Date"]).reset_index(drop=True)
    many = estimates.pin(frame, config.PinConfig(slab=16)).toPandas().sort_values(["Symbol", "Date"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(one, many, check_exact=False, atol=1e-6)
    assert one.groupby("Symbol").size().to_dict() == {"a": 91, "thin": 11}
    good, low = one[one.Symbol == "a"], one[one.Symbol == "thin"]
    assert (good.skip_reason == "Success").all() and good.PIN.between(0, 1).all()
    assert (low.skip_reason == "Low_Valid_Days").all() and low.PIN.isna().all()
    assert {r.skip_reason: r.n for r in report.reasons(spark.createDataFrame(one)).collect()} == {"Success": 91, "Low_Valid_Days": 11}


def test_distinct_days_keep_their_number():
    rng = np.random.default_rng(8)
    b, s = rng.poisson(1, (7, 60)).astype(float), rng.poisson(1, (7, 60)).astype(float)
    days, times = kernels.collapsed(b, s)
    for k in range(7):
        held = {(x, y): n for x, y, n in zip(days[k, 0], days[k, 1], times[k]) if n}
        assert held == pd.Series(list(zip(b[k], s[k]))).value_counts().to_dict()


def test_adjpin_state_survives_thin_windows_and_not_failures(monkeypatch):
    rng = np.random.default_rng(4)
    days = panel(rng.poisson(4, 66), rng.poisson(5, 66))
    seen = []
    inner = kernels.maximise

    def watched(model, first, *args):
        seen.append(len(first))
        p, l, fate = inner(model, first, *args)
        return p, l, np.full_like(fate, kernels.LATE) if len(seen) == 3 else fate

    monkeypatch.setattr(estimates.kernels, "maximise", watched)
    out = estimates.apin_windows(days, config.APIN_SKIP)
    assert seen == [40, 1, 1, 40, 1, 1, 1] and out.skip_reason.tolist().count("Timeout") == 1
    seen.clear()
    assert len(estimates.apin_windows(days, config.APIN_BASE)) == 6
    seen.clear()
    estimates.apin_windows(days, config.APIN_WARM)
    assert seen == [7 * 10, 40, 1, 40, 1, 1, 1, 1]


def test_symbols_that_advance_together_are_estimated_as_if_alone():
    rng = np.random.default_rng(10)
    frames = [panel(rng.poisson(4, n), rng.poisson(5, n), f"s{n}") for n in (63, 59, 61, 70)]
    for preset in (config.APIN_SKIP, config.APIN_THETA, config.APIN_WARM):
        together = estimates.apin_series(frames, preset)
        alone = pd.concat([estimates.apin_windows(f, preset) for f in frames])
        assert together.groupby("Symbol").size().to_dict() == {"s63": 4, "s61": 2, "s70": 11}
        assert np.allclose(together.APIN.astype(float), alone.APIN.astype(float), atol=1e-4)


def test_what_breaks_one_window_breaks_no_other(monkeypatch):
    rng = np.random.default_rng(11)
    frames = [panel(rng.poisson(4, 62), rng.poisson(5, 62), s) for s in ("bad", "fine")]
    inner = kernels.maximise
    odd = frames[0].B.to_numpy(float)[1:61]

    def broken(model, first, buys, *args):
        if any((b == odd).all() for b in buys):
            raise ZeroDivisionError
        return inner(model, first, buys, *args)

    monkeypatch.setattr(estimates.kernels, "maximise", broken)
    out = estimates.apin_series(frames, config.APIN_SKIP)
    assert out[out.Symbol == "bad"].skip_reason.tolist() == ["Success", "Est_Error", "Success"] and (out[out.Symbol == "fine"].skip_reason == "Success").all()


def test_estimates_are_maxima_of_the_likelihood():
    """Against a search that knows nothing of the model's steps."""
    rng = np.random.default_rng(12)
    days = panel(*simulated(kernels.PIN, [0.4, 0.4, 9, 6, 5], 60, seed=3))
    row = estimates.pin_windows(days, config.PinConfig()).iloc[0]
    data = kernels.collapsed(days.B.to_numpy(float)[None], days.S.to_numpy(float)[None])
    best = np.array([row[n] for n in kernels.PIN.names], float)
    at = kernels.step(kernels.PIN, best[None], *data)[1][0]
    tries = np.column_stack([rng.uniform(0.01, 0.99, (20_000, 2)), rng.uniform(0.1, 15, (20_000, 3))])
    tries = np.vstack([tries, kernels.PIN.clamp(best * np.exp(rng.normal(0, 0.05, (20_000, 5))))])
    many = [np.repeat(x, len(tries), axis=0) for x in data]
    assert kernels.step(kernels.PIN, tries, *many)[1].max() <= at + 1e-6


@pytest.mark.parametrize("preset", [config.APIN_BASE, config.APIN_WARM])
def test_few_symbols_are_spread_over_tasks(spark, preset):
    rng = np.random.default_rng(9)
    frame = spark.createDataFrame(pd.concat([panel(rng.poisson(4, 62), rng.poisson(5, 62), f"s{k}") for k in range(5)]))
    for found in (estimates.pin(frame), estimates.apin(frame, preset)):
        parts = found.withColumn("task", F.spark_partition_id()).groupBy("Symbol").agg(F.countDistinct("task").alias("tasks"), F.max("task").alias("task"), F.count("*").alias("n")).collect()
        assert len({r.task for r in parts}) == 5 and all(r.tasks == 1 and r.n == 3 for r in parts)


def test_tied_shocks_and_measures_in_range(spark):
    rng = np.random.default_rng(5)
    frame = spark.createDataFrame(panel(rng.poisson(4, 63), rng.poisson(5, 63)))
    rows = estimates.apin(frame, config.APIN_THETA).collect()
    assert len(rows) == 4
    for r in rows:
        assert abs(r.t1 - r.t2) < 1e-12 and 0 <= r.APIN <= 1 and 0 <= r.PSOS <= 1 and r.APIN + r.PSOS <= 1
    assert "skip_reason" not in estimates.apin(frame, config.APIN_BASE).columns


def test_normal_distribution(spark):
    xs = [-12 + k * 0.37 for k in range(66)] + [0.0, 40.0, -40.0]
    got = spark.createDataFrame([(x,) for x in xs], "z double").select("z", cdf("z").alias("p")).collect()
    assert max(abs(r.p - 0.5 * math.erfc(-r.z / math.sqrt(2))) for r in got) < 1e-14


def test_vpin_equals_a_bucket_filling_loop(spark):
    rng = np.random.default_rng(6)
    stamps = pd.date_range("2024-01-01", periods=400, freq="h")
    bars = pd.DataFrame({"Symbol": "s", "Datetime": stamps, "Open": rng.uniform(9, 11, 400), "Close": rng.uniform(9, 11, 400), "Volume": rng.uniform(0.1, 9, 400)})
    frame = spark.createDataFrame(bars).withColumn("Datetime", __import__("pyspark").sql.functions.expr("CAST(Datetime AS TIMESTAMP_NTZ)"))
    cfg = config.VpinConfig(buckets=8, sample=10, min_bars=10)
    out = vpin.vpin(vpin.usable_bars(frame, cfg), cfg).orderBy("BucketNo").collect()
    size = bars.Volume.sum() / stamps.normalize().nunique() / 8
    z = (bars.Close - bars.Open) / (bars.Close - bars.Open).std()
    buy = [0.5 * math.erfc(-x / math.sqrt(2)) for x in z]
    found, free, b, s = [], size, 0.0, 0.0
    for v, share in zip(bars.Volume, buy):
        while v > 1e-9:
            part = min(v, free)
            b, s, free, v = b + part * share, s + part * (1 - share), free - part, v - part
            if free < 1e-9:
                found.append((b, s))
                free, b, s = size, 0.0, 0.0
    assert len(out) == len(found)
    gaps = [abs(x - y) for x, y in found]
    for k, row in enumerate(out):
        assert abs(row.AggBuyVol - found[k][0]) < 1e-6 and abs(row.AOI - gaps[k]) < 1e-6
        assert (row.VPIN is None) == (k < 9) and (k < 9 or abs(row.VPIN - sum(gaps[k - 9 : k + 1]) / (10 * size)) < 1e-9)
    assert vpin.without_result(frame, vpin.vpin(frame, config.VpinConfig(sample=10**6))).first().Symbol == "s"


def test_dense_panel_keeps_every_count(spark):
    rows = [("a", "2020-01-01", 1), ("a", "2020-01-01", -1), ("b", "2020-01-03", 1), ("b", "2020-01-04", None), ("c", "2020-01-05", 0), (None, "2020-01-06", 1)]
    ticks = spark.createDataFrame(rows, "Symbol string, d string, LR int").selectExpr("Symbol", "CAST(d AS DATE) AS Date", "LR")
    counted = daily.daily_counts(ticks)
    dense = daily.dense_daily(counted)
    assert dense.count() == 2 * 3
    total = dense.selectExpr("sum(B)", "sum(S)").first()
    assert tuple(total) == (2, 1)
    assert [f.dataType.simpleString() for f in dense.schema] == ["string", "date", "int", "int"]


def test_outputs(spark, tmp_path):
    frame = spark.createDataFrame([("b", None), ("a", 1.0)], "Symbol string, PIN double")
    runs.write_result(frame, f"file://{tmp_path}/r", ["Symbol"])
    assert [r.Symbol for r in spark.read.parquet(f"file://{tmp_path}/r.parquet").collect()] == ["a", "b"]
    text = "".join(p.read_text() for p in (tmp_path / "r_sample.csv").glob("part*"))
    assert text == "Symbol,PIN\na,1.0\nb,NA\n"
    assert runs.union_by_name(frame, frame.select("Symbol")).count() == 4
    assert runs.output_dir("/x", "UK", "pin") == "/x/UK/pin"


def test_reports_and_reasons(spark):
    rows = spark.createDataFrame([("a", 0.25), ("b", None)], "Symbol string, VPIN double")
    one = report.report(rows, "VPIN").first()
    assert (one.n_rows, one.estimated, one.lowest, one.outcome) == ("2", "50.0%", "0.2500", "ok")
    assert report.report(rows.where("VPIN IS NULL"), "VPIN").first().outcome == "no result: no estimate succeeded"
    assert report.report(rows.where("false"), "VPIN").first().outcome == "no result: no symbol has enough data"
    stamps = [("thin", 1.0, 2.0, 3), ("flat", 1.0, 1.0, 300), ("null", None, None, 3)]
    bars_ = spark.createDataFrame([(s, k, o, c, 1.0) for s, o, c, n in stamps for k in range(n)], "Symbol string, k int, Open double, Close double, Volume double").withColumn("Datetime", F.expr("TIMESTAMP_NTZ '2020-01-01' + make_interval(0, 0, 0, 0, k)"))
    cfg = config.VpinConfig(min_bars=2)
    errors = {r.Symbol: r.error for r in vpin.without_result(bars_, vpin.vpin(vpin.usable_bars(bars_, cfg), cfg), cfg).collect()}
    assert errors == {"thin": "fewer than 200 ticks: 6", "flat": "price changes do not vary", "null": "no usable bars"}


def test_the_panel_reads_the_trades_once(spark, tmp_path):
    rows = [("a", "2020-01-01", 1), ("b", "2020-01-03", -1)]
    spark.createDataFrame(rows, "Symbol string, d string, LR int").selectExpr("Symbol", "CAST(d AS DATE) AS Date", "LR").write.parquet(f"file://{tmp_path}/ticks")
    dense = daily.dense_daily(daily.daily_counts(spark.read.parquet(f"file://{tmp_path}/ticks")))
    assert dense.count() == 4
    assert not [f for f in dense.inputFiles() if "/ticks/" in f] and dense.inputFiles()


def test_busy_days_that_overflow_plain_products(spark):
    from decimal import Decimal, getcontext

    getcontext().prec = 60
    rng = np.random.default_rng(5)
    buys, sells = rng.poisson(200, 61), rng.poisson(220, 61)
    rows = {r.Date: r for r in likelihood.pin_grid(spark.createDataFrame(panel(buys, sells), "Symbol string, Date date, B int, S int")).collect()}
    assert len(rows) == 2
    days = panel(buys, sells).Date.tolist()
    for at in (59, 60):
        b, s = buys[at - 59 : at + 1].tolist(), sells[at - 59 : at + 1].tolist()
        best = None
        for a, d, g in ((a, d, g) for a in (0.1, 0.5, 0.9) for d in (0.1, 0.5, 0.9) for g in (0.1, 0.5, 0.9)):
            mb, ms = sum(b) / 60, sum(s) / 60
            eb, u = g * mb, (mb - g * mb) / (a * (1 - d))
            es = ms - a * d * u
            if min(es, eb, u) <= 0:
                continue
            branches = [(1 - a, eb, es), (a * d, eb, es + u), (a * (1 - d), eb + u, es)]
            total = sum(sum(Decimal(w) * (-Decimal(x) - Decimal(y)).exp() * Decimal(x) ** i * Decimal(y) ** j for w, x, y in branches).ln() for i, j in zip(b, s))
            if best is None or total > best[0]:
                best = (total, a, d, g)
        r = rows[days[at]]
        assert (r.a, r.d, r.g) == best[1:] and math.isclose(r.loglik, float(best[0]), abs_tol=2e-6)
