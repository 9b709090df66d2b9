"""Likelihoods and single EM steps at given parameters, as plain expressions that SQL can check.

Every day's terms are computed once and summed over the rolling window, so a window costs no more than a day.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.config import Windows
from tickloom.operators.rolling import frame, full_windows


def num(x: float) -> str:
    """A double literal for Spark and DuckDB alike."""
    text = repr(float(x))
    return text if "e" in text else text + "e0"


def branches(p: dict[str, float]) -> list[tuple[float, float, float]]:
    """Chance, buy rate and sell rate of each branch of PIN (a, d, u, eb, es) or AdjPIN."""
    a, d = p["a"], p["d"]
    if "u" in p:
        return [(1 - a, p["eb"], p["es"]), (a * d, p["eb"], p["es"] + p["u"]), (a * (1 - d), p["eb"] + p["u"], p["es"])]
    eb, es, ub, us, pb, ps, t1, t2 = (p[k] for k in ("eb", "es", "ub", "us", "pb", "ps", "t1", "t2"))
    return [
        ((1 - a) * (1 - t1), eb, es),
        ((1 - a) * t1, eb + pb, es + ps),
        (a * d * (1 - t2), eb, es + us),
        (a * d * t2, eb + pb, es + ps + us),
        (a * (1 - d) * (1 - t2), eb + ub, es),
        (a * (1 - d) * t2, eb + pb + ub, es + ps),
    ]


def log_terms(p: dict[str, float]) -> list[str]:
    """SQL of each branch's log chance of a day's B and S, without factorials."""
    out = []
    for chance, b, s in branches(p):
        out.append(f"({num(math.log(chance) - b - s)} + B * {num(math.log(b))} + S * {num(math.log(s))})")
    return out


def day_sql(p: dict[str, float]) -> str:
    """SQL of a day's log-likelihood."""
    terms = log_terms(p)
    top = f"greatest({', '.join(terms)})"
    return f"({top} + ln({' + '.join(f'exp({t} - {top})' for t in terms)}))"


def posterior_sql(p: dict[str, float], k: int) -> str:
    """SQL of the chance that a day belongs to branch ``k``."""
    terms = log_terms(p)
    return f"(1e0 / ({' + '.join(f'exp({t} - {terms[k]})' for t in terms)}))"


def window_likelihood(dense: DataFrame, p: dict[str, float], windows: Windows = Windows()) -> DataFrame:
    """Symbol, Date and loglik of each full window at fixed parameters."""
    return full_windows(dense.withColumn("term", F.expr(day_sql(p))), windows, loglik="term")


def em_sums(p: dict[str, float]) -> dict[str, str]:
    """SQL of the per-day sums that one EM step needs: days, buys and sells of each branch."""
    out = {}
    for k in range(len(branches(p))):
        w = posterior_sql(p, k)
        out |= {f"w{k}": w, f"b{k}": f"({w} * B)", f"s{k}": f"({w} * S)"}
    return out


def em_update(p: dict[str, float], days: int) -> dict[str, str]:
    """SQL of the parameters after one EM step, over the window sums named as in ``em_sums``."""
    rate = branches(p)
    if "u" in p:
        u, eb, es = p["u"], p["eb"], p["es"]
        return {
            "a": f"(w1 + w2) / {days}e0",
            "d": "w1 / (w1 + w2)",
            "u": f"(b2 * {num(u / (u + eb))} + s1 * {num(u / (u + es))}) / (w1 + w2)",
            "eb": f"(b0 + b1 + b2 * {num(eb / (u + eb))}) / {days}e0",
            "es": f"(s0 + s2 + s1 * {num(es / (u + es))}) / {days}e0",
        }

    def part(side: str, value: float, of: list[int]) -> str:
        return " + ".join(f"{side}{k} * {num(value / rate[k][1 if side == 'b' else 2])}" for k in of)

    return {
        "a": f"(w2 + w3 + w4 + w5) / {days}e0",
        "d": "(w2 + w3) / (w2 + w3 + w4 + w5)",
        "t1": "w1 / (w0 + w1)",
        "t2": "(w3 + w5) / (w2 + w3 + w4 + w5)",
        "ub": f"({part('b', p['ub'], [4, 5])}) / (w4 + w5)",
        "us": f"({part('s', p['us'], [2, 3])}) / (w2 + w3)",
        "eb": f"({part('b', p['eb'], [0, 1, 2, 3, 4, 5])}) / {days}e0",
        "es": f"({part('s', p['es'], [0, 1, 2, 3, 4, 5])}) / {days}e0",
        "pb": f"({part('b', p['pb'], [1, 3, 5])}) / (w1 + w3 + w5)",
        "ps": f"({part('s', p['ps'], [1, 3, 5])}) / (w1 + w3 + w5)",
    }


def em_step(dense: DataFrame, p: dict[str, float], windows: Windows = Windows()) -> DataFrame:
    """Symbol, Date and the parameters of each full window after one EM step from ``p``."""
    sums = full_windows(dense, windows, **em_sums(p))
    return sums.select("Symbol", "Date", *(F.expr(e).alias(k) for k, e in em_update(p, windows.length).items()))


def pin_grid(dense: DataFrame, levels: tuple[float, ...] = (0.1, 0.5, 0.9), windows: Windows = Windows()) -> DataFrame:
    """The best point of the grid start for each window with enough valid days: a, d, g and its log-likelihood.

    g is the uninformed share of buys; the rates follow from the window's means. Points with a negative sell rate are left
    out. Of equally likely points, the one with the smallest (a, d, g) wins.
    """
    by = frame(windows)
    days = dense.withColumn("rn", F.row_number().over(Window.partitionBy("Symbol").orderBy("Date")))
    days = days.withColumn("held", F.collect_list(F.struct("B", "S")).over(by)).withColumn("valid", F.sum(F.expr("CAST(B + S > 0 AS INT)")).over(by))
    full = days.where((F.col("rn") >= windows.length) & (F.col("valid") >= windows.min_valid))
    counted = full.select("Symbol", "Date", F.explode("held").alias("h")).groupBy("Symbol", "Date", "h.B", "h.S").agg(F.count("*").cast("double").alias("n"))
    means = rolling_means(dense, windows)
    grid = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(d).alias("d"), F.lit(g).alias("g")) for a in levels for d in levels for g in levels))
    points = means.withColumn("p", F.explode(grid)).select("Symbol", "Date", "mb", "ms", "p.*")
    points = points.withColumn("eb", F.expr("g * mb")).withColumn("u", F.expr("(mb - g * mb) / (a * (1e0 - d))")).withColumn("es", F.expr("ms - a * d * u")).where("es > 0 AND eb > 0 AND u > 0")
    term = grid_term()
    scored = points.join(counted, ["Symbol", "Date"]).groupBy("Symbol", "Date", "a", "d", "g").agg(F.sum(F.expr(f"n * {term}")).alias("loglik"))
    best = scored.groupBy("Symbol", "Date").agg(F.min(F.expr("struct(-round(loglik, 6) AS l, a, d, g)")).alias("m"))
    return best.select("Symbol", "Date", "m.a", "m.d", "m.g", F.expr("-m.l").alias("loglik"))


def rolling_means(dense: DataFrame, windows: Windows = Windows()) -> DataFrame:
    totals = full_windows(dense, windows, sum_b="B", sum_s="S")
    return totals.select("Symbol", "Date", (F.col("sum_b") / float(windows.length)).alias("mb"), (F.col("sum_s") / float(windows.length)).alias("ms"))


def grid_term() -> str:
    """SQL of a day's log-likelihood of PIN at columns a, d, u, eb, es."""
    quiet = "(ln(1e0 - a) - eb - es + B * ln(eb) + S * ln(es))"
    bad = "(ln(a * d) - eb - es - u + B * ln(eb) + S * ln(es + u))"
    good = "(ln(a * (1e0 - d)) - eb - u - es + B * ln(eb + u) + S * ln(es))"
    top = f"greatest({quiet}, {bad}, {good})"
    return f"({top} + ln(exp({quiet} - {top}) + exp({bad} - {top}) + exp({good} - {top})))"
