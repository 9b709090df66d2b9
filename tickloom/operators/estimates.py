"""PIN and AdjPIN over rolling windows.

Windows of PIN do not depend on each other: a symbol's dates are cut into slabs that overlap by a window, so that one long
series is estimated by many tasks. AdjPIN starts each window from the last estimate of the same symbol and is sequential by
definition: a symbol stays in one task, and the symbols of a task advance together, one window of each at a time. Starts that
do not depend on the last estimate are followed beforehand, in slabs like those of PIN. Each window has a time limit of its
own, which the windows that advance with it do not use up.

The ``*_marked`` functions end what they give for each symbol (or slab) with a row that says so, for ``runs.resumable``; the
``*_continued`` functions estimate the days that follow those of an earlier run from what that run has left of each symbol.

Nulls and edge cases: a symbol with fewer days than a window has no rows; windows with too few days with trades have a reason and
no estimate; whatever goes wrong with a window is its own reason and stops no other window or symbol; an empty panel gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.config import ApinConfig, PinConfig
from tickloom.functions import kernels, starts
from tickloom.functions.shipping import ship
from tickloom.functions.store import cut, dealt
from tickloom.schemas import APIN, EST_ERROR, GUESS, LOW_VALID_DAYS, MARKS, PIN, STATE, SUCCESS, TIMEOUT, names

#: Symbols of a task that advance together.
TOGETHER = 64


def _windows(days: pd.DataFrame, length: int) -> tuple[np.ndarray, np.ndarray]:
    view = np.lib.stride_tricks.sliding_window_view
    return view(days.B.to_numpy(float), length), view(days.S.to_numpy(float), length)


def best_of(kernel: kernels.Model, generate: Callable, measures: Callable, buys: np.ndarray, sells: np.ndarray, which: np.ndarray, config, clock: kernels.Clock | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameters, log-likelihood and fate of the best start of the windows ``which``; minus infinity where none has a sound end.

    generate: the starts of a window. A window whose starts cannot be made has none; all others are followed at once. clock: of
    the windows ``which``; a window is late if any of its starts is.
    """
    first, owner = [], []
    for k, i in enumerate(which):
        try:
            found = generate(buys[i], sells[i])
        except Exception:  # noqa: BLE001 - whatever is wrong with one window stays with it
            continue
        first.append(found)
        owner.append(np.full(len(found), k))
    p, likelihood, fate = np.full((len(which), len(kernel.names)), np.nan), np.full(len(which), -np.inf), np.full(len(which), kernels.CONVERGED, np.int8)
    if not first:
        return p, likelihood, fate
    owners = np.concatenate(owner)
    ends, reached, became = kernels.maximise(kernel, np.concatenate(first), buys[which], sells[which], config.cycles, config.tolerance, owners, clock)
    sound = np.isfinite(reached) & np.isfinite(ends).all(1) & np.isfinite(measures(ends)).all(1)
    reached = np.where(sound, reached, -np.inf)
    order = np.lexsort((-reached, owners))
    best = order[np.unique(owners[order], return_index=True)[1]]
    p[owners[best]], likelihood[owners[best]] = ends[best], reached[best]
    fate[owners[became == kernels.LATE]] = kernels.LATE
    return p, likelihood, fate


def _pin_measure(p: np.ndarray) -> np.ndarray:
    return kernels.pin_of(p)[:, None]


def _apin_measures(p: np.ndarray) -> np.ndarray:
    return np.column_stack(kernels.apin_psos(p))


def pin_windows(days: pd.DataFrame, config: PinConfig) -> pd.DataFrame:
    """PIN of each full window of one symbol's consecutive days (Symbol, Date, B, S, in order)."""
    length = config.windows.length
    if len(days) < length:
        return pd.DataFrame(columns=names(PIN))
    buys, sells = _windows(days, length)
    valid = (buys + sells > 0).sum(1)
    out = pd.DataFrame({"Symbol": days.Symbol.iloc[0], "Date": days.Date.to_numpy()[length - 1 :], "valid_days": valid.astype(np.int32)})
    estimates = np.full((len(buys), 6), np.nan)
    reason = np.where(valid < config.windows.min_valid, LOW_VALID_DAYS, EST_ERROR).astype(object)
    todo = np.flatnonzero(valid >= config.windows.min_valid)
    p, likelihood, _ = best_of(kernels.PIN, lambda b, s: starts.pin_starts(config.starts, b, s, config.extra_clusters), _pin_measure, buys, sells, todo, config)
    good = np.isfinite(likelihood)
    estimates[todo[good]] = np.column_stack([p[good], _pin_measure(p[good])])
    reason[todo[good]] = SUCCESS
    for k, name in enumerate(["a", "d", "u", "eb", "es", "PIN"]):
        out[name] = estimates[:, k]
    out["skip_reason"] = reason
    return out.astype(object).where(out.notna(), None)


def numbered(dense: DataFrame) -> DataFrame:
    """The panel with the place of each day in its symbol's series, from 0. A table as from ``daily.write_panel`` stays as it lies."""
    return dense.withColumn("n", F.row_number().over(Window.partitionBy("Symbol").orderBy("Date")) - 1)


def in_slabs(dense: DataFrame, work: Callable, length: int, slab: int, schema: str) -> DataFrame:
    """``work`` on each stretch of a symbol's days that holds ``slab`` window ends, dealt over tasks; one row for each window, and a mark if ``schema`` has one."""
    # The last length-1 days before a slab's first window end belong to that slab as well.
    own, ahead = F.floor(F.col("n") / slab), F.floor((F.col("n") + length - 1) / slab)
    days = numbered(dense).withColumn("days", F.count("*").over(Window.partitionBy("Symbol")))
    spread = cut(days.withColumn("slab", F.explode(F.sequence(own, ahead))), "slabs")
    marks = schema.endswith(MARKS)

    def one(key: tuple, days: pd.DataFrame) -> pd.DataFrame:
        began, days = time.monotonic(), days.sort_values("n")
        found = work(days)
        found = found[days.n.to_numpy()[length - 1 :] >= int(key[1]) * slab] if len(found) else found
        if not marks:
            return found
        # The slabs of a symbol are those of its window ends, and one more of days without.
        mark = {"Symbol": key[0], "done": True, "part": int(key[1]), "parts": (int(days.days.iloc[0]) + length - 2) // slab + 1, "windows": len(found), "seconds": time.monotonic() - began}
        return pd.concat([f for f in (found, pd.DataFrame([mark])) if len(f)]).reindex(columns=names(schema)).astype(object).pipe(_nulls)

    return dealt(spread, "Symbol", "slab").groupBy("Symbol", "slab").applyInPandas(one, schema)


def _nulls(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.where(frame.notna(), None)


def by_symbol(rows: Iterator[pd.DataFrame], together: int, work: Callable[[list[pd.DataFrame]], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``work`` on the whole series of some ``together`` symbols at a time, of rows in which each symbol's are together and in order."""
    rest = None
    for batch in rows:
        rest = batch if rest is None else pd.concat([rest, batch])
        # The days of a symbol are together, so all symbols but the last one are whole.
        if rest.Symbol.nunique() > together:
            whole = rest[rest.Symbol != rest.Symbol.iloc[-1]]
            yield work([days for _, days in whole.groupby("Symbol", sort=False)])
            rest = rest[rest.Symbol == rest.Symbol.iloc[-1]]
    if rest is not None and len(rest):
        yield work([days for _, days in rest.groupby("Symbol", sort=False)])


def pin_marked(dense: DataFrame, config: PinConfig = PinConfig()) -> DataFrame:
    """``pin``, with a row for each finished slab of a symbol after its windows."""
    ship(dense.sparkSession)
    return in_slabs(dense, lambda days: pin_windows(days, config), config.windows.length, config.slab, f"{PIN}, {MARKS}")


def pin(dense: DataFrame, config: PinConfig = PinConfig(), bucketed: bool = False) -> DataFrame:
    """One row for each full window: the estimate, or nulls and the reason why there is none.

    bucketed: the panel is a table as from ``daily.write_panel``, read without shuffle or sort, one task a bucket.
    """
    ship(dense.sparkSession)
    if not bucketed:
        return in_slabs(dense, lambda days: pin_windows(days, config), config.windows.length, config.slab, PIN)
    work = lambda rows: by_symbol(rows, 1, lambda frames: pd.concat([pin_windows(days, config) for days in frames]))
    return numbered(dense).mapInPandas(work, PIN)


def warm_start(last: np.ndarray, config: ApinConfig) -> np.ndarray:
    """The last estimate as a start; with tied shocks both shock chances are that of quiet days."""
    start = last.copy()
    if config.tie_theta:
        start[3] = start[2]
    return start[None, :]


def _generated(count: int, config: ApinConfig) -> Callable:
    model = kernels.adjusted(config.tie_theta)
    return lambda buys, sells: starts.apin_starts(model, buys, sells, count)


def apin_guesses(days: pd.DataFrame, config: ApinConfig, now: Callable = time.monotonic) -> pd.DataFrame:
    """Where the generated starts of each window with enough valid days lead: the best one's parameters, log-likelihood and fate, and the time used."""
    length = config.windows.length
    if len(days) < length:
        return pd.DataFrame(columns=names(GUESS))
    buys, sells = _windows(days, length)
    todo = np.flatnonzero((buys + sells > 0).sum(1) >= config.windows.min_valid)
    clock = kernels.Clock(np.full(len(todo), config.timeout_seconds), now)
    p, likelihood, fate = best_of(kernels.adjusted(config.tie_theta), _generated(config.warm_extra, config), _apin_measures, buys, sells, todo, config, clock)
    guesses = np.full((len(buys), 10), np.nan)
    reached, became, spent = np.full(len(buys), -np.inf), np.zeros(len(buys), int), np.zeros(len(buys))
    guesses[todo], reached[todo], became[todo], spent[todo] = p, likelihood, fate, clock.used
    return pd.DataFrame({"Symbol": days.Symbol.iloc[0], "Date": days.Date.to_numpy()[length - 1 :], "guess": list(guesses), "reached": reached, "fate": became, "spent": spent})


class _Series:
    """One symbol on its way through its windows."""

    def __init__(self, days: pd.DataFrame, config: ApinConfig, now: Callable):
        length = config.windows.length
        self.symbol, self.rows, self.seconds, self.guesses = days.Symbol.iloc[0], [], 0.0, None
        before = next((x for x in days["last"] if x is not None and np.ndim(x)), None) if "last" in days else None
        self.last: np.ndarray | None = None if before is None else np.asarray(before, float)
        self.valid = np.zeros(0, int)
        if len(days) < length:
            return
        self.dates = days.Date.to_numpy()[length - 1 :]
        self.buys, self.sells = _windows(days, length)
        self.valid = (self.buys + self.sells > 0).sum(1)
        if config.warm_extra:
            if "guess" not in days:
                days = days.merge(apin_guesses(days, config, now), on=["Symbol", "Date"], how="left")
            self.guesses = days[["guess", "reached", "fate", "spent"]].iloc[length - 1 :].reset_index(drop=True)

    def guess(self, i: int) -> tuple[np.ndarray, float, int] | None:
        """What the generated starts of window ``i`` have led to, where they have led to anything."""
        if self.guesses is None or not np.isfinite(self.guesses.reached[i]):
            return None
        return np.asarray(self.guesses.guess[i], float), float(self.guesses.reached[i]), int(self.guesses.fate[i])

    def spent(self, i: int) -> float:
        """Seconds that the generated starts of window ``i`` have taken, where they count."""
        return float(np.nan_to_num(self.guesses.spent[i])) if self.guesses is not None and self.last is not None else 0.0


def _advance(series: list[_Series], i: int, config: ApinConfig, now: Callable) -> list[tuple[str, np.ndarray | None]]:
    """Reason and estimate of window ``i`` of each series."""
    buys, sells = np.stack([s.buys[i] for s in series]), np.stack([s.sells[i] for s in series])
    fresh, warm = iter(series), _generated(config.fresh_starts, config)

    def generate(b: np.ndarray, s: np.ndarray) -> np.ndarray:
        last = next(fresh).last
        return warm(b, s) if last is None else warm_start(last, config)

    clock = kernels.Clock(np.array([config.timeout_seconds - s.spent(i) for s in series]), now)
    p, reached, fate = best_of(kernels.adjusted(config.tie_theta), generate, _apin_measures, buys, sells, np.arange(len(series)), config, clock)
    out = []
    for k, one in enumerate(series):
        best, height, late = p[k], reached[k], fate[k] == kernels.LATE
        one.seconds += float(clock.used[k]) + one.spent(i)
        other = one.guess(i) if one.last is not None else None
        if other is not None:
            late = late or other[2] == kernels.LATE
            if other[1] > height:
                best, height = other[:2]
        if late:
            out.append((TIMEOUT, None))
        elif not np.isfinite(height):
            out.append((EST_ERROR, None))
        else:
            out.append((SUCCESS, best))
    return out


def _followed(frames: list[pd.DataFrame], config: ApinConfig, now: Callable) -> list[_Series]:
    """Several symbols (the days of each, in order), each led through all its windows."""
    series = [_Series(days, config, now) for days in frames]
    nothing = (None,) * 12
    for i in range(max((len(s.valid) for s in series), default=0)):
        ready = []
        for s in series:
            if i < len(s.valid):
                if s.valid[i] >= config.windows.min_valid:
                    ready.append(s)
                elif config.emit_skips:
                    s.rows.append((s.symbol, s.dates[i], int(s.valid[i]), *nothing, LOW_VALID_DAYS))
        if not ready:
            continue
        try:
            found = _advance(ready, i, config, now)
        except Exception:  # noqa: BLE001 - one window at a time, so that only the one at fault is without estimate
            found = []
            for s in ready:
                try:
                    found += _advance([s], i, config, now)
                except Exception:  # noqa: BLE001
                    found.append((EST_ERROR, None))
        for s, (reason, best) in zip(ready, found):
            s.last = best
            head = (s.symbol, s.dates[i], int(s.valid[i]))
            if best is not None:
                s.rows.append((*head, *best.tolist(), *_apin_measures(best[None])[0].tolist(), reason))
            elif config.emit_skips:
                s.rows.append((*head, *nothing, reason))
    return series


def apin_series(frames: list[pd.DataFrame], config: ApinConfig, now: Callable = time.monotonic) -> pd.DataFrame:
    """AdjPIN of each full window of several symbols (the days of each, in order), each window started from the symbol's last success.

    A window with too few days with trades leaves the last estimate in place; a failure forgets it.
    """
    return pd.DataFrame([row for s in _followed(frames, config, now) for row in s.rows], columns=names(APIN)).astype(object)


def apin_windows(days: pd.DataFrame, config: ApinConfig, now: Callable = time.monotonic) -> pd.DataFrame:
    """``apin_series`` of one symbol."""
    return apin_series([days], config, now)


def _marked_series(frames: list[pd.DataFrame], config: ApinConfig) -> pd.DataFrame:
    """``apin_series`` with each symbol's mark after its rows, which holds its last estimate as well."""
    out = []
    for s in _followed(frames, config, time.monotonic):
        mark = (s.symbol, *(None,) * (len(names(APIN)) - 1), True, 0, 1, len(s.valid), s.seconds, None if s.last is None else s.last.tolist())
        out += [(*row, *(None,) * 6) for row in s.rows] + [mark]
    return _nulls(pd.DataFrame(out, columns=names(f"{APIN}, {MARKS}")).astype(object))


def apin_marked(dense: DataFrame, config: ApinConfig = ApinConfig()) -> DataFrame:
    """``apin``, with the reason of each row, and with a row for each finished symbol after its windows. Further columns of ``dense``: last, an estimate to go on from."""
    ship(dense.sparkSession)
    panel = cut(dense, "panel")
    if config.warm_extra:
        guesses = in_slabs(panel, lambda days: apin_guesses(days, config), config.windows.length, config.slab, GUESS)
        panel = cut(panel.join(guesses, ["Symbol", "Date"], "left"), "guesses")
    schema = f"{APIN}, {MARKS}"
    return dealt(panel, "Symbol", each=TOGETHER).sortWithinPartitions("Symbol", "Date").mapInPandas(lambda rows: by_symbol(rows, TOGETHER, lambda frames: _marked_series(frames, config)), schema)


def apin(dense: DataFrame, config: ApinConfig = ApinConfig(), bucketed: bool = False) -> DataFrame:
    """AdjPIN and PSOS of the rolling windows; with ``emit_skips`` off there is no reason column and no row without estimate.

    bucketed: the panel is a table as from ``daily.write_panel``, read without shuffle or sort, one task a bucket.
    """
    if bucketed:
        ship(dense.sparkSession)
        found = numbered(dense).mapInPandas(lambda rows: by_symbol(rows, TOGETHER, lambda frames: apin_series(frames, config)), APIN)
    else:
        found = apin_marked(dense, config).where("done IS NULL").select(*names(APIN))
    return found if config.emit_skips else found.drop("skip_reason")


def tails(dense: DataFrame, length: int) -> DataFrame:
    """Symbol, Dates, B and S of each symbol's last ``length`` - 1 days, which the next window needs."""
    back = dense.withColumn("back", F.row_number().over(Window.partitionBy("Symbol").orderBy(F.desc("Date")))).where(F.col("back") < length)
    days = back.groupBy("Symbol").agg(F.array_sort(F.collect_list(F.struct("Date", "B", "S"))).alias("d"))
    return days.select("Symbol", F.col("d.Date").alias("Dates"), F.col("d.B").alias("B"), F.col("d.S").alias("S"))


def _resumed(days: DataFrame, state: DataFrame | None) -> DataFrame:
    """The days that ``state`` does not cover yet, after the last days that it holds; ``last`` is what it has of each symbol."""
    new = days.select("Symbol", "Date", "B", "S")
    nothing = F.lit(None).cast("array<double>").alias("last")
    if state is None:
        return new.select("*", nothing)
    held = state.select("Symbol", F.explode(F.arrays_zip("Dates", "B", "S")).alias("d"), "last").select("Symbol", "d.Dates", "d.B", "d.S", "last").withColumnRenamed("Dates", "Date")
    until = state.select("Symbol", F.element_at("Dates", -1).alias("until"))
    later = new.join(until, "Symbol", "left").where("until IS NULL OR Date > until").select("Symbol", "Date", "B", "S", nothing)
    return held.unionByName(later)


def pin_continued(days: DataFrame, state: DataFrame | None = None, config: PinConfig = PinConfig()) -> tuple[DataFrame, DataFrame]:
    """PIN of the windows that end on days which ``state`` does not cover, and the state after them; both are to be written by the caller.

    days: of the dense panel, following those of the state; days that the state covers are ignored. state: Symbol, Dates, B, S, last.
    """
    panel = cut(_resumed(days, state), "resumed")
    return pin(panel.drop("last"), config), tails(panel, config.windows.length).withColumn("last", F.lit(None).cast("array<double>")).select(*names(STATE))


def apin_continued(days: DataFrame, state: DataFrame | None = None, config: ApinConfig = ApinConfig()) -> tuple[DataFrame, DataFrame]:
    """AdjPIN like ``pin_continued``; the state keeps each symbol's last estimate, from which its next window starts, as in one run."""
    panel = cut(_resumed(days, state), "resumed")
    found = cut(apin_marked(panel, config), "continued")
    after = tails(panel, config.windows.length).join(found.where("done").select("Symbol", "last"), "Symbol", "left")
    rows = found.where("done IS NULL").select(*names(APIN))
    return rows if config.emit_skips else rows.drop("skip_reason"), after.select(*names(STATE))
