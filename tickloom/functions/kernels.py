"""Maximum likelihood of Poisson mixtures of trading days, for many windows and starts at once.

A day belongs to one of a few branches; in each, buys and sells are Poisson with a rate that is a sum of some of the
model's rates. Expectation-maximisation attributes counts to the rates by superposition, so each step is closed form and
raises the likelihood; squared extrapolation speeds it up and gives way to the plain step wherever it would lower the likelihood.
Rows that still climb after a given number of cycles are finished by second-order steps (``ascent``), so every start is followed to its end.
"""

from __future__ import annotations

import functools
import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from tickloom.functions import ascent

RATE_FLOOR, CHANCE_FLOOR = 1e-8, 1e-10


#: What became of a row: converged, or out of time.
CONVERGED, LATE = 0, 1


class Clock:
    """Time that windows have used, where the rows of many advance together: each step's time is shared by the rows that it moves."""

    def __init__(self, limits: np.ndarray, now: Callable[[], float] = time.monotonic):
        """limits: seconds of each window."""
        self.limits, self.used, self.now = np.asarray(limits, float), np.zeros(len(limits)), now
        self.last = now()

    def late(self, owner: np.ndarray) -> np.ndarray:
        """Which of the rows that were on their way since the last call have no time left; owner: the window of each."""
        at = self.now()
        self.used += np.bincount(owner, minlength=len(self.used)) * ((at - self.last) / max(len(owner), 1))
        self.last = at
        return self.used[owner] > self.limits[owner]


@dataclass(frozen=True, eq=False)
class Model:
    """Chances come first among the parameters, rates after them. buy, sell: branch by rate, 1 where it takes part."""

    names: tuple[str, ...]
    chances: int
    buy: np.ndarray
    sell: np.ndarray
    tied: bool = False

    @functools.cached_property
    def both(self) -> np.ndarray:
        """Branch by rate of buys, then of sells."""
        return np.concatenate([self.buy, self.sell])

    @functools.cached_property
    def shared(self) -> np.ndarray:
        return self.buy + self.sell

    def clamp(self, p: np.ndarray) -> np.ndarray:
        k, out = self.chances, p.copy()
        np.minimum(np.maximum(out[:, :k], CHANCE_FLOOR), 1 - CHANCE_FLOOR, out=out[:, :k])
        np.maximum(out[:, k:], RATE_FLOOR, out=out[:, k:])
        return out

    def weights(self, p: np.ndarray) -> np.ndarray:
        """Chance of each branch."""
        a, d = p[:, 0], p[:, 1]
        news = np.empty((len(p), 3))
        news[:, 0], news[:, 1], news[:, 2] = 1 - a, a * d, a * (1 - d)
        if self.chances == 2:
            return news
        out = np.empty((len(p), 3, 2))
        shock = p[:, [2, 3, 3]]
        out[:, :, 0], out[:, :, 1] = news * (1 - shock), news * shock
        return out.reshape(len(p), 6)

    @functools.cached_property
    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each chance, the branches that it is the share of, and of which branches (branch by chance)."""
        if self.chances == 2:
            return np.array([[0, 0], [1, 1], [1, 0]], float), np.array([[1, 0], [1, 1], [1, 1]], float)
        of, among = np.zeros((6, 4)), np.zeros((6, 4))
        of[2:, 0], among[:, 0] = 1, 1
        of[2:4, 1], among[2:, 1] = 1, 1
        of[1, 2], among[:2, 2] = 1, 1
        of[[3, 5], 3], among[2:, 3] = 1, 1
        if self.tied:
            of[1::2, 2:], among[:, 2:] = 1, 1
        return of, among

    @functools.cached_property
    def outcomes(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each branch, the chances that came true in it and those that did not (branch by chance)."""
        if self.chances == 2:
            return np.array([[0, 0], [1, 1], [1, 0]], float), np.array([[1, 0], [0, 0], [0, 1]], float)
        yes, no = np.zeros((6, 4)), np.zeros((6, 4))
        yes[2:, 0], no[:2, 0] = 1, 1
        yes[2:4, 1], no[4:, 1] = 1, 1
        yes[1, 2], no[0, 2] = 1, 1
        yes[[3, 5], 3], no[[2, 4], 3] = 1, 1
        return yes, no

    @functools.cached_property
    def _ties(self) -> np.ndarray | None:
        """Coordinates by free coordinates, where two are the same."""
        return np.delete(np.eye(len(self.names)), 3, axis=1) + np.eye(len(self.names))[:, [3]] * np.eye(len(self.names) - 1)[2] if self.tied else None

    def free(self, gradient: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Derivatives by the coordinates that can move on their own."""
        t = self._ties
        return (gradient, second) if t is None else (gradient @ t, t.T @ second @ t)

    def whole(self, step: np.ndarray) -> np.ndarray:
        """A step of the free coordinates in all of them."""
        return step if self._ties is None else step @ self._ties.T

    def from_weights(self, w: np.ndarray, old: np.ndarray) -> np.ndarray:
        """Chances from the days attributed to each branch; where nothing is attributed the old value stays."""
        of, among = self.parts
        among = w @ among
        return np.divide(w @ of, among, out=old.copy(), where=among > 0)


# PIN: days without news, with bad news (more sells), with good news (more buys); rates mu, eps.b, eps.s.
PIN = Model(("a", "d", "u", "eb", "es"), 2, np.array([[0, 1, 0], [0, 1, 0], [1, 1, 0]], float), np.array([[0, 0, 1], [1, 0, 1], [0, 0, 1]], float))


def adjusted(tied: bool = False) -> Model:
    """AdjPIN: no news, bad news and good news, each without and with a shock to both sides; rates mu.b, mu.s, eps.b, eps.s, shock.b, shock.s."""
    buy, sell = np.zeros((6, 6)), np.zeros((6, 6))
    buy[:, 2], sell[:, 3] = 1, 1
    buy[1::2, 4], sell[1::2, 5] = 1, 1
    sell[2:4, 1], buy[4:, 0] = 1, 1
    return Model(("a", "d", "t1", "t2", "ub", "us", "eb", "es", "pb", "ps"), 4, buy, sell, tied)


def collapsed(buys: np.ndarray, sells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct days of each window as (windows, 3, days) of buys, sells and ones, and how often each occurs; padded with days that occur never."""
    n, length = buys.shape
    order = np.lexsort((sells, buys), axis=1) if n else np.zeros((0, length), int)
    b, s = np.take_along_axis(buys, order, 1), np.take_along_axis(sells, order, 1)
    new = np.ones((n, length), bool)
    new[:, 1:] = (b[:, 1:] != b[:, :-1]) | (s[:, 1:] != s[:, :-1])
    place = np.cumsum(new, axis=1) - 1
    most = int(place.max(initial=-1)) + 1
    row = np.arange(n)[:, None]
    times = np.bincount((row * most + place).ravel(), minlength=n * most).reshape(n, most).astype(float)
    days = np.zeros((n, 3, most))
    days[:, 2] = 1
    days[np.broadcast_to(row, place.shape)[new], 0, place[new]] = b[new]
    days[np.broadcast_to(row, place.shape)[new], 1, place[new]] = s[new]
    return days, times


def step(model: Model, p: np.ndarray, days: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next parameters of each row, and the log-likelihood (without factorials) of the given ones; days and times as from ``collapsed``."""
    rates, branches = p[:, model.chances :], len(model.buy)
    lam = rates @ model.both.T
    logs = np.log(lam)
    terms = np.empty((len(p), branches, 3))
    terms[:, :, 0], terms[:, :, 1] = logs[:, :branches], logs[:, branches:]
    terms[:, :, 2] = np.log(model.weights(p)) - lam[:, :branches] - lam[:, branches:]
    each = np.matmul(terms, days)
    top = each.max(1)
    each -= top[:, None, :]
    post = np.exp(each, out=each)
    total = post.sum(1)
    likelihood = ((top + np.log(total)) * times).sum(1)
    post *= (times / total)[:, None, :]
    sums = np.matmul(post, days.transpose(0, 2, 1))
    held = sums[:, :, 2]
    counts = ((sums[:, :, :2].transpose(0, 2, 1).reshape(len(p), -1) / lam) @ model.both) * rates
    owed = held @ model.shared
    new_rates = np.divide(counts, owed, out=rates.copy(), where=owed > 0)
    return model.clamp(np.concatenate([model.from_weights(held, p[:, : model.chances]), new_rates], axis=1)), likelihood


def maximise(
    model: Model,
    start: np.ndarray,
    buys: np.ndarray,
    sells: np.ndarray,
    cycles: int,
    tolerance: float,
    owner: np.ndarray | None = None,
    clock: Clock | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameters and log-likelihood that each row's start leads to, and what became of it (CONVERGED, LATE).

    owner: the window of each row, in ``buys`` and ``sells``; without it rows are windows. cycles: of expectation-maximisation, after
    which second-order steps finish what still climbs. clock: tells which windows run out of time; all others go on.
    """
    owner = np.arange(len(start)) if owner is None else owner
    days, times = collapsed(buys, sells)
    p = model.clamp(start.astype(float))
    best = np.full(len(p), -np.inf)
    fate = np.full(len(p), CONVERGED, np.int8)
    live = np.arange(len(p))
    d, t = days[owner], times[owner]
    for _ in range(cycles):
        if clock is not None and len(live):
            gone = clock.late(owner[live])
            fate[live[gone]] = LATE
            live, d, t = live[~gone], d[~gone], t[~gone]
        if not len(live):
            break
        p0 = p[live]
        p1, _ = step(model, p0, d, t)
        p2, l1 = step(model, p1, d, t)
        r, v = p1 - p0, p2 - p1 - (p1 - p0)
        length = np.sqrt((v * v).sum(1))
        reach = np.minimum(-np.sqrt((r * r).sum(1)) / np.where(length > 0, length, 1), -1)[:, None]
        far = model.clamp(p0 - 2 * reach * r + reach**2 * v)
        if model.tied:
            far[:, 3] = far[:, 2]
        p3, far_l = step(model, far, d, t)
        good = np.isfinite(far_l) & (far_l >= l1)
        p[live] = np.where(good[:, None], p3, p2)
        now = np.where(good, far_l, l1)
        done = now - best[live] <= tolerance * (1 + np.abs(now))
        best[live] = np.maximum(now, best[live])
        if done.any():
            live, d, t = live[~done], d[~done], t[~done]
    sound = live[np.isfinite(p[live]).all(1) & np.isfinite(best[live])]
    if len(sound):
        whose = owner[sound]
        ends, late = ascent.climb(model, p[sound], days[whose], times[whose], tolerance / 10, None if clock is None else lambda rows: clock.late(whose[rows]))
        p[sound] = ends
        fate[sound[late]] = LATE
    _, best = step(model, p, days[owner], times[owner])
    return p, best, fate


def pin_of(p: np.ndarray) -> np.ndarray:
    informed = p[:, 0] * p[:, 2]
    return informed / (informed + p[:, 3] + p[:, 4])


def apin_psos(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, d, t, u, ub, us, eb, es, pb, ps = p.T
    informed = a * ((1 - d) * ub + d * us)
    shocks = (pb + ps) * (a * u + (1 - a) * t)
    total = informed + shocks + eb + es
    return informed / total, shocks / total
