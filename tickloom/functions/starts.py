"""Starting points of the estimators, from the days of one window."""

from __future__ import annotations

import itertools

import numpy as np

from tickloom.functions.kernels import RATE_FLOOR, Model


def clusters(values: np.ndarray, count: int) -> np.ndarray:
    """Complete-linkage clusters of numbers: 0 for the smallest values, up to count-1.

    On a line only neighbours can be merged next, those whose union is narrowest.
    """
    order = np.argsort(values, kind="stable")
    low, high = list(values[order]), list(values[order])
    sizes = [1] * len(order)
    while len(low) > count:
        width = np.array(high[1:]) - np.array(low[:-1])
        k = int(width.argmin())
        high[k], sizes[k] = high[k + 1], sizes[k] + sizes[k + 1]
        del low[k + 1], high[k + 1], sizes[k + 1]
    out = np.empty(len(order), int)
    out[order] = np.repeat(np.arange(len(sizes)), sizes)
    return out


def _mean(values: np.ndarray, where: np.ndarray, otherwise: float) -> float:
    return float(values[where].mean()) if where.any() else otherwise


def _pin(buys: np.ndarray, sells: np.ndarray, bad: np.ndarray, good: np.ndarray) -> list[float]:
    event = bad | good
    quiet_b, quiet_s = _mean(buys, ~good, buys.mean()), _mean(sells, ~bad, sells.mean())
    pulls = np.concatenate([buys[good] - quiet_b, sells[bad] - quiet_s])
    a = np.clip(event.mean(), 0.02, 0.98)
    d = np.clip(bad.sum() / max(event.sum(), 1), 0.02, 0.98)
    return [a, d, max(pulls.mean() if len(pulls) else 0.0, 1e-2), max(quiet_b, 1e-2), max(quiet_s, 1e-2)]


def pin_ea(buys: np.ndarray, sells: np.ndarray, extra: int = 4) -> np.ndarray:
    """One start for each cut of the clusters of |B-S| into days without and with news."""
    gap = buys - sells
    label = clusters(np.abs(gap), min(2 + extra, len(np.unique(np.abs(gap)))))
    return np.array([_pin(buys, sells, (label >= cut) & (gap < 0), (label >= cut) & (gap >= 0)) for cut in range(1, label.max() + 1)] or [_pin(buys, sells, gap < 0, gap > 0)])


def pin_gwj(buys: np.ndarray, sells: np.ndarray) -> np.ndarray:
    """Three clusters of B-S: bad news, none, good news."""
    label = clusters(buys - sells, 3)
    return np.array([_pin(buys, sells, label == 0, label == 2)])


def pin_yz(buys: np.ndarray, sells: np.ndarray, levels: tuple[float, ...] = (0.1, 0.3, 0.5, 0.7, 0.9)) -> np.ndarray:
    """A grid of chances and of the uninformed share of buys; points with a negative sell rate are left out."""
    b, s = buys.mean(), sells.mean()
    a, d, g = (x.ravel() for x in np.meshgrid(levels, levels, levels, indexing="ij"))
    mu = (b - g * b) / (a * (1 - d))
    es = s - a * d * mu
    return np.column_stack([a, d, mu, g * b, es])[es >= 0]


def pin_starts(kind: str, buys: np.ndarray, sells: np.ndarray, extra: int) -> np.ndarray:
    makers = {"EA": lambda: pin_ea(buys, sells, extra), "GWJ": lambda: pin_gwj(buys, sells), "YZ": lambda: pin_yz(buys, sells)}
    found = makers[kind]()
    return found if len(found) else pin_gwj(buys, sells)


def plane_clusters(buys: np.ndarray, sells: np.ndarray, count: int) -> np.ndarray:
    """Complete-linkage clusters of days in the plane of buys and sells, numbered by their mean imbalance, then by their mean total.

    The pair whose union has the smallest diameter is merged next; of several such, the one that comes first.
    """
    points, which, times = np.unique(np.column_stack([buys, sells]), axis=0, return_inverse=True, return_counts=True)
    n = len(points)
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    far[np.tril_indices(n)] = np.inf
    label = np.arange(n)
    for _ in range(n - count):
        i, j = divmod(int(far.argmin()), n)
        row = np.maximum(np.minimum(far[i], far[:, i]), np.minimum(far[j], far[:, j]))  # each distance is held above the diagonal only
        far[i, i + 1 :], far[:i, i] = row[i + 1 :], row[:i]
        far[j], far[:, j] = np.inf, np.inf
        label[label == j] = i
    names, place = np.unique(label, return_inverse=True)
    weight = np.bincount(place, times)
    b, s = (np.bincount(place, times * points[:, k]) / weight for k in (0, 1))
    rank = np.empty(len(names), int)
    rank[np.lexsort((b, b + s, b - s))] = np.arange(len(names))
    return rank[place][which.ravel()]


# The six types of days, in the order of the branches of the model: no news, bad news, good news, each calm and then shocked.
TYPES = 6


def assignments(totals: np.ndarray) -> np.ndarray:
    """Every way to give clusters, in the order of their imbalance, to the six types of days: (ways, clusters).

    Clusters from the lowest imbalances on are bad news, then none, then good news; of each of the three, those with the smaller
    totals are calm and the others shocked. All six have a cluster where there are six clusters or more, which is one way for each
    composition of their number into six parts; with fewer clusters types may be empty.
    """
    m = len(totals)
    least = 1 if m >= TYPES else 0
    order = {(i, j): np.arange(i, j)[np.argsort(totals[i:j], kind="stable")] for i in range(m + 1) for j in range(i, m + 1)}
    out = []
    for i in range(2 * least, m + 1):
        for j in range(i + 2 * least, m + 1 - 2 * least):
            for runs in itertools.product(*(range(least, size + 1 - least) for size in (i, j - i, m - j))):
                way = np.empty(m, int)
                for (low, high), calm, kind in zip(((0, i), (i, j), (j, m)), runs, (2, 0, 4)):
                    way[order[low, high][:calm]], way[order[low, high][calm:]] = kind, kind + 1
                out.append(way)
    return np.unique(np.array(out), axis=0)


def _ratio(top: np.ndarray, bottom: np.ndarray, otherwise: np.ndarray | float) -> np.ndarray:
    return np.where(bottom > 0, top / np.where(bottom > 0, bottom, 1), otherwise)


def parameters(days: np.ndarray, buys: np.ndarray, sells: np.ndarray) -> np.ndarray:
    """AdjPIN parameters of each way, from the days, buys and sells of the six types, (ways, 6) each."""
    n, b, s = days.sum(1), buys.sum(1), sells.sum(1)
    overall_b, overall_s = b / n, s / n
    event, shocked = days[:, 2:].sum(1), days[:, 1::2].sum(1)
    none, bad, good = (slice(k, k + 2) for k in (0, 2, 4))
    share = shocked / n
    eb = np.maximum(_ratio(buys[:, [0, 2]].sum(1), days[:, [0, 2]].sum(1), overall_b), 1e-2)
    es = np.maximum(_ratio(sells[:, [0, 4]].sum(1), days[:, [0, 4]].sum(1), overall_s), 1e-2)
    chances = [event / n, _ratio(days[:, bad].sum(1), event, 0.5), _ratio(days[:, 1], days[:, none].sum(1), share), _ratio(days[:, 3] + days[:, 5], days[:, bad].sum(1) + days[:, good].sum(1), share)]
    rates = [
        _ratio(buys[:, 4], days[:, 4], overall_b) - eb,
        _ratio(sells[:, 2], days[:, 2], overall_s) - es,
        eb,
        es,
        _ratio(buys[:, [1, 3]].sum(1), days[:, [1, 3]].sum(1), overall_b) - eb,
        _ratio(sells[:, [1, 5]].sum(1), days[:, [1, 5]].sum(1), overall_s) - es,
    ]
    return np.column_stack([*(np.clip(c, 0.02, 0.98) for c in chances), *(np.maximum(r, 1e-2) for r in rates)])


def apin_sets(buys: np.ndarray, sells: np.ndarray, extra: int = 4) -> np.ndarray:
    """The parameter sets of all assignments of 6 + ``extra`` clusters of the days to the six types, duplicates removed: C(5 + extra, 5) at most."""
    label = plane_clusters(buys, sells, TYPES + extra)
    days = np.bincount(label).astype(float)
    b, s = np.bincount(label, buys), np.bincount(label, sells)
    ways = assignments((b + s) / days)
    held = (ways[:, None, :] == np.arange(TYPES)[None, :, None]).astype(float)
    return np.unique(parameters(held @ days, held @ b, held @ s), axis=0)


def apin_starts(model: Model, buys: np.ndarray, sells: np.ndarray, count: int, extra: int = 4) -> np.ndarray:
    """The first ``count`` of ``apin_sets``, in an order whose every head is spread over all of them, and as many ``line_sets``; tied shocks have the chance of quiet days."""
    sets = apin_sets(buys, sells, extra)
    spread = np.argsort(np.arange(len(sets)) * ((5**0.5 - 1) / 2) % 1, kind="stable")
    found = np.concatenate([sets[spread[: max(count, 1)]], line_sets(buys, sells, count, extra)])
    if model.tied:
        found[:, 3] = found[:, 2]
    return found


def _apin(buys: np.ndarray, sells: np.ndarray, bad: np.ndarray, good: np.ndarray, shocked: np.ndarray) -> list[float]:
    event, calm = bad | good, ~shocked
    eb = max(_mean(buys, calm & ~good, buys.mean()), 1e-2)
    es = max(_mean(sells, calm & ~bad, sells.mean()), 1e-2)
    return [
        np.clip(event.mean(), 0.02, 0.98),
        np.clip(bad.sum() / max(event.sum(), 1), 0.02, 0.98),
        np.clip(_mean(shocked.astype(float), ~event, shocked.mean()), 0.02, 0.98),
        np.clip(_mean(shocked.astype(float), event, shocked.mean()), 0.02, 0.98),
        max(_mean(buys, good & calm, buys.mean()) - eb, 1e-2),
        max(_mean(sells, bad & calm, sells.mean()) - es, 1e-2),
        eb,
        es,
        max(_mean(buys, shocked & ~good, buys.mean()) - eb, 1e-2),
        max(_mean(sells, shocked & ~bad, sells.mean()) - es, 1e-2),
    ]


def _upper(values: np.ndarray, parts: int, top: int) -> np.ndarray:
    """Whether each value is in the ``top`` uppermost of ``parts`` clusters; no value is where all are equal."""
    label = clusters(values, min(parts, len(np.unique(values))))
    return label > max(label.max() - top, 0) if label.max() else np.zeros(len(values), bool)


def line_sets(buys: np.ndarray, sells: np.ndarray, count: int, extra: int = 4) -> np.ndarray:
    """At most ``count`` parameter sets from clusters of the days' imbalances.

    The days fall into 3 + ``extra`` complete-linkage clusters by imbalance. Each pair of cuts between them tells bad news, none
    and good news apart; of each of the three, the days in the upper of two clusters by their totals are shocked. Balanced cuts come
    first. Where there are fewer than ``count``, the cuts follow once more with the upper one of three clusters as shocked.
    """
    gap, total = buys - sells, buys + sells
    label = clusters(gap, min(3 + extra, len(np.unique(gap))))
    most = int(label.max())
    cuts = [(i, j) for i in range(0, most + 1) for j in range(i + 1, most + 2) if (i, j) != (0, most + 1) or not most]
    middle = (most + 1) / 2
    cuts.sort(key=lambda c: (abs(c[0] + c[1] - 2 * middle), abs(c[1] - c[0] - (most + 1) / 3), c))
    out = []
    for parts, top in ((2, 1), (3, 1)):
        for i, j in cuts:
            if len(out) == max(count, 1):
                break
            bad, good = label < i, label >= j
            shocked = np.zeros(len(buys), bool)
            for layer in (bad, good, ~(bad | good)):
                if layer.any():
                    shocked[layer] = _upper(total[layer], parts, top)
            out.append(_apin(buys, sells, bad, good, shocked))
    return np.maximum(np.array(out), RATE_FLOOR)
