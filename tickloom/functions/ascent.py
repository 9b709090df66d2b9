"""Second-order ascent for likelihoods that are too flat for expectation-maximisation, for many windows and starts at once.

Coordinates are the logits of the chances and the logarithms of the rates, so no bound has to be kept in view. In each branch
the gradient of a day's log-likelihood is linear in its buys, sells and one; the gradient and the observed information of
a window therefore follow from each branch's second moments and the days' mean gradients, without a further derivative. Steps
use the absolute values of the information's eigenvalues, so that they climb also where the likelihood is not concave, and are damped
until they do. A row ends where a full step would gain less than the tolerance, or where no step of any length gains at all.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Rows whose information is held at once; longest step in a coordinate; damping beyond which no step can gain.
ROWS, LONGEST, STIFF = 2048, 3.0, 1e14


def curvature(model, p: np.ndarray, days: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood (without factorials) of each row, its gradient and its second derivatives in logits and logarithms."""
    k, branches = model.chances, len(model.buy)
    chances, rates = p[:, :k], p[:, k:]
    lam = rates @ model.both.T
    logs = np.log(lam)
    terms = np.empty((len(p), branches, 3))
    terms[:, :, 0], terms[:, :, 1] = logs[:, :branches], logs[:, branches:]
    terms[:, :, 2] = np.log(model.weights(p)) - lam[:, :branches] - lam[:, branches:]
    post = np.matmul(terms, days)
    top = post.max(1)
    post = np.exp(post - top[:, None, :])
    total = post.sum(1)
    height = ((top + np.log(total)) * times).sum(1)
    post /= total[:, None, :]

    # What a branch's gradient is made of: (rows, branches, coordinates, [buys, sells, one]).
    yes, no = model.outcomes
    buy, sell = model.buy * rates[:, None, :], model.sell * rates[:, None, :]
    share_b, share_s = buy / lam[:, :branches, None], sell / lam[:, branches:, None]
    by = np.zeros((len(p), branches, p.shape[1], 3))
    by[:, :, :k, 2] = yes * (1 - chances)[:, None, :] - no * chances[:, None, :]
    by[:, :, k:, 0], by[:, :, k:, 1], by[:, :, k:, 2] = share_b, share_s, -(buy + sell)

    parts = post[:, :, None, :] * days[:, None, :, :]
    weighted = parts * times[:, None, None, :]
    sums = weighted.sum(3)
    moments = np.matmul(weighted, days.transpose(0, 2, 1)[:, None])
    gradient = (by @ sums[..., None]).sum((1, 3))
    second = (by @ moments @ by.transpose(0, 1, 3, 2)).sum(1)
    mean = np.matmul(by.transpose(0, 2, 1, 3).reshape(len(p), p.shape[1], -1), parts.reshape(len(p), branches * 3, -1))
    second -= np.matmul(mean * times[:, None, :], mean.transpose(0, 2, 1))
    second[:, k:, k:] -= np.matmul((share_b * sums[:, :, :1]).transpose(0, 2, 1), share_b) + np.matmul((share_s * sums[:, :, 1:2]).transpose(0, 2, 1), share_s)
    diagonal = np.concatenate([-(sums[:, :, 2] @ (yes + no)) * chances * (1 - chances), gradient[:, k:]], axis=1)
    at = np.arange(p.shape[1])
    second[:, at, at] += diagonal
    return height, gradient, second


def moved(model, p: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Parameters after a step in logits and logarithms."""
    k = model.chances
    odds = p[:, :k] / (1 - p[:, :k]) * np.exp(step[:, :k])
    return model.clamp(np.concatenate([odds / (1 + odds), p[:, k:] * np.exp(step[:, k:])], axis=1))


def climb(model, p: np.ndarray, days: np.ndarray, times: np.ndarray, tolerance: float, late: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's ascent ends, and whether it ran out of time first; days and times as from ``kernels.collapsed``, a row each.

    late: told the rows that are still on their way, says which of them have no time left.
    """
    p, out_of_time = p.copy(), np.zeros(len(p), bool)
    for first in range(0, len(p), ROWS):
        live = np.arange(first, min(len(p), first + ROWS))
        height, gradient, second = curvature(model, p[live], days[live], times[live])
        damping = np.full(len(live), 1e-2)
        while len(live):
            if late is not None:
                gone = late(live)
                out_of_time[live[gone]] = True
                live, height, gradient, second, damping = (x[~gone] for x in (live, height, gradient, second, damping))
                if not len(live):
                    break
            slope, bend = model.free(gradient, second)
            values, axes = np.linalg.eigh(-bend)
            values = np.maximum(np.abs(values), 1e-12 * (1 + np.abs(values).max(1, keepdims=True)))
            along = np.matmul(axes.transpose(0, 2, 1), slope[..., None])[..., 0]
            gain = 0.5 * (along**2 / values).sum(1)
            step = np.matmul(axes, (along / (values + damping[:, None]))[..., None])[..., 0]
            step *= np.minimum(1, LONGEST / np.maximum(np.abs(step).max(1), 1e-300))[:, None]
            promised = (slope * step).sum(1)
            far = moved(model, p[live], model.whole(step))
            there, far_gradient, far_second = curvature(model, far, days[live], times[live])
            better = np.isfinite(there) & (there > height + 1e-3 * promised) & np.isfinite(far_second).all((1, 2))
            p[live[better]] = far[better]
            height, gradient, second = np.where(better, there, height), np.where(better[:, None], far_gradient, gradient), np.where(better[:, None, None], far_second, second)
            damping = np.where(better, np.maximum(damping * 0.1, 1e-10), damping * 10)
            keep = ~((gain <= tolerance * (1 + np.abs(height))) | (damping > STIFF) | ~np.isfinite(gain))
            live, height, gradient, second, damping = (x[keep] for x in (live, height, gradient, second, damping))
    return p, out_of_time
