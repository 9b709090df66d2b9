"""Parameters of the estimators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Windows:
    """Rolling windows of trading days, and how many of them must have trades."""

    length: int = 60
    min_valid: int = 30


@dataclass(frozen=True)
class PinConfig:
    """starts: EA, YZ or GWJ. slab: window ends that one task estimates together. cycles: of expectation-maximisation, after which second-order steps finish what still climbs."""

    windows: Windows = Windows()
    starts: str = "EA"
    extra_clusters: int = 4
    slab: int = 512
    cycles: int = 100
    tolerance: float = 1e-9


@dataclass(frozen=True)
class ApinConfig:
    """One AdjPIN estimator; the presets below are its published variants.

    emit_skips: whether windows without an estimate give a row with the reason.
    tie_theta: shocks are equally likely on days with and without information.
    warm_extra: generated starts of either kind added to a warm start. fresh_starts: those of either kind where there is none.
    timeout_seconds: what one window may take, all its starts together.
    cycles: of expectation-maximisation, after which second-order steps finish what still climbs.
    slab: window ends whose generated starts one task follows together.
    """

    windows: Windows = Windows()
    emit_skips: bool = True
    tie_theta: bool = False
    warm_extra: int = 0
    fresh_starts: int = 20
    timeout_seconds: float = 120.0
    cycles: int = 100
    tolerance: float = 1e-8
    slab: int = 512


APIN_BASE = ApinConfig(emit_skips=False)
APIN_SKIP = ApinConfig()
APIN_THETA = ApinConfig(tie_theta=True)
APIN_WARM = ApinConfig(warm_extra=5)


@dataclass(frozen=True)
class VpinConfig:
    """min_ticks: ticks, two a bar, that an estimate needs. buckets: volume buckets of an average day. sample: buckets in one VPIN. trading_hours is accepted for other calculators and does not affect volume buckets."""

    bar: str = "1 minute"
    buckets: int = 50
    sample: int = 50
    min_bars: int = 500
    min_ticks: int = 200
    trading_hours: float = 7.0
