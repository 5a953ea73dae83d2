"""Causal rate emissions of one record: trailing tails of declustered crossings, and draws of their rate."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from tidewatch.functions.signal import decorrelation_time
from tidewatch.functions.special import gamma_quantile


@dataclass(frozen=True)
class Config:
    """cadence: seconds between emissions. gated: emit only once enough is known (else from the start, by the prior). quantile: of
    severities, the tail's threshold, unless `threshold` and `exceedance` (its probability) fix it. window: seconds of history, all if None.
    least: exceedances that a gated tail needs. shape, rate: the Gamma prior of the tail's rate. refresh: seconds that draws and
    intervals are held. gap: seconds that chain crossings, the history's decorrelation time if None."""

    cadence: float
    shape: float
    rate: float
    gated: bool = True
    quantile: float = 0.75
    window: float | None = None
    least: int = 5
    refresh: float = 60.0
    draws: int = 512
    seed: int = 0
    gap: float | None = None
    threshold: float | None = None
    exceedance: float | None = None

    @property
    def least_crossings(self) -> int:
        """Raw crossings without which a quantile can't leave `least` above it."""
        return int(np.ceil(self.least / (1 - self.quantile)))


@dataclass(frozen=True)
class Tail:
    """An exponential tail above a threshold, with its Gamma posterior and the probability that a crossing passes 1."""

    n: int
    over: int
    threshold: float
    clipped: bool
    shape: float
    rate: float
    exceedance: float
    predictive: float

    @property
    def critical(self) -> float:
        return self.exceedance * self.predictive


def leaders(t: np.ndarray, severity: np.ndarray, gap: float) -> np.ndarray:
    """Places of the first largest severity of each chain of crossings no more than gap apart."""
    if not len(t):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, np.diff(t) > gap))
    chain = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(t))))
    best = np.flatnonzero(severity == np.maximum.reduceat(severity, first)[chain])
    return best[np.unique(chain[best], return_index=True)[1]]


def fit_tail(severity: np.ndarray, config: Config) -> Tail | None:
    """None without crossings, unless the threshold is fixed, or with too few exceedances where they are asked for."""
    n, fixed = len(severity), config.threshold is not None
    if not n and (config.gated or not fixed):
        return None
    level = config.threshold if fixed else float(np.quantile(severity, config.quantile))
    clipped = not fixed and level >= 1
    level = float(np.nextafter(1.0, 0.0)) if clipped else level
    beyond = severity[severity > level] - level
    if config.gated and len(beyond) < config.least:
        return None
    shape, rate = config.shape + len(beyond), config.rate + float(beyond.sum())
    return Tail(n, len(beyond), level, clipped, shape, rate, config.exceedance if fixed else len(beyond) / n, (rate / (rate + 1 - level)) ** shape)


def draw_rates(tail: Tail, exposure: float, config: Config, key: list[int]) -> np.ndarray:
    """Draws of the rate per hour of critical crossings: Poisson counts, thinned to exceedances where these were counted,
    each critical with the chance that a drawn tail rate gives."""
    rng = np.random.default_rng(key)
    chance = np.exp(-rng.gamma(tail.shape, 1 / tail.rate, config.draws) * (1 - tail.threshold))
    counts = rng.poisson(tail.n, config.draws)
    beyond = rng.binomial(counts, tail.over / tail.n) if config.gated else counts * tail.exceedance
    return beyond * chance * (3600 / exposure)


@lru_cache(maxsize=1 << 16)
def garwood(n: int) -> tuple[float, float]:
    """The exact 95% interval of a Poisson mean at a count. Few counts occur, in many emissions."""
    return (0.0 if n == 0 else float(gamma_quantile(0.025, np.array([float(n)]))[0])), float(gamma_quantile(0.975, np.array([n + 1.0]))[0])


def emit(series: int, t: np.ndarray, x: np.ndarray, crossings: tuple[np.ndarray, np.ndarray, np.ndarray], config: Config) -> list[dict]:
    """The emissions of one record (its finite part): see emission_paths() for what each holds."""
    if len(t) < 3:
        return []
    at, severity, side = crossings
    dt = float(np.median(np.diff(t)))
    begin, end = float(t[0]), float(t[-1])
    times = np.arange(begin + (config.cadence if config.gated else 0.0), end + config.cadence / 2, config.cadence)
    out, held = [], None

    def within(start: float, stop: float):
        """Crossings of [start, stop] that lead their chains, and the gap that chains them."""
        a, b = np.searchsorted(at, start, "left"), np.searchsorted(at, stop, "right")
        gap = config.gap
        if gap is None:
            past = x[np.searchsorted(t, start, "left") : np.searchsorted(t, stop, "right")]
            gap = decorrelation_time(past, dt) if len(past) >= 3 else dt
        return a + leaders(at[a:b], severity[a:b], gap), gap

    for now in times.tolist():
        observed = int(np.searchsorted(at, now, "right"))
        if config.gated and (np.searchsorted(t, now, "right") < 3 or observed < config.least_crossings):
            continue
        trailing = config.window is not None and now - config.window > begin + 1e-6  # times are of the microsecond
        starts = [now - config.window, begin] if trailing else [begin]
        if len(starts) > 1 and observed - np.searchsorted(at, starts[0], "left") < config.least_crossings:
            starts = starts[1:]
        for start in starts:
            kept, gap = within(start, now)
            tail = fit_tail(severity[kept], config)
            if tail is not None:
                break
        if tail is None:
            continue
        exposure = max(now - start, dt)
        flags = ["full_history"] * (trailing and start == begin) + ["prior_dominated"] * (tail.over < 3) + ["threshold_clipped"] * tail.clipped
        if held is None or now - held[0] >= config.refresh - 1e-9:
            # those without a gate take no bound from their draws, and draw none if none are asked for
            drawn = draw_rates(tail, exposure, config, [config.seed, zlib.crc32(f"{series}|{now:.6f}".encode())]) if config.draws else np.zeros(0)
            if config.gated:
                lo, hi = np.quantile(drawn, [0.025, 0.975])
            else:
                scale = tail.critical * 3600 / exposure
                lo, hi = (v * scale for v in garwood(tail.n))
            held = now, float(lo), float(hi), drawn.tolist()
        up = int((side[kept] > 0).sum())
        out.append({"t": now, "rate": tail.n / exposure * tail.critical * 3600, "lo": held[1], "hi": held[2], "exposure": exposure, "gap": float(gap), "n": tail.n, "exceedances": tail.over, "positive": up, "negative": tail.n - up, "threshold": tail.threshold, "p_critical": tail.critical, "flags": flags, "drawn_at": held[0], "draws": held[3]})
    return out
