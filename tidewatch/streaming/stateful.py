"""Streaming forms of the sequence operators, with a small state for each series.

Rows of a series must reach the stream in order of time across micro-batches; within one they are sorted. Each form
gives the rows of its batch operator on a finite stream, but for what is still open at its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _run(stream: DataFrame, step, output: str, state: str, start: tuple, order: str = "t") -> DataFrame:
    """applyInPandasWithState by series: step(state, rows) returns the new state and rows of output."""
    names = [c.split()[0] for c in output.split(", ")]

    def call(key: tuple, frames: Iterator[pd.DataFrame], held: Any) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        after, out = step(key[0], tuple(held.get) if held.exists else start, rows)
        held.update(after)
        yield pd.DataFrame(out, columns=names)

    return stream.groupBy("series_id").applyInPandasWithState(call, output, state, "append", "NoTimeout")


def stream_normalize(stream: DataFrame, floor: float = 1e-12) -> DataFrame:
    """Causal normaliser with a line: series_id, i, z of stream(series_id, t, x); the state is five running sums."""

    def step(key, s, rows):
        n, offset, s1, s2, si = s
        out = []
        for x in rows.x.to_numpy():
            offset = x if n == 0 else offset
            c = x - offset
            z = 0.0
            if n >= 2:
                mean, middle = s1 / n, (n - 1) / 2
                slope = (si - middle * s1) / max(n * (n * n - 1) / 12, floor)
                spread = max(max((s2 - s1 * mean) / max(n - 1, 1), 0.0) ** 0.5, floor)
                z = (c - mean - slope * (n - middle)) / spread
            out.append((key, int(n), float(z)))
            s1, s2, si, n = s1 + c, s2 + c * c, si + n * c, n + 1
        return (n, float(offset), float(s1), float(s2), float(si)), out

    return _run(stream, step, "series_id long, i long, z double", "n long, o double, s1 double, s2 double, si double", (0, 0.0, 0.0, 0.0, 0.0))


def stream_crossings(stream: DataFrame, high: float, low: float, critical: float, gap: float) -> DataFrame:
    """Declustered crossings of stream(series_id, t, x, dx): series_id, t, side, severity of the largest of each chain,
    emitted by the first crossing that comes more than gap after it. Without a column dx it is the difference quotient
    to the row before, 0 for a series' first row and between equal times."""
    given = "dx" in stream.columns

    def step(key, s, rows):
        seen, pt, px, pdx, open_, last, best_t, best_side, best = s
        out = []
        for t, x, dx in zip(rows.t.to_numpy(), rows.x.to_numpy(), rows.dx.to_numpy() if given else [0.0] * len(rows), strict=True):
            side = 0
            if not given and seen and t > pt:
                dx = (x - px) / (t - pt)
            if seen:
                side = 1 if px < high <= x else -1 if px > low >= x else 0
            if side:
                f = ((high if side == 1 else low) - px) / (x - px)
                at, severity = pt + f * (t - pt), side * (pdx + f * (dx - pdx)) / critical
                if open_ and at - last > gap:
                    out.append((key, best_t, best_side, best))
                    open_ = False
                if not open_ or severity > best:
                    best_t, best_side, best = float(at), side, float(severity)
                open_, last = True, float(at)
            seen, pt, px, pdx = True, float(t), float(x), float(dx)
        return (seen, pt, px, pdx, open_, last, best_t, best_side, best), out

    return _run(stream, step, "series_id long, t double, side int, severity double", "seen boolean, pt double, px double, pdx double, open boolean, last double, best_t double, best_side int, best double", (False, 0.0, 0.0, 0.0, False, 0.0, 0.0, 0, 0.0))


def stream_episodes(stream: DataFrame, threshold: float, debounce: int, refractory: int) -> DataFrame:
    """Alarm episodes of stream(series_id, t, score), emitted when they close: series_id, t_start, t_end, max_score."""

    def step(key, s, rows):
        run, quiet, live, start, last, top, peak = s
        out = []
        for t, v in zip(rows.t.to_numpy(), rows.score.to_numpy(), strict=True):
            if v >= threshold:
                run, quiet, peak = run + 1, 0, max(peak, float(v))
                if not live and run >= debounce:
                    live, start = True, float(t)
                if live:
                    last, top = float(t), peak
            else:
                run, quiet = 0, quiet + 1
                if quiet >= refractory:
                    if live:
                        out.append((key, start, last, top))
                    live, peak = False, float("-inf")
                elif not live:
                    peak = float("-inf")
        return (run, quiet, live, start, last, top, peak), out

    return _run(stream, step, "series_id long, t_start double, t_end double, max_score double", "run int, quiet int, live boolean, start double, last double, top double, peak double", (0, 0, False, 0.0, 0.0, 0.0, float("-inf")))


def stream_aci(stream: DataFrame, scores: list[float], alpha: float, gamma: float, delay: int = 0) -> DataFrame:
    """Adaptive conformal level of stream(series_id, t, bound, target): series_id, t, level, upper, miss. scores are the
    calibration scores; the state is the level and the last `delay` misses."""
    import math

    own = sorted(scores)

    def step(key, s, rows):
        level, misses = s[0], list(s[1])
        out = []
        for t, bound, target in zip(rows.t.to_numpy(), rows.bound.to_numpy(), rows.target.to_numpy(), strict=True):
            if delay and len(misses) >= delay:
                level += gamma * (alpha - misses.pop(0))
            rank = math.ceil(round((len(own) + 1) * (1 - level), 9))
            q = math.inf if level <= 0 or rank > len(own) else -math.inf if level >= 1 else own[rank - 1]
            miss = int(target > bound + q)
            out.append((key, float(t), float(level), float(bound + q), miss))
            if delay:
                misses.append(miss)
            else:
                level += gamma * (alpha - miss)
        return (float(level), misses), out

    return _run(stream, step, "series_id long, t double, level double, upper double, miss int", "level double, misses array<int>", (float(alpha), []))


def stream_coverage(stream: DataFrame, ts: str, span: str, slide: str, late: str) -> DataFrame:
    """window_start, n and the share of rows without a miss over sliding windows of event time; rows later than `late`
    after the newest are dropped."""
    grouped = stream.withWatermark(ts, late).groupBy(F.window(ts, span, slide).alias("w"))
    return grouped.agg(F.count("*").alias("n"), (1 - F.avg("miss")).alias("coverage")).select(F.col("w.start").alias("window_start"), "n", "coverage")
