"""Streams by event time: rows wait in state until the watermark has passed them, so that order across micro-batches
doesn't matter, and what is open is closed by a timer of event time. Rows later than the watermark are Spark's to drop."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: The state store that list state and timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of series that share a key.
GROUPS = 8192


class InOrder(StatefulProcessor):
    """Takes a key's rows in order of time, each once the watermark has reached it.

    step(state, row) and close(state) give the new state and the rows that leave; a row is (microseconds, values...), a
    state a tuple. close() is called when `idle` microseconds have passed by the watermark since the last row, and the state is
    then forgotten. Waiting rows are a list state of what came together, so they may be many; the timer stands at the first of them, or at the
    end of the idle time. A call to the state costs more than the rows of a short series, so the state, the last time and the timer are one
    value, and a key without rows to give gives no frame.
    """

    def __init__(self, step: Callable, close: Callable, start: tuple, state: str, names: list[str], idle: int):
        self.step, self.finish, self.start, self.names, self.idle = step, close, start, names, idle
        # parsed here, where there is a session
        self.rows, self.state = (StructType.fromDDL(x) for x in ("rows binary", state + ", last long, due long"))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.rows)
        self.held = handle.getValueState("held", self.state)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            if len(frame):
                new = list(zip(*(frame[c].tolist() for c in frame.columns)))
                self.waiting.appendList([(pickle.dumps(new),)])
                low = min(r[0] for r in new)
                first = low if first is None else min(first, low)
        if first is not None:
            at = -(-first // 1000)
            held = self.held.get() or (*self.start, None, None)
            if held[-1] is None or held[-1] > at:  # one timer, at the earliest time that is asked for
                if held[-1] is not None:
                    self.handle.deleteTimer(held[-1])
                self.handle.registerTimer(at)
                self.held.update((*held[:-1], at))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(r for part in self.waiting.get() for r in pickle.loads(part[0]))
        ready, later = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        held = tuple(self.held.get() or (*self.start, None, None))
        state, last, out, end = self.advance(held[:-2], held[-2], ready, later[0][0] if later else None, now)
        if later and ready:
            self.waiting.put([(pickle.dumps(later),)])
        elif rows and not later:
            self.waiting.clear()
        if end is not None:
            at = -(-end // 1000)
            self.handle.registerTimer(at)
            self.held.update((*state, last, at))
        else:
            self.held.clear()
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=self.names)

    def advance(self, state: tuple, last: int | None, ready: list, later: int | None, now: int) -> tuple[tuple, int | None, list, int | None]:
        """State, time of the last row (None if nothing is held), rows that leave, and the time to look again, once the rows `ready` are
        taken; `later` is the time of the first that still waits."""
        out = []
        for row in ready:
            if last is not None and row[0] - last > self.idle:
                _, left = self.finish(state)
                out += left
                state = self.start
            state, left = self.step(state, row)
            out += left
            last = row[0]
        if last is not None and now - last > self.idle and not (later is not None and later - last <= self.idle):
            out += self.finish(state)[1]
            state, last = self.start, None
        ends = [] if later is None else [later]
        if last is not None:
            ends.append(last + self.idle + 1000)
        return state, last, out, min(ends, default=None)

    def close(self) -> None:
        pass


class Together(InOrder):
    """InOrder for keys that are groups of series, so that calls to the state go by the groups and not by the series.

    Rows have the columns `columns`: absent (no series_id), series_id, at, values. Those of a group that came together wait as one value, a
    column each; the states of its series are another, with the group's timer, which stands at the first time that any of them asks for.
    """

    def __init__(self, step: Callable, close: Callable, start: tuple, columns: list[str], names: list[str], idle: int):
        super().__init__(step, close, start, "series binary", names, idle)
        self.columns = columns
        self.state = StructType.fromDDL("series binary, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [frame[self.columns] for frame in rows if len(frame)]
        if frames:
            new = [np.concatenate([f[c].to_numpy() for f in frames]) for c in self.columns]
            self.waiting.appendList([(pickle.dumps(new),)])
            at = -(-int(new[2].min()) // 1000)
            series, due = self.held.get() or (pickle.dumps({}), None)
            if due is None or due > at:
                if due is not None:
                    self.handle.deleteTimer(due)
                self.handle.registerTimer(at)
                self.held.update((bytes(series), at))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        parts = [pickle.loads(part[0]) for part in self.waiting.get()]
        blob, _ = self.held.get() or (pickle.dumps({}), None)
        held, out, kept = pickle.loads(blob), [], []
        seen = set()

        def look(one: tuple, ready: list, later: int | None) -> None:
            state, last, _ = held.get(one, (self.start, None, None))
            state, last, left, end = self.advance(state, last, ready, later, now)
            out.extend((None if one[0] else one[1], *r) for r in left)
            if end is None:
                held.pop(one, None)
            else:
                held[one] = (state, last, end)

        if parts:
            rows = [np.concatenate(c) for c in zip(*parts)]
            order = np.lexsort(rows[::-1])
            rows = [c[order] for c in rows]
            absent, series, at = rows[:3]
            first = np.flatnonzero(np.append(True, (series[1:] != series[:-1]) | (absent[1:] != absent[:-1]))).tolist()
            for a, b in zip(first, [*first[1:], len(at)]):
                one = (bool(absent[a]), int(series[a]))
                seen.add(one)
                cut = a + int(np.searchsorted(at[a:b], now, "right"))
                look(one, list(zip(*(c[a:cut].tolist() for c in rows[2:]))), int(at[cut]) if cut < b else None)
            kept = [c[at > now] for c in rows]
            if not len(kept[2]):
                self.waiting.clear()
            elif len(kept[2]) < len(at):
                self.waiting.put([(pickle.dumps(kept),)])
        for one in [k for k, (_, _, end) in held.items() if end <= now and k not in seen]:
            look(one, [], None)
        if held:
            due = -(-min(end for _, _, end in held.values()) // 1000)
            self.handle.registerTimer(due)
            self.held.update((pickle.dumps(held), due))
        else:
            self.held.clear()
        if out:
            ids, *values = zip(*out)
            yield pd.DataFrame({self.names[0]: pd.array(ids, dtype="Int64"), **dict(zip(self.names[1:], values))})


def _timed(stream: DataFrame, columns: list[str], processor: tuple, output: str, late: str, idle: float, groups: int | None) -> DataFrame:
    step, close, start, state = processor
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    names = [c.split()[0] for c in output.split(", ")]
    rows = stream.withWatermark("ts", late).selectExpr("series_id", "ts", "unix_micros(ts) as at", *columns)
    if groups is not None:
        one = ["series_id IS NULL AS absent", "coalesce(series_id, 0L) AS series_id"]
        given = rows.selectExpr(f"pmod(xxhash64(series_id), {groups}L) AS series", *one, "ts", "at", *columns).groupBy("series")
        together = Together(step, close, start, ["absent", "series_id", "at", *columns], names, round(idle * 1e6))
        return given.transformWithStateInPandas(together, StructType.fromDDL(output), "append", "eventTime")
    given = rows.groupBy("series_id")
    kept = ["at", *columns]

    class Trimmed(InOrder):
        def handleInputRows(self, key, rows, timerValues):
            yield from super().handleInputRows(key, (f[kept] for f in rows), timerValues)

    return given.transformWithStateInPandas(Trimmed(step, close, start, state, names, round(idle * 1e6)), StructType.fromDDL(output), "append", "eventTime")


def timed_episodes(stream: DataFrame, threshold: float, debounce: int, refractory: int, late: str, idle: float, groups: int | None = GROUPS) -> DataFrame:
    """Alarm episodes of stream(series_id, ts, score): series_id, t_start, t_end (microseconds), max_score, each once it has closed: by
    `refractory` quiet scores, or by `idle` seconds without any. A row may come `late` after newer ones. Series are dealt to
    `groups` keys by a hash, and what waits and the states of a key's series are read together; with None each is a key of its own."""

    def step(s, row):
        run, quiet, live, start, last, top, peak = s
        at, v = row
        out = []
        if v >= threshold:
            run, quiet, peak = run + 1, 0, max(peak, v)
            if not live and run >= debounce:
                live, start = True, at
            if live:
                last, top = at, peak
        else:
            run, quiet = 0, quiet + 1
            if quiet >= refractory:
                if live:
                    out.append((start, last, top))
                live, peak = False, -math.inf
            elif not live:
                peak = -math.inf
        return (run, quiet, live, start, last, top, peak), out

    def close(s):
        return None, [(s[3], s[4], s[5])] if s[2] else []

    start = (0, 0, False, 0, 0, 0.0, -math.inf)
    state = "run int, quiet int, live boolean, start long, last_flag long, top double, peak double"
    return _timed(stream, ["score"], (step, close, start, state), "series_id long, t_start long, t_end long, max_score double", late, idle, groups)


def timed_crossings(stream: DataFrame, high: float, low: float, critical: float, gap: float, late: str, idle: float, groups: int | None = GROUPS) -> DataFrame:
    """Declustered crossings of stream(series_id, ts, x), as crossings() and decluster() have them with difference quotients: series_id,
    before (microseconds, of the sample before it), after (microseconds from that to the crossing), side, severity of the largest of each chain, once a row comes more than `gap` seconds after its last crossing, or
    the series has been silent for `idle` seconds; a series that goes on after that begins anew. `groups` as in timed_episodes()."""
    wide = gap * 1e6

    def step(s, row):
        seen, pt, px, pdx, open_, last, before, after, side_, best = s
        t, x = row
        dx = (x - px) / ((t - pt) / 1e6) if seen and t > pt else 0.0
        side, out = 0, []
        if seen:
            side = 1 if px < high <= x else -1 if px > low >= x else 0
        if side:
            f = ((high if side == 1 else low) - px) / (x - px)
            at, severity = pt + f * (t - pt), side * (pdx + f * (dx - pdx)) / critical
            if open_ and at - last > wide:
                out.append((before, after, side_, best))
                open_ = False
            if not open_ or severity > best:
                before, after, side_, best = pt, f * (t - pt), side, severity
            open_, last = True, at
        if open_ and t - last > wide:  # crossings to come lie at this row's time or later
            out.append((before, after, side_, best))
            open_ = False
        return (True, t, x, dx, open_, last, before, after, side_, best), out

    def close(s):
        return None, [tuple(s[6:])] if s[4] else []

    start = (False, 0, 0.0, 0.0, False, 0.0, 0, 0.0, 0, 0.0)
    state = "seen boolean, pt long, px double, pdx double, open boolean, last_t double, before long, after double, side int, best double"
    return _timed(stream, ["x"], (step, close, start, state), "series_id long, before long, after double, side int, severity double", late, idle, groups)
