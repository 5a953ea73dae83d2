"""Alarm episodes at many thresholds at once, for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def sweep(batches: Iterator[pd.DataFrame], own: list[str], kept: list[str], debounce: int, refractory: int, gap: float) -> Iterator[pd.DataFrame]:
    """own, j, t_start, t_end, kept of batches(own, t, level, of, kept) in order of own and t: the merged episodes of each
    series at each of its `of` thresholds. level tells how many thresholds, from the least, a sample reaches, so that it
    flags those below it and no others. What is held is one series' numbers for each threshold, however long it is.
    """
    columns = [*own, "j", "t_start", "t_end", *kept]
    head, s = None, None

    def give(out: list, at: np.ndarray) -> None:
        if len(at):
            out.append((s["head"], at + 1, s["first"][at], s["end"][at]))

    def close(out: list, at: np.ndarray) -> None:
        """Episodes end at the thresholds `at`: each is added to the one before, or takes its place."""
        s["live"][at] = False
        apart = at[~s["held"][at] | (s["start"][at] - s["end"][at] > gap)]
        give(out, apart[s["held"][apart]])
        s["first"][apart] = s["start"][apart]
        s["end"][at] = s["last"][at]
        s["held"][at] = True

    def finish(out: list) -> None:
        if s is not None:
            close(out, s["live"].nonzero()[0])
            give(out, s["held"].nonzero()[0])

    def frame(out: list) -> pd.DataFrame:
        heads = pd.DataFrame([h for h, *_ in out], columns=[*own, *kept], dtype=object).loc[np.repeat(np.arange(len(out)), [len(j) for _, j, _, _ in out])]
        found = {name: np.concatenate([x[i] for x in out]) for i, name in ((1, "j"), (2, "t_start"), (3, "t_end"))}
        return heads.reset_index(drop=True).assign(**found)[columns]

    for batch in batches:
        out: list = []
        keys = batch[own]
        again = ((keys == keys.shift()) | (keys.isna() & keys.shift().isna())).all(axis=1).to_numpy()
        cuts = [0, *(np.flatnonzero(~again[1:]) + 1).tolist(), len(batch)] if len(batch) else []
        times, levels = batch["t"].tolist(), batch["level"].tolist()
        for a, b in zip(cuts, cuts[1:]):
            one = tuple(None if pd.isna(v) else v for v in keys.iloc[a])
            if s is None or one != head:
                finish(out)
                n = int(batch["of"].iloc[a])
                more = tuple(None if pd.isna(v) else v for v in batch[kept].iloc[a])
                head, s = one, {"head": (*one, *more), **{c: np.zeros(n, np.int64) for c in ("run", "quiet")}, **{c: np.zeros(n, bool) for c in ("live", "held")}, **{c: np.zeros(n) for c in ("start", "last", "first", "end")}}
            run, quiet, live, start, last = (s[c] for c in ("run", "quiet", "live", "start", "last"))
            for t, c in zip(times[a:b], levels[a:b]):
                run[:c] += 1
                quiet[:c] = 0
                last[:c] = t
                fresh = ((run[:c] >= debounce) > live[:c]).nonzero()[0]
                if len(fresh):
                    live[fresh] = True
                    start[fresh] = t
                run[c:] = 0
                quiet[c:] += 1
                over = (live[c:] & (quiet[c:] >= refractory)).nonzero()[0]
                if len(over):
                    close(out, over + c)
        if out:
            yield frame(out)
    out = []
    finish(out)
    if out:
        yield frame(out)
