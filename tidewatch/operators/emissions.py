"""Rate emissions in full: gated or from the start, over a trailing window with the whole history to fall back on."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.emission import Config, emit
from tidewatch.operators.windows import to_series

_FIELDS = "t double, rate double, lo double, hi double, exposure double, gap double, n long, exceedances long, positive long, negative long, threshold double, p_critical double, flags array<string>, drawn_at double"


def emission_paths(samples: DataFrame, crossings: DataFrame, config: Config, draws: bool = False) -> DataFrame:
    """Emissions of samples(series_id, i, t, x, dx) and raw crossings(series_id, t, i_detect, severity, side), each from what lies at
    or before its time only: series_id, t, rate (critical crossings per hour), lo, hi, exposure, gap, n (crossings that lead
    their chains), exceedances, positive, negative (by side), threshold, p_critical, flags, drawn_at and, if asked, draws.

    An emission takes the last `window` seconds, or the whole record while that holds too few raw crossings or gives no
    tail (flag full_history). Gated emissions begin one cadence in and wait for enough crossings and exceedances; else they begin with
    the record. lo and hi are the quantiles of the draws, without a gate Garwood's exact interval of n times p_critical; they
    and the draws are renewed after `refresh` seconds and held between. Draws are seeded by series and time. Further flags: prior_dominated (fewer than 3 exceedances),
    threshold_clipped. Records end before their first value that isn't finite; those of fewer than three samples have none.

    A series is one row of arrays, beside its crossings; rows are dealt over tasks by series, and Arrow batches are cut small.
    """
    whole = to_series(samples).select("series_id", "t", "x")
    good = F.transform("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    bad = F.array_position(good, F.lit(False))
    n = F.when(bad > 0, (bad - 1).cast("int")).otherwise(F.size("x"))
    whole = whole.select("series_id", F.slice("t", F.lit(1), n).alias("t"), F.slice("x", F.lit(1), n).alias("x"))
    packed = crossings.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("t", "i_detect", "severity", "side"))).alias("c")).select("series_id", F.col("c.t").alias("ct"), F.col("c.severity").alias("cs"), F.col("c.side").alias("cd"))
    rows = whole.join(packed, "series_id", "left")
    if not draws and not config.gated:
        config = replace(config, draws=0)
    names = [f.split(" ")[0] for f in _FIELDS.split(", ")] + ["draws"] * draws

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = lambda a: np.zeros(0) if a is None else np.asarray(a, np.float64)
        for batch in batches:
            for r in batch.itertuples(index=False):
                found = emit(int(r.series_id), own(r.t), own(r.x), (own(r.ct), own(r.cs), own(r.cd)), config)
                if found:
                    yield pd.DataFrame({"series_id": np.full(len(found), r.series_id), **{c: [e[c] for e in found] for c in names}})

    return rows.mapInPandas(run, f"series_id long, {_FIELDS}" + (", draws array<double>" if draws else ""))
