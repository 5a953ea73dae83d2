"""Operators that put others together: observations, policies, summaries and their comparisons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import events as ev
from tidewatch.operators import metrics as me


def physical_scale(samples: DataFrame, level: float, omega: float) -> DataFrame:
    """series_id, i and x over the level, dx over level times frequency."""
    return samples.select("series_id", "i", (F.col("x") / level).alias("x"), (F.col("dx") / (level * omega)).alias("dx"))


def physical_state(ends: DataFrame, level: float, omega: float, start: float = 1.0, drift: float = 0.0, constants: dict[str, float] | None = None) -> DataFrame:
    """ends(series_id, t, x, dx) with the state scaled as in physical_scale(), and ground truth of each: stiffness (start
    plus drift times t), drift, and one column for each constant."""
    more = [F.lit(float(v)).alias(k) for k, v in (constants or {}).items()]
    return ends.select("series_id", "t", (F.col("x") / level).alias("x"), (F.col("dx") / (level * omega)).alias("dx"), (F.lit(start) + drift * F.col("t")).alias("stiffness"), F.lit(drift).alias("drift"), *more)


def energy_scores(scaled: DataFrame, quintic: float, saddle: float, bias: float = 0.0) -> DataFrame:
    """series_id, i, energy, reserve to the nearer saddle (their energies are saddle -/+ bias), and its fall since the
    sample before."""
    x, v = F.col("x"), F.col("dx")
    out = scaled.select("series_id", "i", (v * v / 2 + x * x / 2 - x**4 / 4 + quintic * x**6 / 6 - bias * x).alias("energy"))
    out = out.withColumn("reserve", F.lit(saddle - abs(bias)) - F.col("energy"))
    return out.withColumn("depletion", F.lag("reserve").over(Window.partitionBy("series_id").orderBy("i")) - F.col("reserve"))


def mean_causal_variance(samples: DataFrame, units: DataFrame, step: float, trailing: float | None = None) -> DataFrame:
    """series_id, mean over a grid of `step` seconds of the variance of all samples up to each grid time, or of those
    in the last `trailing` seconds (two or more). Samples and grid are merged by time, so no range is joined."""
    grid = units.select("series_id", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor((F.col("record_end") - F.col("record_start")) / step).cast("int")))).alias("k"), "record_start").select("series_id", (F.col("record_start") + F.col("k") * step).alias("t"), F.lit(None).cast("double").alias("x"), F.lit(1).alias("asks"))
    both = samples.select("series_id", "t", "x", F.lit(0).alias("asks")).unionByName(grid)
    w = Window.partitionBy("series_id").orderBy("t", "asks").rowsBetween(Window.unboundedPreceding, 0)
    if trailing is not None:
        w = Window.partitionBy("series_id").orderBy(F.round(F.col("t") * 1e6).cast("long")).rangeBetween(-round(trailing * 1e6), 0)
    seen = both.withColumns({"v": F.var_samp("x").over(w), "n": F.count("x").over(w)}).where("asks = 1 and n >= 2")
    return units.select("series_id").join(seen.groupBy("series_id").agg(F.avg("v").alias("m")), "series_id", "left").select("series_id", F.coalesce("m", F.lit(0.0)).alias("variance"))


def entry_state(margins: DataFrame, energies: DataFrame, samples: DataFrame, t0: float) -> DataFrame:
    """Each series' first sample at or after t0: x, dx, margin and reserve; valid if both are positive."""
    first = samples.where(F.col("t") >= t0).groupBy("series_id").agg(F.min_by(F.struct("i", "x", "dx"), "i").alias("s")).select("series_id", "s.*")
    out = first.join(margins.select("series_id", "i", "margin"), ["series_id", "i"]).join(energies.select("series_id", "i", "reserve"), ["series_id", "i"])
    return out.withColumn("valid", (F.col("margin") > 0) & (F.col("reserve") > 0))


def observe(units: DataFrame, clusters: DataFrame, partition: DataFrame, variance: DataFrame) -> DataFrame:
    """One row per series: exposure, clusters, their rate per hour, variance, outcome (heralded, unheralded, none)."""
    counted = clusters.groupBy("series_id").agg(F.count("*").alias("n"))
    out = units.join(counted, "series_id", "left").join(partition.select("series_id", "heralded"), "series_id", "left").join(variance, "series_id", "left")
    exposure = F.coalesce("t_event", "record_end") - F.col("record_start")
    n = F.coalesce("n", F.lit(0)).cast("long")
    outcome = F.when(F.col("t_event").isNull(), "none").when(F.col("heralded"), "heralded").otherwise("unheralded")
    return out.select("series_id", "stratum", exposure.alias("exposure"), n.alias("clusters"), F.when(exposure > 0, n / exposure * 3600).alias("rate"), "variance", outcome.alias("outcome"))


def sampling_gap(observations: DataFrame, samples: DataFrame, units: DataFrame, high: float, low: float, middle: float) -> DataFrame:
    """observations with `gap`: whether an unheralded event can have come between two samples: the last sample before it lies
    within the level of its side (high from the middle on, else low) and no more than the series' median step before the event."""
    w = Window.partitionBy("series_id").orderBy("i")
    events = units.where("t_event is not null").select("series_id", "t_event")
    steps = samples.withColumn("step", F.col("t") - F.lag("t").over(w)).join(events, "series_id")
    last = steps.groupBy("series_id").agg(F.median("step").alias("dt"), F.max_by(F.when(F.col("t") < F.col("t_event"), F.struct("t", "x")), F.when(F.col("t") < F.col("t_event"), F.col("i"))).alias("s"), F.first("t_event").alias("t_event"))
    within = F.when(F.col("s.x") >= middle, F.col("s.x") < high).otherwise(F.col("s.x") > low)
    near = F.col("t_event") - F.col("s.t") <= F.col("dt") + 1e-12
    out = observations.join(last.select("series_id", (within & near).alias("_gap")), "series_id", "left")
    return out.withColumn("gap", (F.col("outcome") == "unheralded") & F.coalesce("_gap", F.lit(False))).drop("_gap")


def trailing_rms(samples: DataFrame, window: float) -> DataFrame:
    """series_id, i and rms: the root of the mean square of x over the last `window` seconds up to each sample, ends included."""
    w = Window.partitionBy("series_id").orderBy(F.round(F.col("t") * 1e6).cast("long")).rangeBetween(-round(window * 1e6), 0)
    return samples.select("series_id", "i", F.sqrt(F.avg(F.col("x") * F.col("x")).over(w)).alias("rms"))


def partition_summary(observations: DataFrame, by: list[str]) -> DataFrame:
    """by, n and counts of the three outcomes."""
    return observations.groupBy(*by).agg(F.count("*").alias("n"), *(F.count_if(F.col("outcome") == o).alias(o) for o in ("heralded", "unheralded", "none")))


def crossing_structure(crossings: DataFrame, kept: DataFrame, units: DataFrame) -> DataFrame:
    """Retained crossings per series, events without a crossing before them, share of events whose last crossing is the
    first of its side, and the median delay from the first crossing to the event."""
    events = units.where("t_event is not null").select("series_id", "t_event")
    before = crossings.join(events, "series_id").where("t <= t_event")
    last = before.groupBy("series_id").agg(F.max_by("side", F.struct("t", "i_detect")).alias("side"), F.max("t").alias("last_t"), F.min("t").alias("first_t"), F.first("t_event").alias("t_event"))
    sides = before.groupBy("series_id", "side").agg(F.min("t").alias("side_t"))
    own = events.join(last.drop("t_event").join(sides, ["series_id", "side"]), "series_id", "left")
    a = own.agg(F.count_if(F.col("last_t").isNull()).alias("without"), F.avg((F.col("last_t") == F.col("side_t")).cast("double")).alias("first_share"), F.percentile(F.col("t_event") - F.col("first_t"), F.lit(0.5)).alias("median_delay"))
    b = units.join(kept.groupBy("series_id").count(), "series_id", "left").agg(F.avg(F.coalesce("count", F.lit(0))).alias("retained_per_series"))
    return a.crossJoin(b)


def false_group_share(scores: DataFrame, units: DataFrame, groups: DataFrame, threshold: float, debounce: int, refractory: int, horizon: float, gap: float) -> DataFrame:
    """False merged episodes, and how many of them have a constituent episode that overlaps a group (series_id, lo, hi)
    of a series without an event."""
    own = scores.join(units, "series_id").where("t >= record_start and t <= record_end and t <= coalesce(t_event, record_end)")
    raw = ev.episodes(own.select("series_id", "t", "score"), threshold, debounce, refractory)
    merged = ev.merge_episodes(raw, gap).withColumnsRenamed({"t_start": "lo_m", "t_end": "hi_m"}).drop("max_score")
    held = merged.join(units.select("series_id", "t_event"), "series_id")
    false = held.where(~F.coalesce((F.col("lo_m") < F.col("t_event")) & (F.col("hi_m") >= F.col("t_event") - horizon), F.lit(False)))
    parts = false.join(raw.select("series_id", "t_start", "t_end"), "series_id").where("t_start >= lo_m and t_end <= hi_m")
    safe = groups.join(units.where("t_event is null").select("series_id"), "series_id", "left_semi")
    met = parts.join(safe, "series_id").where("t_start <= hi and lo <= t_end").select("series_id", "lo_m").distinct()
    return false.agg(F.count("*").alias("false_episodes")).crossJoin(met.agg(F.count("*").alias("coincident")))


def apply_policy(scores: DataFrame, units: DataFrame, policy: DataFrame, debounce: int, refractory: int, horizon: float, gap: float) -> DataFrame:
    """Alarm metrics of each method at the threshold frozen for it in policy(method, threshold)."""
    frozen = scores.join(F.broadcast(policy.select("method", "threshold")), "method")
    return me.alarm_metrics(me.contributions(frozen, units, F.col("threshold"), debounce, refractory, horizon, gap, ["method", "threshold"]), ["method", "threshold"])


def select_best(grid: DataFrame, order: list, by: list[str] | None = None) -> DataFrame:
    """The first row of a parameter grid by `order`, for each group."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)
    return grid.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def capture_breakdown(rows: DataFrame, captured: str, a: str, b: str) -> DataFrame:
    """Captures pooled, by a and by b, as grouping sets: a, b, n, captured."""
    return rows.groupingSets([[], [F.col(a)], [F.col(b)]], F.col(a), F.col(b)).agg(F.count("*").alias("n"), F.count_if(F.col(captured)).alias("captured"))


def gated_coverage(emissions: DataFrame, units: DataFrame) -> DataFrame:
    """Hours from each series' first emission to its event or end, of all hours, and events that fall in them."""
    first = emissions.groupBy("series_id").agg(F.min("t").alias("first_t"))
    own = units.join(first, "series_id", "left").withColumn("stop", F.coalesce("t_event", "record_end"))
    return own.agg((F.sum(F.greatest(F.col("stop") - F.col("first_t"), F.lit(0.0))) / 3600).alias("covered_hours"), (F.sum(F.col("stop") - F.col("record_start")) / 3600).alias("hours"), F.count_if(F.col("t_event") >= F.col("first_t")).alias("covered_events"), F.count("t_event").alias("events"))


def tracking_error(pred: DataFrame, truth: DataFrame, last: float = 1 / 3) -> DataFrame:
    """Mean over series of the mean absolute error over the last part of each; pred and truth(series_id, t, value)."""
    both = pred.select("series_id", "t", F.col("value").alias("p")).join(truth.select("series_id", "t", F.col("value").alias("y")), ["series_id", "t"])
    w = Window.partitionBy("series_id")
    late = both.withColumns({"lo": F.min("t").over(w), "hi": F.max("t").over(w)}).where(F.col("t") >= F.col("hi") - (F.col("hi") - F.col("lo")) * last)
    return late.groupBy("series_id").agg(F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae")).agg(F.avg("mae").alias("error"), F.count("*").alias("series"))


def tracking_bins(pred: DataFrame, truth: DataFrame, width: float) -> DataFrame:
    """bin (of `width` seconds), n, predicted and true mean, and mean absolute error of pred and truth(series_id, t, value)."""
    both = pred.select("series_id", "t", F.col("value").alias("p")).join(truth.select("series_id", "t", F.col("value").alias("y")), ["series_id", "t"])
    return both.groupBy(F.floor(F.col("t") / width).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("predicted"), F.avg("y").alias("truth"), F.avg(F.abs(F.col("p") - F.col("y"))).alias("error"))


def level_search(samples: DataFrame, low: float, high: float, steps: int, gap: float, hours: float, target: float) -> DataFrame:
    """Levels between low and high with their number of declustered up-crossings per hour; the first row is the one
    nearest to the target. Levels are exploded next to samples, one window for all of them."""
    levels = F.explode(F.array(*(F.lit(low + (high - low) * k / (steps - 1)) for k in range(steps))))
    rows = samples.withColumn("px", F.lag("x").over(Window.partitionBy("series_id").orderBy("i"))).withColumn("level", levels)
    up = rows.where((F.col("px") < F.col("level")) & (F.col("x") >= F.col("level"))).select("series_id", "level", "t", F.col("i").alias("i_detect"), F.col("x").alias("severity"))
    counts = ev.decluster(up, gap, ["series_id", "level"]).groupBy("level").agg((F.count("*") / hours).alias("rate"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.round(F.abs(F.col("rate") - target), 9), "level")))


def register_score(frame: DataFrame, method: str, score: Callable | None = None, column=None) -> DataFrame:
    """scores(method, series_id, t, score) of a user's model: a column expression, or a function of pandas frames with
    series_id and t that returns the scores of their rows."""
    if column is not None:
        return frame.select(F.lit(method).alias("method"), "series_id", "t", column.cast("double").alias("score"))

    def run(frames):
        for f in frames:
            yield f[["series_id", "t"]].assign(method=method, score=score(f))[["method", "series_id", "t", "score"]]

    return frame.mapInPandas(run, "method string, series_id long, t double, score double")
