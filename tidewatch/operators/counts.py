"""Exact count intervals, bootstraps of sums, curves and reliability, and count rates built on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.special import negative_binomial_quantile
from tidewatch.operators.metrics import auc
from tidewatch.operators.resampling import drawn_ranks, drawn_sums, poisson_bounds, proportion_bounds


def alarm_intervals(contribution: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sensitivity with its exact (Clopper-Pearson) interval and false episodes per hour with theirs (Garwood), of
    contributions(); bounds are null without events or exposure."""
    keys = keys or []
    sums = contribution.groupBy(*keys).agg(F.sum("observable").alias("events"), F.sum("detected").alias("detected"), F.sum("false_episodes").alias("false_episodes"), (F.sum("exposure") / 3600).alias("hours"))
    lo, hi = proportion_bounds("detected", "events")
    false_lo, false_hi = poisson_bounds("false_episodes")
    have = F.col("hours") > 0
    out = sums.withColumns({"a": lo, "b": hi, "c": false_lo, "d": false_hi})
    return out.select(*keys, "events", "detected", F.when(F.col("events") > 0, F.col("detected") / F.col("events")).alias("sensitivity"), F.when(F.col("events") > 0, F.col("a")).alias("sensitivity_lo"), F.when(F.col("events") > 0, F.col("b")).alias("sensitivity_hi"), F.when(have, F.col("false_episodes") / F.col("hours")).alias("false_per_hour"), F.when(have, F.col("c") / F.col("hours")).alias("false_lo"), F.when(have, F.col("d") / F.col("hours")).alias("false_hi"))


def coverage(bounded: DataFrame, lo: float, hi: float, by: list[str] | None = None) -> DataFrame:
    """by, n, covered, share and exact interval of rows(t, miss) with lo <= t < hi; share and bounds null without rows."""
    by = by or []
    sums = bounded.where((F.col("t") >= lo) & (F.col("t") < hi)).groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum(1 - F.col("miss")), F.lit(0)).cast("long").alias("covered"))
    low, high = proportion_bounds("covered", "n")
    out = sums.withColumns({"lo": low, "hi": high})
    return out.select(*by, "n", "covered", (F.col("covered") / F.nullif("n", F.lit(0))).alias("share"), F.when(F.col("n") > 0, F.col("lo")).alias("lo"), F.when(F.col("n") > 0, F.col("hi")).alias("hi"))


def fit_intercept(observations: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, events, hours, rate, lo, hi: unheralded events over all exposure (seconds), with Garwood's interval."""
    sums = observations.groupBy(*(by or [])).agg(F.count_if(F.col("outcome") == "unheralded").alias("events"), (F.sum("exposure") / 3600).alias("hours"))
    lo, hi = poisson_bounds("events")
    out = sums.withColumns({"a": lo, "b": hi})
    return out.select(*(by or []), "events", "hours", (F.col("events") / F.col("hours")).alias("rate"), (F.col("a") / F.col("hours")).alias("lo"), (F.col("b") / F.col("hours")).alias("hi"))


def count_predictive(df: DataFrame, by: list[str], event: str, hours: str, future: float = 1.0) -> DataFrame:
    """by, events, hours, lo, hi: the central 95% of the negative binomial count of the next `future` hours, of shape
    events + 1/2 (Jeffreys). Its quantiles come from the incomplete beta function, on the grouped rows; null without
    exposure."""
    sums = df.groupBy(*by).agg(F.count_if(F.col(event)).alias("events"), F.sum(hours).alias("hours"))

    def bound(p: float):
        @F.pandas_udf("long")
        def run(events: pd.Series, watched: pd.Series) -> pd.Series:
            k, h = events.to_numpy(np.float64), watched.to_numpy(np.float64)
            good = h > 0
            out = pd.Series([pd.NA] * len(k), dtype="Int64")
            out[good] = negative_binomial_quantile(p, k[good] + 0.5, h[good] / (h[good] + future)).astype(np.int64)
            return out

        return run("events", "hours")

    return sums.select(*by, "events", "hours", bound(0.025).alias("lo"), bound(0.975).alias("hi"))


def _percentiles(replicates: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    out = replicates.groupBy(*(by or [])).agg(F.expr(f"percentile({value}, array(0.025D, 0.975D))").alias("q"), F.count(value).alias("replicates"))
    return out.select(*(by or []), F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "replicates")


def bootstrap_total(values: DataFrame, units: DataFrame, value: str, by: str, replicates: int, seed: int) -> DataFrame:
    """by, estimate and 95% interval of the sum of values(series_id, value) over each group of units, whole series
    drawn within strata."""
    own = units.select("series_id", F.col(by).alias("by")).join(values.select("series_id", F.col(value).alias("v")), "series_id")
    sums = drawn_sums(own.where("v is not null"), units, ["by"], ["v"], replicates, seed).withColumnRenamed("v", "s")
    out = own.groupBy("by").agg(F.sum("v").alias("estimate")).join(_percentiles(sums, "s", ["by"]), "by")
    return out.withColumnRenamed("by", by)


def reliability_edges(df: DataFrame, column: str, bins: int, low: float = -1.0, high: float = 2.0) -> list[float]:
    """bins + 1 edges: exact quantiles of a column, the outer ones moved to low and high, each one made larger than the one before
    by the least possible step where it isn't."""
    steps = F.array(*(F.lit(k / bins) for k in range(bins + 1)))
    got = df.agg(F.percentile(column, steps)).first()[0] or [0.0] * (bins + 1)
    edges = [low, *got[1:-1], high]
    for k in range(1, bins + 1):
        if edges[k] <= edges[k - 1]:
            edges[k] = float(np.nextafter(edges[k - 1], np.inf))
    return edges


def reliability(df: DataFrame, p: str, label: str, edges: list[float], by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """by, bin, n (summed weight), predicted, observed, error: means of rows whose p lies in [edge, next edge)."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    bin_ = F.size(F.filter(F.array(*(F.lit(e) for e in edges[1:-1])), lambda e: e <= F.col(p)))
    rows = df.select(*(by or []), bin_.alias("bin"), F.col(p).alias("p"), F.col(label).alias("y"), w.alias("w"))
    out = rows.groupBy(*(by or []), "bin").agg(F.sum("w").alias("n"), (F.sum(F.col("p") * F.col("w")) / F.sum("w")).alias("predicted"), (F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("observed"))
    return out.withColumn("error", F.abs(F.col("predicted") - F.col("observed")))


def reliability_error(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, error: mean of the bins' absolute errors, weighted by their counts."""
    return table.groupBy(*(by or [])).agg((F.sum(F.col("n") * F.col("error")) / F.sum("n")).alias("error"))


def bootstrap_reliability(df: DataFrame, units: DataFrame, p: str, label: str, edges: list[float], replicates: int, seed: int) -> DataFrame:
    """estimate and 95% interval of reliability_error(); rows of a series are summed by bin before they are drawn."""
    whole = reliability(df, p, label, edges, ["series_id"]).select("series_id", "bin", "n", (F.col("predicted") * F.col("n")).alias("sp"), (F.col("observed") * F.col("n")).alias("sy"))
    drawn = drawn_sums(whole, units, ["bin"], ["n", "sp", "sy"], replicates, seed)
    errors = reliability_error(drawn.withColumn("error", F.abs(F.col("sp") - F.col("sy")) / F.col("n")), ["replicate"])
    return reliability_error(reliability(df, p, label, edges)).withColumnRenamed("error", "estimate").crossJoin(_percentiles(errors, "error"))


def metric_vector(df: DataFrame, p: str, label: str, edges: list[float]) -> DataFrame:
    """auc, brier, reliability_error of one scored table."""
    brier = df.agg(F.avg((F.col(p) - F.col(label)) ** 2).alias("brier"))
    error = reliability_error(reliability(df, p, label, edges)).withColumnRenamed("error", "reliability_error")
    return auc(df, label=label, score=p).crossJoin(brier).crossJoin(error)


def monotone(levels: DataFrame, by: list[str], x: str, y: str, w: str) -> DataFrame:
    """by, x, fit: the least-squares rising fit of y over the few levels x of each group, by its max-min formula."""
    own = F.sort_array(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(w).cast("double").alias("w"))))
    rows = levels.groupBy(*by).agg(own.alias("a"))

    def mean(i: Column, j: Column) -> Column:
        part = F.slice("a", i + 1, j - i + 1)
        return F.aggregate(part, F.lit(0.0), lambda s, v: s + v["y"] * v["w"]) / F.aggregate(part, F.lit(0.0), lambda s, v: s + v["w"])

    last = F.size("a") - 1
    fit = F.transform("a", lambda v, k: F.struct(v["x"].alias("x"), F.array_max(F.transform(F.sequence(F.lit(0), k), lambda i: F.array_min(F.transform(F.sequence(k, last), lambda j: mean(i, j))))).alias("fit")))
    return rows.select(*by, F.inline(fit)).withColumnRenamed("x", x)


def response_curve(outcomes: DataFrame, units: DataFrame, level: str, hit: str, replicates: int, seed: int) -> DataFrame:
    """level, n, share, fit and its 95% interval: the rising fit of the share of hits by level, whole series drawn. A
    level that a replicate doesn't draw has no value in it."""
    own = outcomes.select("series_id", F.col(level).alias("level"), F.col(hit).cast("double").alias("y"))
    table = own.groupBy("level").agg(F.count("*").alias("n"), F.avg("y").alias("share"))
    fit = monotone(table.withColumn("all", F.lit(0)), ["all"], "level", "share", "n").select("level", "fit")
    packed = own.groupBy("series_id", "level").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    drawn = drawn_sums(packed, units, ["level"], ["n", "y"], replicates, seed).select("replicate", "level", "n", (F.col("y") / F.col("n")).alias("share"))
    spread = _percentiles(monotone(drawn, ["replicate"], "level", "share", "n"), "fit", ["level"]).drop("replicates")
    return table.join(fit, "level").join(spread, "level").withColumnRenamed("level", level)


def predictive_coverage(df: DataFrame, value: str, lo: str, hi: str, by: list[str] | None = None) -> DataFrame:
    """by, n, covered: the share of values within their predictive interval, ends included."""
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg(F.col(value).between(F.col(lo), F.col(hi)).cast("double")).alias("covered"))


def score_rate_map(observations: DataFrame, steps: DataFrame, predictor: str) -> DataFrame:
    """series_id, predictor, rate (of the last step at or below the predictor, else of the first) and count, the rate
    times exposure. steps(x, y) is a monotone map of few steps; it is packed into one row."""
    packed = steps.agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("map"))
    below = F.filter("map", lambda s: s["x"] <= F.col(predictor))
    rate = F.when(F.size(below) > 0, F.get(below, F.size(below) - 1)["y"]).otherwise(F.get("map", F.lit(0))["y"])
    return observations.crossJoin(F.broadcast(packed)).select("series_id", predictor, rate.alias("rate"), (rate * F.col("exposure")).alias("count"))


def baseline_rows(units: DataFrame, retained: DataFrame, variance: DataFrame, emissions: DataFrame) -> DataFrame:
    """One row per series: hours observed, mean causal variance, declustered crossings per hour, last emitted rate
    (0 before any)."""
    counted = retained.groupBy("series_id").agg(F.count("*").alias("n"))
    last = emissions.groupBy("series_id").agg(F.max_by("rate", "t").alias("last_rate"))
    hours = (F.coalesce("t_event", "record_end") - F.col("record_start")) / 3600
    out = units.join(counted, "series_id", "left").join(variance, "series_id", "left").join(last, "series_id", "left")
    return out.select("series_id", F.col("t_event").isNotNull().alias("event"), hours.alias("hours"), F.coalesce("variance", F.lit(0.0)).alias("variance"), F.when(hours > 0, F.coalesce("n", F.lit(0)) / hours).otherwise(0.0).alias("crossings_per_hour"), F.coalesce("last_rate", F.lit(0.0)).alias("last_rate"))


def score_hybrid(crossings: DataFrame, emissions: DataFrame, conditional: DataFrame, background: float) -> DataFrame:
    """series_id, t, n, rate: at each emission the summed conditional chance of the crossings up to it over the time
    watched, plus the background rate. conditional(x, y) maps a crossing's severity to a chance by few steps."""
    chance = score_rate_map(crossings.withColumn("exposure", F.lit(1.0)), conditional, "severity")
    rows = crossings.select("series_id", "t", "severity").join(chance.select("series_id", "severity", "rate").distinct(), ["series_id", "severity"]).select("series_id", "t", F.col("rate").alias("y"), F.lit(None).cast("double").alias("exposure"), F.lit(0).alias("asks"))
    both = rows.unionByName(emissions.select("series_id", "t", F.lit(0.0).alias("y"), "exposure", F.lit(1).alias("asks")))
    w = Window.partitionBy("series_id").orderBy("t", "asks").rowsBetween(Window.unboundedPreceding, 0)
    # Chances are added as decimals of twelve places, so that their order doesn't matter
    seen = both.withColumns({"n": F.sum(1 - F.col("asks")).over(w), "s": F.sum(F.col("y").cast("decimal(20,12)")).over(w).cast("double")}).where("asks = 1")
    return seen.select("series_id", "t", "n", (F.col("s") / F.col("exposure") + background).alias("rate"))


def bootstrap_tracking(paths: DataFrame, units: DataFrame, grid: list[float], bandwidth: float, most: int, replicates: int, seed: int, scale: float = 1.0) -> DataFrame:
    """lag (in steps of the grid), bias, their 95% intervals lag_lo, lag_hi, bias_lo, bias_hi, estimable and replicates of the tracking of
    events by rates, whole series drawn within strata.

    paths(series_id, t, rate) are rates at the times of the grid (null after the record), units as in kernel_hazard(). A series is first packed
    into arrays over the grid: its rate and 1 at the times at risk, its kernel density of the event and 1 where that is still ahead. Replicates add up
    these arrays, each as often as the series is drawn, to a mean rate and a hazard path. The lag is the shift, of at most `most` steps, whose
    correlation is largest over 3 points or more (to nine places; the smallest of equal ones), rate later than hazard for positive ones,
    0 where a path doesn't vary; bias is the mean of rate less hazard, which is multiplied by `scale` to have the rate's unit.
    """
    n = len(grid)
    times = F.array(*(F.lit(float(g)) for g in grid))
    place = F.map_from_entries(F.collect_list(F.struct(F.col("t"), F.col("rate"))))
    rates_ = paths.where("rate is not null").groupBy("series_id").agg(place.alias("at"))
    joined = units.join(rates_, "series_id", "left")
    density = lambda g: F.coalesce(F.exp(-((g - F.col("t_event")) ** 2) / (2 * bandwidth**2)) / (bandwidth * 2.5066282746310002), F.lit(0.0)) * scale
    risk = lambda g: ((F.col("record_end") >= g) & (F.coalesce("t_event", F.lit(float("inf"))) >= g)).cast("double")
    own = joined.select("series_id", F.transform(times, lambda g: F.coalesce(F.try_element_at("at", g), F.lit(0.0))).alias("r"), F.transform(times, lambda g: F.try_element_at("at", g).isNotNull().cast("double")).alias("rn"), F.transform(times, density).alias("d"), F.transform(times, risk).alias("dn"))
    every = own.groupBy().agg(*(F.sum(F.get(c, F.lit(k))).alias(f"{c}{k}") for c in ("r", "rn", "d", "dn") for k in range(n))).select(F.lit(-1).alias("replicate"), "*")
    names = [f"{c}{k}" for c in ("r", "rn", "d", "dn") for k in range(n)]
    flat = own.select("series_id", *(F.get(c, F.lit(k)).alias(f"{c}{k}") for c in ("r", "rn", "d", "dn") for k in range(n)))
    drawn = drawn_sums(flat, units, [], names, replicates, seed).unionByName(every)
    mean = lambda top, bottom: F.array(*(F.when(F.col(f"{bottom}{k}") > 0, F.col(f"{top}{k}") / F.col(f"{bottom}{k}")).otherwise(0.0) for k in range(n)))
    both = drawn.select("replicate", mean("r", "rn").alias("rate"), mean("d", "dn").alias("hazard"))

    def correlation(shift: int):
        """Of the hazard with the rate `shift` steps later; null if either doesn't vary."""
        size = n - abs(shift)
        x = F.slice("hazard", 1 + max(0, -shift), size)
        y = F.slice("rate", 1 + max(0, shift), size)
        average = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / size
        mx, my = average(x), average(y)
        product = lambda a, b, ma, mb: F.aggregate(F.zip_with(a, b, lambda u, v: (u - ma) * (v - mb)), F.lit(0.0), lambda s, v: s + v)
        sx, sy = product(x, x, mx, mx), product(y, y, my, my)
        return F.when((sx > 1e-24) & (sy > 1e-24), F.round(product(x, y, mx, my) / F.sqrt(sx * sy), 9))

    shifts = [k for k in range(-most, most + 1) if n - abs(k) >= 3]
    best = F.array_max(F.filter(F.array(*(F.struct(correlation(k).alias("c"), F.lit(-k).alias("k")) for k in shifts)), lambda s: s["c"].isNotNull()))
    bias = F.aggregate(F.zip_with("rate", "hazard", lambda a, b: a - b), F.lit(0.0), lambda s, v: s + v) / n
    each = both.select("replicate", best.alias("best"), bias.alias("bias")).select("replicate", F.coalesce(-F.col("best.k"), F.lit(0)).cast("double").alias("lag"), F.col("best").isNotNull().alias("estimable"), "bias")
    q = lambda c: F.percentile(F.when(F.col("replicate") >= 0, F.col(c)), F.array(F.lit(0.025), F.lit(0.975)))
    whole = lambda c: F.max(F.when(F.col("replicate") < 0, F.col(c)))
    out = each.agg(whole("lag").alias("lag"), whole("bias").alias("bias"), whole("estimable").alias("estimable"), q("lag").alias("ql"), q("bias").alias("qb"), F.count_if(F.col("replicate") >= 0).alias("replicates"))
    return out.select("lag", "bias", "estimable", *(F.col(c)[i].alias(f"{name}_{side}") for c, name in (("ql", "lag"), ("qb", "bias")) for i, side in enumerate(("lo", "hi"))), "replicates")


def bootstrap_vector(df: DataFrame, units: DataFrame, p: str, label: str, edges: list[float], replicates: int, seed: int) -> DataFrame:
    """metric, estimate and 95% interval of auc, brier and reliability_error of metric_vector(), all from the same draws of
    whole series, drawn once for all three by drawn_ranks()."""
    drawn = drawn_ranks(df.select("series_id", F.col(p).alias("score"), F.col(label).alias("label")), units, replicates, seed, edges)
    over = lambda value: F.aggregate("bins", F.lit(0.0), lambda s, b: s + value(b))
    n = over(lambda b: b["n"])
    one = {
        "auc": F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))),
        "brier": over(lambda b: b["sq"]) / F.nullif(n, F.lit(0.0)),
        "reliability_error": over(lambda b: F.abs(b["sp"] - b["sy"])) / F.nullif(n, F.lit(0.0)),
    }
    each = drawn.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in one.items()))))
    spread = _percentiles(each.where("value is not null"), "value", ["metric"])
    names = ("auc", "brier", "reliability_error")
    estimate = metric_vector(df, p, label, edges).select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("estimate")) for m in names))))
    return estimate.join(spread, "metric").select("metric", "estimate", "lo", "hi", "replicates")
