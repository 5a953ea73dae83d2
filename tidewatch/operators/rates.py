"""Event-rate estimation, as-of lookups and monotone calibration."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.ranks import range_of


def tail_posterior(severities: DataFrame, q: float, shape: float, rate: float, by: list[str] | None = None, fixed: float | None = None) -> DataFrame:
    """Exponential tail above a threshold (quantile q, below 1, or fixed): by, n, threshold, exceedances, excess, the
    maximum-likelihood rate, the mean of a Gamma(shape, rate) prior's posterior, and the probability that an
    exceedance passes 1."""
    by = by or []
    if fixed is None:
        cut = severities.groupBy(*by).agg(F.least(F.percentile("severity", F.lit(q)), F.lit(1 - 1e-9)).alias("threshold"), F.count("*").alias("n"))
    else:
        cut = severities.groupBy(*by).agg(F.lit(float(fixed)).alias("threshold"), F.count("*").alias("n"))
    joined = severities.join(F.broadcast(cut), by) if by else severities.crossJoin(F.broadcast(cut))
    over = F.col("severity") > F.col("threshold")
    out = joined.groupBy(*by).agg(F.first("n").alias("n"), F.first("threshold").alias("threshold"), F.count_if(over).alias("exceedances"), F.coalesce(F.sum(F.when(over, F.col("severity") - F.col("threshold"))), F.lit(0.0)).alias("excess"))
    a, b = F.lit(shape) + F.col("exceedances"), F.lit(rate) + F.col("excess")
    return out.select(*by, "n", "threshold", "exceedances", "excess", F.when(F.col("excess") > 0, F.col("exceedances") / F.col("excess")).alias("mle"), (a / b).alias("posterior_mean"), F.pow(b / (b + 1 - F.col("threshold")), a).alias("p_critical"))


def asof_grid(emissions: DataFrame, units: DataFrame, grid: list[float]) -> DataFrame:
    """series_id, t, rate: the latest emission at or before each grid time, 0 before the first, null after the
    record. A union and a window, no range join."""
    times = F.explode(F.array(*(F.lit(float(g)) for g in grid)))
    asked = units.select("series_id", "record_end", times.alias("t")).select("series_id", "t", F.lit(1).alias("asks"), F.lit(None).cast("double").alias("rate"), "record_end")
    given = emissions.select("series_id", "t", F.lit(0).alias("asks"), "rate", F.lit(None).cast("double").alias("record_end"))
    w = Window.partitionBy("series_id").orderBy("t", "asks").rowsBetween(Window.unboundedPreceding, 0)
    out = given.unionByName(asked).withColumn("held", F.last("rate", ignorenulls=True).over(w)).where("asks = 1")
    return out.select("series_id", "t", F.when(F.col("t") <= F.col("record_end"), F.coalesce("held", F.lit(0.0))).alias("rate"))


def ensemble_path(paths: DataFrame) -> DataFrame:
    """t, the mean rate of the series at risk and their number; 0 where there is none."""
    return paths.groupBy("t").agg(F.coalesce(F.avg("rate"), F.lit(0.0)).alias("mean_rate"), F.count("rate").alias("at_risk"))


def kernel_hazard(units: DataFrame, grid: list[float], bandwidth: float) -> DataFrame:
    """t, hazard: Gaussian-smoothed event density over the units at risk (record and event not before t)."""
    table = F.broadcast(units.sparkSession.createDataFrame([(float(g),) for g in grid], "g double"))
    density = F.exp(-((F.col("g") - F.col("t_event")) ** 2) / (2 * bandwidth**2)) / (bandwidth * 2.5066282746310002)
    crossed = units.join(table)
    risk = (F.col("record_end") >= F.col("g")) & (F.coalesce("t_event", F.lit(float("inf"))) >= F.col("g"))
    sums = crossed.groupBy("g").agg(F.coalesce(F.sum(density), F.lit(0.0)).alias("d"), F.count_if(risk).alias("n"))
    return sums.select(F.col("g").alias("t"), F.when(F.col("n") > 0, F.col("d") / F.col("n")).otherwise(0.0).alias("hazard"), F.col("n").alias("at_risk"))


def rate_emissions(events: DataFrame, units: DataFrame, step: float, shape: float, rate: float) -> DataFrame:
    """Causal event rate on a grid of `step` seconds: series_id, t, n, exposure and the posterior mean rate of a
    Gamma(shape, rate) prior, each from events at or before t only. The grid is merged with the events by time."""
    grid = units.select("series_id", "record_start", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor((F.col("record_end") - F.col("record_start")) / step).cast("int")))).alias("k")).select("series_id", (F.col("record_start") + F.col("k") * step).alias("t"), "record_start", F.lit(0).alias("hit"))
    marks = events.select("series_id", "t", F.lit(None).cast("double").alias("record_start"), F.lit(1).alias("hit"))
    w = Window.partitionBy("series_id").orderBy("t", F.desc("hit")).rowsBetween(Window.unboundedPreceding, 0)
    seen = grid.unionByName(marks).withColumn("n", F.sum("hit").over(w)).where("hit = 0")
    exposure = F.col("t") - F.col("record_start")
    return seen.select("series_id", "t", "n", exposure.alias("exposure"), ((F.lit(shape) + F.col("n")) / (F.lit(rate) + exposure)).alias("rate"))


def integrate_rate(emissions: DataFrame, units: DataFrame) -> DataFrame:
    """series_id, expected: the rate held to the next emission, the last to the record's end."""
    w = Window.partitionBy("series_id").orderBy("t")
    joined = emissions.join(units.select("series_id", "record_end"), "series_id")
    span = F.coalesce(F.lead("t").over(w), "record_end") - F.col("t")
    return joined.withColumn("part", F.col("rate") * F.greatest(span, F.lit(0.0))).groupBy("series_id").agg(F.sum("part").alias("expected"))


def bin_lookup(df: DataFrame, edges: list[float], column: str) -> DataFrame:
    """df with `bin`: the number of inner edges that the value reaches."""
    return df.withColumn("bin", F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges[1:-1])), lambda e: F.col(column) >= e)))


def reliability(df: DataFrame, bins: int, expected: str = "expected", hit: str = "hit") -> DataFrame:
    """Quantile bins of an expected count: bin, n, predicted (mean of 1 - exp(-count)) and observed share."""
    cuts = F.percentile(expected, F.array(*(F.lit(k / bins) for k in range(1, bins))))
    joined = df.crossJoin(F.broadcast(df.agg(cuts.alias("cuts"))))
    rows = joined.select(F.size(F.filter(F.array_distinct("cuts"), lambda e: F.col(expected) >= e)).alias("bin"), (-F.expm1(-F.col(expected))).alias("p"), F.col(hit).cast("double").alias("y"))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("predicted"), F.avg("y").alias("observed"))


def _pool(rows: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring blocks (lo, w, wy), in order of lo, pooled until their means rise."""
    rows = rows.sort_values("lo", kind="stable")
    lo, weight, total = [], [], []
    for x, w, wy in zip(rows["lo"].tolist(), rows["w"].tolist(), rows["wy"].tolist(), strict=True):
        while lo and total[-1] * w >= wy * weight[-1]:
            x, w, wy = lo.pop(), w + weight.pop(), wy + total.pop()
        lo.append(x)
        weight.append(w)
        total.append(wy)
    return pd.DataFrame({"part": rows["part"].iloc[:1].tolist() * len(lo), "lo": lo, "w": weight, "wy": total})


def isotonic(df: DataFrame, x: str, y: str, w: str, fan: int = 16) -> DataFrame:
    """Weighted monotone least-squares fit: x, y, w, fit, one row for each distinct x; weights are positive.

    Values of x are cut into ranges. Within a range neighbours are pooled until means rise; the blocks that are left, of `fan` ranges
    at a time, are pooled again, and so on up to one stack: pooling what is pooled already gives the same blocks, so the order of merging
    doesn't matter. The last stack holds one row for each step of the fit. Rows then take the last block that begins
    at or before them, range by range, so no two rows are paired.
    """
    rows = df.groupBy(F.col(x).alias("x")).agg((F.sum(F.col(y) * F.col(w)) / F.sum(w)).alias("y"), F.sum(w).alias("w"))
    part = range_of(rows, "x")
    rows = rows.withColumn("part", part)
    stacks = rows.select("part", F.col("x").cast("double").alias("lo"), F.col("w").cast("double").alias("w"), (F.col("y") * F.col("w")).cast("double").alias("wy"))
    schema, parts = "part int, lo double, w double, wy double", max(256, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    while True:
        stacks = stacks.groupBy("part").applyInPandas(_pool, schema)
        if parts <= 1:
            break
        parts = -(-parts // fan)
        stacks = stacks.withColumn("part", (F.col("part") / fan).cast("int") if parts > 1 else F.lit(0))
    blocks = stacks.select(F.col("lo").alias("x"), (F.col("wy") / F.col("w")).alias("fit")).withColumn("part", part)
    marks = blocks.select("x", F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("w"), "part", "fit", F.lit(0).alias("given"))
    both = rows.select("x", "y", "w", "part", F.lit(None).cast("double").alias("fit"), F.lit(1).alias("given")).unionByName(marks)
    own = F.last("fit", ignorenulls=True).over(Window.partitionBy("part").orderBy("x", "given").rowsBetween(Window.unboundedPreceding, 0))
    ends = rows.select("part").distinct().join(blocks.groupBy("part").agg(F.max_by("fit", "x").alias("end")), "part", "left")
    before = ends.select("part", F.last("end", ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    fitted = both.withColumn("own", own).where("given = 1").join(before, "part", "left")
    return fitted.select("x", "y", "w", F.coalesce("own", "before").alias("fit"))


def step_predict(df: DataFrame, knots: DataFrame, column: str) -> DataFrame:
    """df with `fit` of the first knot (x, fit) at or above the value, the last one beyond all; knots are few."""
    packed = knots.agg(F.sort_array(F.collect_list(F.struct("x", "fit"))).alias("k"))
    joined = df.crossJoin(F.broadcast(packed))
    first = F.get(F.filter("k", lambda k: k["x"] >= F.col(column)), F.lit(0))
    return joined.withColumn("fit", F.coalesce(first["fit"], F.get("k", F.size("k") - 1)["fit"])).drop("k")


def ecdf_rate(groups: DataFrame, critical: DataFrame, exposure: float) -> DataFrame:
    """rate: for each group, the share of its class' critical heights at or below its height, by stratum, weighted over
    strata, times the group's weight, summed over groups and divided by the exposure.

    groups(kind, height, weight), critical(kind, stratum, height, share). The shares at or below are running counts
    over the union of both tables, so no pair of rows is formed.
    """
    strata = critical.select("kind", "stratum", "share").distinct()
    sizes = critical.groupBy("kind", "stratum").agg(F.count("*").alias("size"))
    asked = groups.join(strata, "kind").select("kind", "stratum", "height", F.lit(0).alias("given"), "weight", "share")
    given = critical.select("kind", "stratum", "height", F.lit(1).alias("given"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("share"))
    w = Window.partitionBy("kind", "stratum").orderBy("height", F.desc("given")).rowsBetween(Window.unboundedPreceding, 0)
    seen = asked.unionByName(given).withColumn("below", F.sum("given").over(w)).where("given = 0").join(F.broadcast(sizes), ["kind", "stratum"])
    return seen.agg((F.sum(F.col("weight") * F.col("share") * F.col("below") / F.col("size")) / exposure).alias("rate"))


def fit_conditional(clusters: DataFrame, bins: int, by: list[str] | None = None) -> DataFrame:
    """Monotone P(hit | severity) over quantile bins of clusters(severity, hit): by, bin, lo, hi (edges, null outside),
    n, hits, p, and the Wilson band made monotone around it."""
    by = by or []
    z = 1.959963984540054
    cuts = clusters.groupBy(*by).agg(F.array_distinct(F.percentile("severity", F.array(*(F.lit(k / bins) for k in range(1, bins))))).alias("cuts"))
    joined = clusters.join(F.broadcast(cuts), by) if by else clusters.crossJoin(F.broadcast(cuts))
    binned = joined.withColumn("bin", F.size(F.filter("cuts", lambda e: F.col("severity") >= e)))
    rows = binned.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.first("cuts").alias("cuts"))
    p, n = F.col("hits") / F.col("n"), F.col("n")
    middle, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    rows = rows.withColumns({"raw_p": p, "raw_lo": middle - half, "raw_hi": middle + half})
    packed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("bin", "n", "raw_p", "raw_lo", "raw_hi"))).alias("b"))

    def monotone(c: str):
        """Max-min formula over the few bins of a group."""
        last = F.size("b") - 1

        def mean(i, j):
            part = F.slice("b", i + 1, j - i + 1)
            top = F.aggregate(part, F.lit(0.0), lambda s, r: s + r[c] * r["n"])
            return top / F.aggregate(part, F.lit(0.0), lambda s, r: s + r["n"])

        return F.transform(F.sequence(F.lit(0), last), lambda k: F.array_max(F.transform(F.sequence(F.lit(0), k), lambda i: F.array_min(F.transform(F.sequence(k, last), lambda j: mean(i, j))))))

    fitted = packed.withColumns({"p": monotone("raw_p"), "l": monotone("raw_lo"), "h": monotone("raw_hi")})
    flat = fitted.select(*by, F.explode(F.arrays_zip(F.col("b.bin").alias("bin"), "p", "l", "h")).alias("r")).select(*by, F.col("r.bin").alias("bin"), F.col("r.p").alias("p"), F.least("r.l", "r.p").alias("p_lo"), F.greatest("r.h", "r.p").alias("p_hi"))
    return rows.join(flat, [*by, "bin"]).select(*by, "bin", F.get("cuts", F.col("bin") - 1).alias("lo"), F.get("cuts", F.col("bin")).alias("hi"), "n", "hits", "p", "p_lo", "p_hi")


def tracking_lag(paths: DataFrame, most: int) -> DataFrame:
    """lag (steps) at which rows(k, rate, hazard), numbered by k, correlate best, rate later than hazard for positive
    lags, the smallest lag on ties; and the mean difference. The path is a grid of fixed length."""
    lags = F.explode(F.sequence(F.lit(-most), F.lit(most)))
    left = paths.select(F.col("k"), F.col("hazard").alias("h")).withColumn("lag", lags)
    pairs = left.join(paths.select((F.col("k")).alias("k2"), "rate"), F.col("k2") == F.col("k") + F.col("lag"))
    fit = pairs.groupBy("lag").agg(F.corr("h", "rate").alias("c"), F.count("*").alias("n")).where("n >= 3 and c is not null and not isnan(c)")
    best = fit.agg(F.min_by("lag", F.struct(-F.round("c", 9), F.col("lag"))).alias("lag"))
    return best.crossJoin(paths.agg(F.avg(F.col("rate") - F.col("hazard")).alias("bias")))


def rate_draws(emissions: DataFrame, draws: int, seed: int) -> DataFrame:
    """emissions(series_id, t, n, exposure) with `draws`, Poisson counts over the exposure (array, per second), and their
    95% interval lo, hi. Each row's generator is seeded by its series and time, so draws don't depend on partitions."""
    make = lambda s, at, k, e: np.random.default_rng([seed, zlib.crc32(f"{s}|{at:.6f}".encode())]).poisson(k, draws) / max(e, 1e-9)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = zip(*batch, strict=True)
            # a whole batch of arrays would be hundreds of megabytes
            while part := list(islice(rows, max(1, (1 << 17) // draws))):
                yield pd.Series([make(*r) for r in part])

    out = emissions.withColumn("draws", run("series_id", "t", "n", "exposure"))
    at = lambda q: F.get(F.array_sort("draws"), F.lit(round(q * (draws - 1))))
    return out.withColumns({"lo": at(0.025), "hi": at(0.975)})


def history_counts(crossings: DataFrame, emissions: DataFrame, trailing: float) -> DataFrame:
    """series_id, t, n, severity: how many crossings lie within the last `trailing` seconds of each emission, ends
    included, and the largest severity among them. Both tables are merged by time; no range is joined."""
    asks = emissions.select("series_id", "t", F.lit(None).cast("double").alias("severity"), F.lit(1).alias("asks"))
    both = crossings.select("series_id", "t", "severity", F.lit(0).alias("asks")).unionByName(asks)
    w = Window.partitionBy("series_id").orderBy(F.round(F.col("t") * 1e6).cast("long")).rangeBetween(-round(trailing * 1e6), 0)
    seen = both.withColumns({"n": F.sum(1 - F.col("asks")).over(w), "top": F.max("severity").over(w)})
    return seen.where("asks = 1").select("series_id", "t", "n", F.col("top").alias("severity"))


def integrate_draws(emissions: DataFrame, units: DataFrame, draws: str = "draws") -> DataFrame:
    """series_id, draw, expected: integrate_rate() of every draw of a rate, each emission's array held to the next."""
    w = Window.partitionBy("series_id").orderBy("t")
    joined = emissions.join(units.select("series_id", "record_end"), "series_id")
    span = F.greatest(F.coalesce(F.lead("t").over(w), "record_end") - F.col("t"), F.lit(0.0))
    # The window comes first, by itself: in one projection the rows would be exploded before it
    flat = joined.withColumn("_span", span).select("series_id", F.col("_span").alias("span"), F.posexplode(draws).alias("draw", "rate"))
    return flat.groupBy("series_id", "draw").agg(F.sum(F.col("rate") * F.col("span")).alias("expected"))


def count_capture(expected: DataFrame, drawn: DataFrame, units: DataFrame, by: list[str], absorbing: bool = False) -> DataFrame:
    """by, n, predicted and realized counts, the 95% interval lo, hi of the predicted count over draws, and whether it
    holds the realized one. expected(series_id, expected), drawn(series_id, draw, expected), units(series_id, t_event,
    by). With absorbing, a series counts by the probability of one event or more. Sums of draws are grouped twice,
    so a campaign's rows meet only as one number for each draw."""
    share = -F.expm1(-F.col("expected")) if absorbing else F.col("expected")
    own = units.select("series_id", "t_event", *by)
    point = expected.join(own, "series_id").groupBy(*by).agg(F.count("*").alias("n"), F.sum(share).alias("predicted"), F.count("t_event").alias("realized"))
    totals = drawn.join(own, "series_id").groupBy(*by, "draw").agg(F.sum(share).alias("total"))
    bands = totals.groupBy(*by).agg(F.percentile("total", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select(*by, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    return point.join(bands, by, "left").withColumn("captured", F.col("realized").between(F.col("lo"), F.col("hi")))


def by_parts(df: DataFrame, column: str, parts: int = 3) -> DataFrame:
    """df with `part`, which of `parts` quantile ranges of a column holds the row (from 0); quantiles that coincide
    count once. The quantiles are one row."""
    cuts = F.array_distinct(F.percentile(column, F.array(*(F.lit(k / parts) for k in range(1, parts)))))
    joined = df.crossJoin(F.broadcast(df.agg(cuts.alias("_cuts"))))
    return joined.withColumn("part", F.size(F.filter("_cuts", lambda c: F.col(column) >= c))).drop("_cuts")


def predicted_count(expected: DataFrame, tail: DataFrame, by: list[str], absorbing: bool = False) -> DataFrame:
    """predicted: the number of critical events to expect in all. expected(series_id, expected, by) counts events of
    any severity; of those the share exceedances / n times p_critical of tail_posterior() for `by` is critical. With
    absorbing, a series counts by the probability of one critical event or more. tail has one row per stratum."""
    share = F.col("exceedances") / F.col("n") * F.col("p_critical")
    count = F.col("expected") * F.coalesce("share", F.lit(0.0))
    return expected.join(tail.select(*by, share.alias("share")), by, "left").agg(F.coalesce(F.sum(-F.expm1(-count) if absorbing else count), F.lit(0.0)).alias("predicted"))


def attribution(variants: DataFrame, baseline: str = "baseline") -> DataFrame:
    """variant, predicted, shift and relative shift against the baseline of variants(variant, predicted) (few rows);
    relative is null against 0."""
    base = variants.where(F.col("variant") == baseline).select(F.col("predicted").alias("_b"))
    shift = F.col("predicted") - F.col("_b")
    return variants.crossJoin(F.broadcast(base)).select("variant", "predicted", shift.alias("shift"), F.when(F.col("_b") != 0, shift / F.col("_b")).alias("relative"))
