"""Alarm metrics, operating curves, ranking and calibration measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.sweep import sweep
from tidewatch.operators.events import episodes, merge_episodes
from tidewatch.operators.resampling import proportion_bounds, shuffle_tasks


def _at_risk(scores: DataFrame, units: DataFrame, keys: list[str], debounce: int, horizon: float, more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Per key and series: exposure, observability and opportunities; and the scores at risk, with the columns `more` of the former.

    What a series' scores say of it as a whole is told to each of them by a window in order of time, so that scores aren't
    joined with their own sums; both results come from that window.
    """
    own = [*keys, "series_id"]
    w = Window.partitionBy(*own).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = F.coalesce((F.col("t") < F.col("t_event")) & (F.col("t") >= F.col("t_event") - horizon), F.lit(False))

    def judged(rows: DataFrame) -> DataFrame:
        """rows(record_start, record_end, t_event, opening, near) with what follows from these; an opening judged before stays."""
        out = rows.withColumn("opening", F.greatest(F.col("record_start"), F.coalesce("opening", F.lit(float("inf")))))
        out = out.withColumn("observable", F.coalesce((F.col("t_event") > F.col("opening")) & F.col("near"), F.lit(False)))
        end = F.when(F.coalesce(F.col("t_event") <= F.col("opening"), F.lit(False)), F.col("record_start")).otherwise(F.least(F.col("record_end"), F.when(F.col("observable"), F.col("t_event"))))
        return out.withColumn("event_end", end)

    recorded = scores.join(units, "series_id").where("t >= record_start and t <= record_end")
    seen = recorded.withColumns({"opening": F.nth_value("t", debounce).over(w), "near": F.max(near).over(w)})
    at_risk = F.expr("event_end > record_start and t <= event_end")
    sums = judged(seen).groupBy(*own).agg(F.max("opening").alias("opening"), F.max("near").alias("near"), F.count_if(at_risk).alias("opportunities"))
    every = scores.select(*keys).distinct().join(units) if keys else units
    base = judged(every.join(sums, own, "left")).withColumn("exposure", F.greatest(F.lit(0.0), F.col("event_end") - F.col("record_start")))
    risk = judged(seen).where(at_risk).select(*own, "t", "score", *more)
    return base, risk


def contributions(scores: DataFrame, units: DataFrame, threshold, debounce: int, refractory: int, horizon: float, gap: float, keys: list[str] | None = None) -> DataFrame:
    """Per keys and series: exposure, opportunities, observable (0/1), detected (0/1), false_episodes, lead.

    keys are columns of scores that tell methods or thresholds apart. An episode is associated with an observable
    event if it starts before the event and ends no earlier than horizon before it; all others are false.
    """
    keys = keys or []
    base, risk = _at_risk(scores, units, keys, debounce, horizon)
    own = [*keys, "series_id"]
    found = merge_episodes(episodes(risk, threshold, debounce, refractory, own), gap, own)
    held = base.join(found.select(*own, "t_start", "t_end", F.lit(True).alias("found")), own, "left")
    associated = F.coalesce(F.col("observable") & (F.col("t_start") < F.col("t_event")) & (F.col("t_end") >= F.col("t_event") - horizon), F.lit(False))
    same = ("stratum", "exposure", "opportunities", "observable")
    out = held.withColumn("associated", associated).groupBy(*own).agg(*(F.first(c).alias(c) for c in same), F.count_if(F.col("found") & ~F.col("associated")).alias("false_episodes"), F.max(F.col("associated").cast("int")).alias("detected"), F.max(F.when(F.col("associated"), F.col("t_event") - F.col("t_start"))).alias("lead"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(*own, "stratum", "exposure", zero("opportunities"), F.col("observable").cast("long").alias("observable"), zero("detected"), zero("false_episodes"), "lead")


def _alarm_rates(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Rates of exposure_hours, opportunities, events, detected, false_episodes and q (quantiles of the lead)."""
    z = 1.959963984540054
    n, p = F.col("events"), F.col("detected") / F.col("events")
    middle, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return sums.select(*keys, "exposure_hours", "opportunities", "events", "detected", "false_episodes", F.when(n > 0, p).otherwise(0.0).alias("sensitivity"), F.when(n > 0, middle - half).alias("sensitivity_lo"), F.when(n > 0, middle + half).alias("sensitivity_hi"), F.when(F.col("exposure_hours") > 0, F.col("false_episodes") / F.col("exposure_hours")).otherwise(0.0).alias("false_per_hour"), F.col("q")[0].alias("lead_q10"), F.col("q")[1].alias("lead_q50"), F.col("q")[2].alias("lead_q90"))


_LEADS = "percentile(lead, array(0.1D, 0.5D, 0.9D))"


def alarm_metrics(contribution: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sums and rates of contributions(), with median lead and a Wilson interval of the sensitivity."""
    grouped = contribution.groupBy(*(keys or []))
    out = grouped.agg((F.sum("exposure") / 3600.0).alias("exposure_hours"), F.sum("opportunities").alias("opportunities"), F.sum("observable").alias("events"), F.sum("detected").alias("detected"), F.sum("false_episodes").alias("false_episodes"), F.expr(_LEADS).alias("q"))
    return _alarm_rates(out, keys or [])


def threshold_grid(scores: DataFrame, n: int = 41, extra: dict[str, float] | None = None) -> DataFrame:
    """method, threshold: n linear-interpolation quantiles of each method's finite scores, and the least double; extra
    thresholds of single methods, such as -50 of the neighbour score, are added."""
    steps = F.array(*(F.lit(k / (n - 1)) for k in range(n)))
    finite = scores.where("not isnan(score) and abs(score) < double('infinity')").groupBy("method").agg(F.percentile("score", steps).alias("q"))
    out = finite.select("method", F.explode(F.concat("q", F.array(F.lit(-1.7976931348623157e308)))).alias("threshold"))
    for method, value in (extra or {}).items():
        out = out.unionByName(finite.where(F.col("method") == method).select("method", F.lit(float(value)).alias("threshold")))
    return out.distinct()


def sweep_episodes(scores: DataFrame, grid: DataFrame, debounce: int, refractory: int, gap: float, kept: list[str] | None = None) -> DataFrame:
    """Merged alarm episodes of scores(method, series_id, t, score) at every threshold of grid(method, threshold): method,
    threshold, series_id, t_start, t_end, and the columns `kept` of scores, which are constant in a series.

    Only how many of its method's thresholds each sample reaches is shuffled, once, by series; a pass over the series in
    order of time then holds the open run and episode of each threshold. No sample becomes a row for each threshold.
    The number of tasks is set here, since Spark would take it from the few bytes that the samples have.
    """
    kept = kept or []
    levels = F.broadcast(grid.groupBy("method").agg(F.array_sort(F.collect_set("threshold")).alias("levels")))
    level = F.size(F.filter("levels", lambda v: v <= F.col("score")))
    rows = scores.join(levels, "method").select("method", "series_id", F.col("t").cast("double").alias("t"), level.alias("level"), F.size("levels").alias("of"), *kept)
    own = ["method", "series_id"]
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in own), "j int, t_start double, t_end double", *(f"`{c}` {fields[c]}" for c in kept)])
    ordered = rows.repartition(shuffle_tasks(scores), *own).sortWithinPartitions(*own, "t")
    found = ordered.mapInPandas(lambda batches: sweep(batches, own, kept, debounce, refractory, gap), schema)
    each = levels.select("method", F.posexplode("levels").alias("j", "threshold")).withColumn("j", F.col("j") + 1)
    return found.join(F.broadcast(each), ["method", "j"]).select("method", "threshold", "series_id", "t_start", "t_end", *kept)


def operating_curve(scores: DataFrame, units: DataFrame, grid: DataFrame, debounce: int, refractory: int, horizon: float, gap: float) -> DataFrame:
    """alarm_metrics() for every threshold of each method. What doesn't depend on the threshold (exposure, opportunities,
    events) is summed once for a method; episodes of all thresholds come from one sweep."""
    base, risk = _at_risk(scores.select("method", "series_id", "t", "score"), units, ["method"], debounce, horizon, ("observable", "t_event"))
    whole = base.groupBy("method").agg((F.sum("exposure") / 3600.0).alias("exposure_hours"), F.sum(F.col("observable").cast("long")).alias("events"), F.sum("opportunities").alias("opportunities"))
    held = sweep_episodes(risk, grid, debounce, refractory, gap, ["observable", "t_event"])
    associated = F.coalesce(F.col("observable") & (F.col("t_start") < F.col("t_event")) & (F.col("t_end") >= F.col("t_event") - horizon), F.lit(False))
    each = held.withColumn("a", associated).groupBy("method", "threshold", "series_id").agg(F.sum((~F.col("a")).cast("long")).alias("false_episodes"), F.max(F.col("a").cast("long")).alias("detected"), F.max(F.when(F.col("a"), F.col("t_event") - F.col("t_start"))).alias("lead"))
    sums = each.groupBy("method", "threshold").agg(F.sum("detected").alias("detected"), F.sum("false_episodes").alias("false_episodes"), F.expr(_LEADS).alias("q"))
    out = grid.select("method", "threshold").distinct().join(whole, "method").join(sums, ["method", "threshold"], "left")
    return _alarm_rates(out.fillna(0, ["opportunities", "detected", "false_episodes"]), ["method", "threshold"])


def matched_point(curve: DataFrame, least: float = 0.9) -> DataFrame:
    """Each method's point of lowest false rate among those of sensitivity `least` or more, else that of highest
    sensitivity; rates count as equal to nine places, and the smaller threshold wins ties."""
    good = F.col("sensitivity") >= least
    order = Window.partitionBy("method").orderBy(F.desc(good.cast("int")), F.round(F.when(good, F.col("false_per_hour")).otherwise(-F.col("sensitivity")), 9), "threshold")
    return curve.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def window_labels(scores: DataFrame, units: DataFrame, horizon: float, buffer: float) -> DataFrame:
    """method, series_id, t, score, label: horizon-complete positives and unambiguous negatives, in record."""
    own = scores.join(units, "series_id").where("t >= record_start and t <= record_end and not isnan(score) and abs(score) < double('infinity')").withColumn("lead", F.col("t_event") - F.col("t"))
    keep = F.col("t_event").isNull() | ((F.col("lead") > 0) & (F.col("lead") <= horizon)) | (F.col("lead") > horizon + buffer)
    return own.where(keep).select("method", "series_id", "t", "score", F.coalesce(((F.col("lead") > 0) & (F.col("lead") <= horizon)).cast("int"), F.lit(0)).alias("label"))


def auc(df: DataFrame, by: list[str] | None = None, label: str = "label", score: str = "score", weight: str | None = None) -> DataFrame:
    """Mann-Whitney AUC with half credit for ties, per group; null with one class only. Rows are first summed by
    distinct score, so only distinct scores are ordered: each group by itself, or, without groups, by 200 ranges of
    scores, whose totals are then added up."""
    by = by or []
    w = F.col(weight) if weight else F.lit(1.0)
    sums = df.groupBy(*by, F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col(label) == 0, w).otherwise(0.0)).alias("neg"))
    earlier = lambda *parts: Window.partitionBy(*parts).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    if by:
        sums = sums.withColumn("below", F.coalesce(F.sum("neg").over(earlier(*by)), F.lit(0.0)))
    else:
        cuts = df.agg(F.percentile_approx(score, [k / 200 for k in range(1, 200)], 1000)).first()[0] or []
        sums = sums.withColumn("range", F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)), lambda c: c <= F.col("s"))) if cuts else F.lit(0))
        totals = sums.groupBy("range").agg(F.sum("neg").alias("neg"))
        before = totals.select("range", F.coalesce(F.sum("neg").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
        inside = F.coalesce(F.sum("neg").over(earlier("range")), F.lit(0.0))
        sums = sums.withColumn("inside", inside).join(F.broadcast(before), "range").withColumn("below", F.col("inside") + F.col("before"))
    out = sums.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return out.select(*by, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))).alias("auc"))


def folded_auc(df: DataFrame, by: list[str] | None = None, label: str = "label", score: str = "score") -> DataFrame:
    """by, auc: the larger of auc() and its complement, for scores whose direction isn't known."""
    return auc(df, by, label, score).withColumn("auc", F.greatest("auc", 1 - F.col("auc")))


def calibration_bins(df: DataFrame, label: str = "label", p: str = "p", weight: str = "w") -> DataFrame:
    """Ten equal bins of probability: bin, n, weight, predicted, observed (weighted means)."""
    rows = df.select(F.least(F.floor(F.col(p) * 10), F.lit(9)).cast("int").alias("bin"), F.col(p).alias("p"), F.col(label).alias("y"), F.col(weight).alias("w"))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.sum("w").alias("weight"), (F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("predicted"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("observed"))


def calibration(df: DataFrame, label: str = "label", p: str = "p", weight: str = "w") -> DataFrame:
    """Weighted Brier score and ten-bin expected calibration error."""
    brier = df.agg((F.sum(F.col(weight) * (F.col(p) - F.col(label)) ** 2) / F.sum(weight)).alias("brier"))
    ece = calibration_bins(df, label, p, weight).agg((F.sum(F.col("weight") * F.abs(F.col("predicted") - F.col("observed"))) / F.sum("weight")).alias("ece"))
    return brier.crossJoin(ece)


def rolling_coverage(bounded: DataFrame, k: int = 6) -> DataFrame:
    """t, coverage: share of rows(t, miss) without a miss over the last k times, fewer at the start."""
    w = Window.orderBy("t").rowsBetween(-(k - 1), 0)
    by_time = bounded.groupBy("t").agg(F.sum("miss").alias("m"), F.count("*").alias("n"))
    return by_time.select("t", (1 - F.sum("m").over(w) / F.sum("n").over(w)).alias("coverage"))


def recovery_time(curve: DataFrame, t0: float, target: float, tolerance: float, points: int = 3) -> DataFrame:
    """recovery: time from t0 to the first time at or after it from which all coverages stay within tolerance of the
    target, with `points` times left at least; null if there is none."""
    after = Window.orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    ok = (F.abs(F.col("coverage") - target) <= tolerance).cast("int")
    held = curve.withColumn("ok", ok).withColumns({"all_ok": F.min("ok").over(after), "left": F.count("*").over(after)})
    return held.where((F.col("all_ok") == 1) & (F.col("left") >= points) & (F.col("t") >= t0)).agg((F.min("t") - t0).alias("recovery"))


def describe5(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean, minimum, quartiles and maximum; nulls for an empty table."""
    out = df.groupBy(*(by or [])).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.expr(f"percentile({column}, array(0D, 0.25D, 0.5D, 0.75D, 1D))").alias("q"))
    return out.select(*(by or []), "n", "mean", *(F.col("q")[i].alias(c) for i, c in enumerate(("low", "q25", "q50", "q75", "high"))))


def _beside(metrics: DataFrame, base: str, **columns: str) -> DataFrame:
    """metrics (one row for each method, so few) with columns of the base method's row, none without it; metrics is computed once."""
    whole, own = Window.partitionBy(F.lit(0)), F.col("method") == base
    found = {name: F.max(F.when(own, F.col(c))).over(whole) for name, c in columns.items()}
    return metrics.withColumns({**found, "_base": F.count(F.when(own, 1)).over(whole)}).where("_base > 0").drop("_base")


def compare_methods(metrics: DataFrame, base: str) -> DataFrame:
    """method, reduction: relative fall of the false rate against the base method; null if that is 0."""
    return _beside(metrics, base, b="false_per_hour").select("method", F.when(F.col("b") > 0, 1 - F.col("false_per_hour") / F.col("b")).alias("reduction"))


def compare_guards(metrics: DataFrame, base: str, material: float = 0.1, survival: float = 0.5, most: float = 2.0, times: float = 4.0) -> DataFrame:
    """method, reduction, material, survives and explodes against the base method: whether the false rate falls by the share `material` or more, whether
    the sensitivity keeps the share `survival` of the base's, and whether the false rate is over `most` an hour and
    `times` that of the base. metrics has one row per method (few)."""
    reduction = F.when(F.col("b") > 0, 1 - F.col("false_per_hour") / F.col("b"))
    return _beside(metrics, base, b="false_per_hour", sb="sensitivity").select("method", reduction.alias("reduction"), F.coalesce(reduction >= material, F.lit(False)).alias("material"), (F.col("sensitivity") >= survival * F.col("sb")).alias("survives"), ((F.col("false_per_hour") > most) & (F.col("false_per_hour") > times * F.col("b"))).alias("explodes"))


def coverage_cells(bounded: DataFrame, by: list[str], alpha: str = "alpha", confidence: float = 0.95) -> DataFrame:
    """by, alpha, n, covered, coverage, its exact interval lo and hi, and error (coverage less 1 - alpha), for rows
    with `miss` (0 or 1). by tells cells apart: family, horizon, model."""
    keys = [*by, alpha]
    cells = bounded.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(1 - F.col("miss")).alias("covered"))
    lo, hi = proportion_bounds("covered", "n", confidence)
    coverage = F.col("covered") / F.col("n")
    return cells.select(*keys, "n", "covered", coverage.alias("coverage"), lo.alias("lo"), hi.alias("hi"), (coverage - (1 - F.col(alpha))).alias("error"))


def coverage_errors(cells: DataFrame, by: list[str], within: list[str] | None = None) -> DataFrame:
    """within, cells, mean_error and max_error of coverage_cells() in absolute value, and the columns `by` of the worst
    cell as worst_*, ties (to nine places) to the smaller key."""
    worst = F.max_by(F.struct(*by), F.struct(F.round(F.abs("error"), 9), *(-F.col(c) for c in by)))
    out = cells.groupBy(*(within or [])).agg(F.count("*").alias("cells"), F.avg(F.abs("error")).alias("mean_error"), F.max(F.abs("error")).alias("max_error"), worst.alias("worst"))
    return out.select(*(within or []), "cells", "mean_error", "max_error", *(F.col(f"worst.{c}").alias(f"worst_{c}") for c in by))
