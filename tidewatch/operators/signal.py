"""Operators over arrays of samples: envelopes, spectra, wave groups, decorrelation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import signal as fn
from tidewatch.operators import events as ev
from tidewatch.operators import scores as sc


def band_power_score(rows: DataFrame, per_period: int, shape: float = 0.55, band: float = 0.2, w: str = "w") -> DataFrame:
    """rows with `band_power` of each window."""
    return rows.withColumn("band_power", fn.array_udf(lambda x: fn.band_power(x, per_period, shape, band), "double")(w))


def envelope_features(rows: DataFrame, w: str = "w") -> DataFrame:
    """rows with mean, standard deviation, maximum and least-squares slope of each window's envelope."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    out = rows.withColumn("_e", fn.array_udf(fn.envelope, "array<double>")(w)).withColumn("_n", F.size("_e").cast("double"))
    out = out.withColumn("env_mean", total(F.col("_e")) / F.col("_n"))
    middle = (F.col("_n") - 1) / 2
    return out.withColumns({
        "env_sd": F.sqrt(total(F.transform("_e", lambda v: (v - F.col("env_mean")) * (v - F.col("env_mean")))) / (F.col("_n") - 1)),
        "env_max": F.array_max("_e"),
        "env_slope": total(F.transform("_e", lambda v, i: v * (i - middle))) / (F.col("_n") * (F.col("_n") * F.col("_n") - 1) / 12),
    }).drop("_e", "_n")


def dominant_period(rows: DataFrame, dt: float, fallback: float, w: str = "w") -> DataFrame:
    """rows with `period`, that of the largest spectral line of each window."""
    return rows.withColumn("period", fn.array_udf(lambda x: fn.dominant_period(x, dt, fallback), "double")(w))


def window_normalize(rows: DataFrame, w: str = "w") -> DataFrame:
    """rows with each window less its own least-squares line, over the standard deviation of what is left (ddof 1)."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    n, middle = F.size(w), (F.size(w) - 1) / 2
    out = rows.withColumns({"_m": total(F.col(w)) / n, "_b": total(F.transform(w, lambda v, i: v * (i - middle))) / (n * (n * n - 1) / 12)})
    out = out.withColumn("_r", F.transform(w, lambda v, i: v - F.col("_m") - F.col("_b") * (i - middle)))
    out = out.withColumn("_s", F.greatest(F.sqrt(total(F.transform("_r", lambda v: v * v)) / (n - 1)), F.lit(1e-12)))
    return out.withColumn(w, F.transform("_r", lambda v: v / F.col("_s"))).drop("_m", "_b", "_r", "_s")


def window_moments(rows: DataFrame, w: str = "w") -> DataFrame:
    """rows with `variance` (ddof 1) of each window and `ac1`, the correlation of its values with those one before; 0
    where either part is constant."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    less_mean = lambda a: F.transform(a, lambda v: v - total(a) / F.size(a))
    dot = lambda a, b: total(F.zip_with(a, b, lambda x, y: x * y))
    n = F.size(w)
    out = rows.withColumns({"_c": less_mean(F.col(w)), "_l": less_mean(F.slice(w, F.lit(1), n - 1)), "_r": less_mean(F.slice(w, F.lit(2), n - 1))})
    out = out.withColumns({"_d": F.sqrt(dot("_l", "_l") * dot("_r", "_r")), "variance": dot("_c", "_c") / (n - 1)})
    return out.withColumn("ac1", F.when(F.col("_d") > 1e-12 * (n - 1), dot("_l", "_r") / F.col("_d")).otherwise(0.0)).drop("_c", "_l", "_r", "_d")


def engineered_features(rows: DataFrame, dt: float, natural: float, radius: float, length: int, vanishing: float, growth: float, eq: float) -> DataFrame:
    """rows with the feature table of each window: variance and autocorrelation, their trends, envelope, period, danger
    at the end point, neighbours, band power and the end point itself. One projection, no join."""
    skip = round(natural / dt)
    out = window_moments(rows)
    out = sc.ews_score(out, "variance", 0.35, 12, length).withColumnRenamed("ews", "variance_trend")
    out = sc.ews_score(out, "ac1", 0.35, 12, length).withColumnRenamed("ews", "ac1_trend")
    out = dominant_period(envelope_features(out), dt, natural)
    out = band_power_score(sc.neighbor_score(out, radius, skip), skip)
    x, dx = F.get("w", F.size("w") - 1), F.get("wdx", F.size("wdx") - 1)
    up = growth * F.greatest(F.lit(vanishing) - (x - eq), F.lit(0.0)) - dx
    down = growth * F.greatest(F.lit(vanishing) + (x - eq), F.lit(0.0)) + dx
    return out.withColumns({"danger": -F.least(up, down), "end_x": F.abs(x), "end_dx": F.abs(dx)})


def decorrelation_time(series: DataFrame, dt: float, x: str = "x") -> DataFrame:
    """series_id, decorrelation: seconds until the envelope of the autocorrelation falls to 0.05."""
    return series.select("series_id", fn.array_udf(lambda a: fn.decorrelation_time(a, dt), "double")(x).alias("decorrelation"))


def decorrelation_by_method(scores: DataFrame, dt: float, fallback: float = 10.0) -> DataFrame:
    """method and the median decorrelation time of its series of four scores or more, fallback without any."""
    packed = scores.groupBy("method", "series_id").agg(F.sort_array(F.collect_list(F.struct("t", "score"))).alias("s")).withColumn("x", F.col("s.score"))
    timed = packed.withColumn("d", F.when(F.size("x") >= 4, fn.array_udf(lambda a: fn.decorrelation_time(a, dt), "double")("x")))
    return timed.groupBy("method").agg(F.coalesce(F.percentile("d", F.lit(0.5)), F.lit(fallback)).alias("decorrelation"))


def wave_groups(series: DataFrame, level: float, least: float, dt: float) -> DataFrame:
    """Runs of at least `least` seconds in which the envelope height (twice the envelope) reaches level: series_id, lo,
    hi, height."""
    high = series.select("series_id", F.posexplode(fn.array_udf(fn.envelope, "array<double>")("x")).alias("i", "e")).select("series_id", "i", (F.col("i") * dt).alias("t"), (2 * F.col("e")).alias("x"))
    runs = ev.runs_above(high.withColumn("x", F.when(F.col("x") >= level, F.col("x")).otherwise(float("-inf"))), float("-inf"), 0.0)
    return runs.where((F.col("i_end") - F.col("i_start") + 1) * dt >= least).select("series_id", F.col("t_start").alias("lo"), (F.col("t_end") + dt).alias("hi"), F.col("top").alias("height"))


def _median(a):
    """Median of an array column."""
    s = F.array_sort(a)
    return (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2


def _steps(a):
    """Differences of neighbours of an array column."""
    return F.zip_with(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), lambda y, x: y - x)


def describe_groups(series: DataFrame, dt: float, significant: float, period: float, share: float = 0.75, periods: float = 1.5, ordinates: int = 9) -> DataFrame:
    """Wave groups of series(series_id, x): series_id, i_start, i_end, i_top, carrier_period, height, cycles and shape.

    A group is a run of samples whose envelope height (twice the envelope) reaches `share` of the significant height,
    runs at most one peak period apart being one; it lasts `periods` peak periods or more. The carrier period is the
    median time between whole turns of the phase, in its prevailing direction, or, with fewer than two turns, that of
    its mean speed. Groups of half a cycle or less, and those whose phase doesn't advance, are left out. shape holds
    the height over its maximum at `ordinates` evenly spaced places. Series of fewer than three samples have no group.
    """
    from pyspark.sql import Window

    wave = series.where(F.size("x") >= 3).select("series_id", F.transform(fn.array_udf(fn.envelope, "array<double>")("x"), lambda v: 2 * v).alias("h"), fn.array_udf(fn.turns, "array<double>")("x").alias("p"))
    w = Window.partitionBy("series_id").orderBy("i")
    high = wave.select("series_id", F.posexplode("h").alias("i", "v")).where(F.col("v") >= share * significant)
    begins = F.coalesce(F.col("i") - F.lag("i").over(w) - 1 > round(period / dt), F.lit(True))
    runs = high.withColumn("begins", begins.cast("int")).withColumn("g", F.sum("begins").over(w)).groupBy("series_id", "g").agg(F.min("i").alias("i_start"), F.max("i").alias("i_end"))
    n = F.col("i_end") - F.col("i_start") + 1
    own = runs.where(n * dt >= periods * period).join(wave, "series_id").select("series_id", "i_start", "i_end", F.slice("h", F.col("i_start") + 1, n).alias("h"), F.slice("p", F.col("i_start") + 1, n).alias("p"))
    own = own.withColumn("p", F.when(_median(_steps(F.col("p"))) < 0, F.transform("p", lambda v: -v)).otherwise(F.col("p")))
    pairs = F.arrays_zip(F.slice("p", F.lit(1), n - 1).alias("a"), F.slice("p", F.lit(2), n - 1).alias("b"))
    passed = F.transform(pairs, lambda s, k: F.when(F.floor(s["b"]) > F.floor(s["a"]), (k + (F.floor(s["a"]) + 1 - s["a"]) / (s["b"] - s["a"])) * dt))
    own = own.withColumn("at", F.filter(passed, lambda t: t.isNotNull()))
    span = F.get("p", n - 1) - F.get("p", F.lit(0))
    carrier = F.when(F.size("at") >= 2, _median(_steps(F.col("at")))).when(span > 0, (n - 1) * dt / span)
    top = F.array_max("h")

    def ordinate(k):
        place = k * (n - 1) / F.lit(float(max(ordinates - 1, 1)))
        below = F.floor(place).cast("int")
        lower = F.get("h", below)
        return (lower + (place - below) * (F.coalesce(F.get("h", below + 1), lower) - lower)) / F.col("height")

    out = own.withColumns({"carrier_period": carrier, "height": top, "i_top": (F.col("i_start") + F.array_position("h", top) - 1).cast("int")})
    out = out.withColumn("cycles", n * dt / F.col("carrier_period")).where("cycles > 0.5")
    return out.select("series_id", "i_start", "i_end", "i_top", "carrier_period", "height", "cycles", F.transform(F.sequence(F.lit(0), F.lit(ordinates - 1)), ordinate).alias("shape"))


def ensemble_acf(series: DataFrame, lags: list[int], x: str = "x") -> DataFrame:
    """lag and the mean over series of the biased autocorrelation at it."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    base = series.withColumn("_m", total(F.col(x)) / F.size(x)).withColumn("_c", F.transform(x, lambda v: v - F.col("_m"))).withColumn("_v", total(F.transform("_c", lambda v: v * v)))
    rows = base.select("_c", "_v", F.explode(F.array(*(F.lit(k) for k in lags))).alias("lag")).where(F.size("_c") > F.col("lag"))
    n = F.size("_c") - F.col("lag")
    r = total(F.zip_with(F.slice("_c", F.lit(1), n), F.slice("_c", F.col("lag") + 1, n), lambda a, b: a * b)) / F.col("_v")
    return rows.where("_v > 0").groupBy("lag").agg(F.avg(r).alias("acf"), F.count("*").alias("n"))


def crossing_rates(series: DataFrame, dt: float, by: list[str] | None = None) -> DataFrame:
    """Mean crossing rates of series' means: from the spectral moments, and as counted."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    m = fn.array_udf(lambda a: fn.spectral_moments(a, dt), "array<double>")
    base = series.withColumns({"m": m("x"), "mu": total(F.col("x")) / F.size("x")})
    ups = F.size(F.filter(F.zip_with(F.slice("x", F.lit(1), F.size("x") - 1), F.slice("x", F.lit(2), F.size("x") - 1), lambda a, b: (a < F.col("mu")) & (b >= F.col("mu"))), lambda u: u))
    rows = base.where("m[0] > 0").select(*(by or []), (F.sqrt(F.col("m")[1] / F.col("m")[0]) / 6.283185307179586).alias("e"), (ups / (F.size("x") * dt)).alias("c"))
    return rows.groupBy(*(by or [])).agg(F.avg("e").alias("expected_rate"), F.avg("c").alias("counted_rate"), F.count("*").alias("n"))


def step_jump(samples: DataFrame, t0: float) -> DataFrame:
    """series_id, jump: the first value at or after t0 less the last before it; null where one is missing."""
    first = F.min_by("x", F.when(F.col("t") >= t0, F.col("i")))
    last = F.max_by("x", F.when(F.col("t") < t0, F.col("i")))
    return samples.groupBy("series_id").agg((first - last).alias("jump"))


def acf_error(curve: DataFrame, reference: DataFrame) -> DataFrame:
    """largest and rmse: the largest and the root mean square difference of two tables of (lag, acf)."""
    both = curve.select("lag", "acf").join(reference.select("lag", F.col("acf").alias("r")), "lag")
    return both.agg(F.max(F.abs(F.col("acf") - F.col("r"))).alias("largest"), F.sqrt(F.avg((F.col("acf") - F.col("r")) ** 2)).alias("rmse"))


def spectral_distortion(original: DataFrame, composite: DataFrame, dt: float, period: float) -> DataFrame:
    """series_id, distortion: energy above 2.5 / period that a record gained, as a share of the composite's variance.
    Both tables hold arrays x of equal length; others are an error. One Arrow batch of arrays at a time."""

    @F.pandas_udf("double")
    def added(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            if len(x) != len(y):
                raise ValueError("records of unequal length")
            power = [np.abs(np.fft.rfft(v - v.mean())) ** 2 for v in (np.asarray(x, np.float64), np.asarray(y, np.float64))]
            high = np.fft.rfftfreq(len(x), dt) > 2.5 / period
            total = power[1].sum()
            out.append(max(0.0, float((power[1][high] - power[0][high]).sum())) / total if total > 0 else 0.0)
        return pd.Series(out)

    both = original.select("series_id", F.col("x").alias("a")).join(composite.select("series_id", F.col("x").alias("b")), "series_id")
    return both.select("series_id", added("a", "b").alias("distortion"))


def step_stats(samples: DataFrame, t0: float, half: float, level: float) -> DataFrame:
    """series_id, side (before or after t0, within half), n, variance and up-crossings of a level."""
    from pyspark.sql import Window

    near = samples.where((F.col("t") >= t0 - half) & (F.col("t") < t0 + half)).withColumn("side", F.when(F.col("t") < t0, "before").otherwise("after"))
    up = (F.lag("x").over(Window.partitionBy("series_id", "side").orderBy("i")) < level) & (F.col("x") >= level)
    return near.withColumn("up", F.coalesce(up.cast("int"), F.lit(0))).groupBy("series_id", "side").agg(F.count("*").alias("n"), F.var_samp("x").alias("variance"), F.sum("up").alias("n_up"))
