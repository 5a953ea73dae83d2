"""Scores of windows and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def summary_features(rows: DataFrame, w: str = "w", wdx: str = "wdx") -> DataFrame:
    """Largest |x| over the last twelfth, quarter, half and whole window, RMS of x and dx, largest |dx|, last - first."""
    n = F.size(w)
    tops = {f"top_{d}": F.array_max(F.transform(F.slice(w, n - F.greatest(F.lit(1), F.floor(n / d)).cast("int") + 1, F.greatest(F.lit(1), F.floor(n / d)).cast("int")), F.abs)) for d in (12, 4, 2, 1)}
    rms = lambda c: F.sqrt(_sum(F.transform(c, lambda v: v * v)) / n)
    return rows.withColumns(tops | {"rms_x": rms(w), "rms_dx": rms(wdx), "top_dx": F.array_max(F.transform(wdx, F.abs)), "change": F.get(w, n - 1) - F.get(w, F.lit(0))})


def ews_score(rows: DataFrame, stat: str = "variance", part: float = 0.5, ends: int = 12, length: int | None = None, w: str = "w") -> DataFrame:
    """rows with `ews`: Kendall's tau-b of the rolling variance (or lag-1 autocorrelation) against position, at `ends`
    evenly spaced sub-windows of `part` of a window of `length` samples. Not finite counts as 0."""
    if length is None or stat not in ("variance", "ac1"):
        raise ValueError("length and a statistic of variance or ac1 are needed")
    width = max(3, round(length * part))
    stops = sorted({int(width + (length - width) * k / (ends - 1)) for k in range(ends)})
    mean = lambda a: _sum(a) / F.size(a)

    def one(stop: int) -> Column:
        own = F.slice(w, stop - width + 1, width)
        if stat == "variance":
            return F.aggregate(own, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s")), lambda a, v: F.struct((a["n"] + 1).alias("n"), (a["m"] + (v - a["m"]) / (a["n"] + 1)).alias("m"), (a["s"] + (v - a["m"]) * (v - a["m"]) * a["n"] / (a["n"] + 1)).alias("s")), lambda a: a["s"] / (a["n"] - 1))
        left, right = F.slice(own, 1, width - 1), F.slice(own, 2, width - 1)
        lm, rm = mean(left), mean(right)
        down = F.sqrt((mean(F.transform(left, lambda v: v * v)) - lm * lm) * (mean(F.transform(right, lambda v: v * v)) - rm * rm))
        return F.when(down > 1e-12, (mean(F.zip_with(left, right, lambda a, b: a * b)) - lm * rm) / down).otherwise(0.0)

    marked = rows.withColumn("_v", F.array(*(one(s) for s in stops)))
    pairs = [(i, j) for i in range(len(stops)) for j in range(i + 1, len(stops))]

    def sign(a: Column, b: Column) -> Column:
        """Of b - a; values that differ by the rounding of their sums only are equal."""
        return F.when(F.abs(b - a) <= 1e-10 * (F.abs(a) + F.abs(b)), 0.0).otherwise(F.signum(b - a))

    signs = F.array(*(sign(F.col("_v")[i], F.col("_v")[j]) for i, j in pairs))
    marked = marked.withColumn("_s", signs)
    total = float(len(pairs))
    untied = _sum(F.transform("_s", F.abs))
    return marked.withColumn("ews", F.when(untied > 0, _sum(F.col("_s")) / F.sqrt(F.lit(total) * untied)).otherwise(0.0)).drop("_v", "_s")


def neighbor_score(rows: DataFrame, radius: float, skip: int, w: str = "w", wdx: str = "wdx") -> DataFrame:
    """rows with `neighbor`: less the number of points of the window, its last `skip` left out, within radius of its
    last point in (x, dx)."""
    n = F.size(w)
    near = F.filter(F.zip_with(F.slice(w, F.lit(1), n - skip), F.slice(wdx, F.lit(1), n - skip), lambda a, b: F.sqrt((a - F.get(w, n - 1)) ** 2 + (b - F.get(wdx, n - 1)) ** 2)), lambda d: d <= radius)
    return rows.withColumn("neighbor", -F.size(near).cast("double"))


def danger_score(samples: DataFrame, vanishing: float, growth: float, eq: float) -> DataFrame:
    """series_id, i, t, margin and danger (= -margin): the smaller of both sides' growth * distance left, less the
    outward rate."""
    up = growth * F.greatest(F.lit(vanishing) - (F.col("x") - eq), F.lit(0.0)) - F.col("dx")
    down = growth * F.greatest(F.lit(vanishing) + (F.col("x") - eq), F.lit(0.0)) + F.col("dx")
    return samples.select("series_id", "i", "t", F.least(up, down).alias("margin")).withColumn("danger", -F.col("margin"))


def margin_dynamics(margins: DataFrame, k: int) -> DataFrame:
    """Closure (fall of the margin over the last k samples per second) and time to closure where it closes."""
    w = Window.partitionBy("series_id").orderBy("i")
    rate = (F.col("margin") - F.lag("margin", k).over(w)) / (F.col("t") - F.lag("t", k).over(w))
    out = margins.withColumn("closure", -rate)
    return out.select("series_id", "i", "closure", F.when(F.col("closure") > 0, F.col("margin") / F.col("closure")).alias("time_to_closure"))


def clock_score(rows: DataFrame, units: DataFrame) -> DataFrame:
    """series_id, t and the quarter (0 to 3) of the record that t lies in: a score that knows the clock only."""
    own = rows.join(units.select("series_id", "record_start", "record_end"), "series_id")
    span = F.nullif(F.col("record_end") - F.col("record_start"), F.lit(0.0))
    return own.select("series_id", "t", F.least(F.floor(4 * (F.col("t") - F.col("record_start")) / span), F.lit(3)).cast("int").alias("quarter"))


def trailing_rms(samples: DataFrame, span: float) -> DataFrame:
    """series_id, i, rms of x over the last span seconds, the sample included."""
    w = Window.partitionBy("series_id").orderBy("m").rangeBetween(-round(span * 1e6), 0)
    return samples.withColumn("m", F.round(F.col("t") * 1e6).cast("long")).select("series_id", "i", F.sqrt(F.avg(F.col("x") * F.col("x")).over(w)).alias("rms"))


def local_moment(samples: DataFrame, width: int) -> DataFrame:
    """series_id, i, the mean of the last `width` values and its backward difference."""
    w = Window.partitionBy("series_id").orderBy("i")
    out = samples.withColumn("moment", F.avg("x").over(w.rowsBetween(-(width - 1), 0)))
    return out.select("series_id", "i", "moment", (F.col("moment") - F.lag("moment").over(w)).alias("change"))


def period_scale(samples: DataFrame, level: float, trailing: float | None = None) -> DataFrame:
    """series_id, i, period: mean spacing of the up-crossings of a level so far, or in the last `trailing` seconds;
    null before the second."""
    w = Window.partitionBy("series_id").orderBy("i")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    if trailing is not None:
        so_far = Window.partitionBy("series_id").orderBy(F.round(F.col("t") * 1e6).cast("long")).rangeBetween(-round(trailing * 1e6), 0)
    at = F.when((F.col("px") < level) & (F.col("x") >= level), F.col("t"))
    marked = samples.withColumn("px", F.lag("x").over(w)).withColumn("c", at)
    n = F.count("c").over(so_far)
    return marked.select("series_id", "i", F.when(n > 1, (F.max("c").over(so_far) - F.min("c").over(so_far)) / (n - 1)).alias("period"))


def alarm_score(bounds: DataFrame, level: float) -> DataFrame:
    """rows with score = bound / (0.6 level); infinities become the largest doubles, NaN is an error."""
    top = 1.7976931348623157e308
    b = F.col("bound") / (0.6 * level)
    score = F.when(F.isnan(F.col("bound")), F.raise_error(F.lit("a bound is not a number")).cast("double")).when(b == float("inf"), top).when(b == float("-inf"), -top).otherwise(b)
    return bounds.withColumn("score", score)
