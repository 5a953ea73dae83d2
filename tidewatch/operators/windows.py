"""Past-only windows, labels against later events, and normalisers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def to_series(samples: DataFrame) -> DataFrame:
    """One row per series with arrays i, t, x, dx in order of i."""
    packed = samples.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("i", "t", "x", "dx"))).alias("s"))
    return packed.select("series_id", *(F.col(f"s.{c}").alias(c) for c in ("i", "t", "x", "dx")))


def to_samples(series: DataFrame) -> DataFrame:
    """Arrays t, x, dx as one row per sample, ending before the first sample that isn't finite. No shuffle."""
    good = F.transform("x", lambda v: ~F.isnan(v) & v.isNotNull() & (F.abs(v) < float("inf")))
    bad = F.array_position(good, F.lit(False))
    n = F.when(bad > 0, (bad - 1).cast("int")).otherwise(F.size("x"))
    return series.select("series_id", F.posexplode(F.slice(F.arrays_zip("t", "x", "dx"), F.lit(1), n)).alias("i", "s")).select("series_id", "i", "s.t", "s.x", "s.dx")


def windows(series: DataFrame, length: int, stride: int) -> DataFrame:
    """Windows of `length` samples that end at every stride-th sample: series_id, i_end, t_end, w, wdx. No shuffle."""
    long_enough = series.where(F.size("x") >= length)
    ends = F.sequence(F.lit(length - 1), F.size("x") - 1, F.lit(stride))
    out = long_enough.select("series_id", "t", "x", "dx", F.explode(ends).alias("i_end"))
    return out.select("series_id", "i_end", F.get("t", F.col("i_end")).alias("t_end"), F.slice("x", F.col("i_end") - length + 2, F.lit(length)).alias("w"), F.slice("dx", F.col("i_end") - length + 2, F.lit(length)).alias("wdx"))


def label_windows(ends: DataFrame, units: DataFrame, horizon: float, buffer: float, censored: bool = False) -> DataFrame:
    """Rows with t_end, labelled: 1 if the event is at most horizon ahead, dropped if it is no more than buffer beyond
    that, else 0. Windows end at the event; those whose horizon the record doesn't hold are dropped, or, with
    censored, kept with a null label."""
    own = ends.join(units.select("series_id", "record_end", "t_event"), "series_id").withColumn("lead", F.col("t_event") - F.col("t_end"))
    own = own.where("t_event is null or lead > 0").where((F.col("lead").isNull()) | (F.col("lead") <= horizon) | (F.col("lead") > horizon + buffer))
    whole = (F.col("lead") <= horizon) | (F.col("t_end") + horizon <= F.col("record_end"))
    label = F.when(F.col("lead") <= horizon, 1).when(F.col("t_end") + horizon <= F.col("record_end"), 0)
    out = own if censored else own.where(F.coalesce(whole, F.col("t_end") + horizon <= F.col("record_end")))
    return out.withColumn("label", label).drop("lead", "record_end", "t_event")


def thin(rows: DataFrame, most: int, order: str = "t_end") -> DataFrame:
    """At most `most` rows of each series, evenly spaced over its rows."""
    w = Window.partitionBy("series_id")
    ranked = rows.withColumns({"_k": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    step = F.greatest(F.lit(most - 1), F.lit(1))
    j = F.ceil(F.col("_k") * step / F.greatest(F.col("_n") - 1, F.lit(1)))
    keep = (F.col("_n") <= most) | ((F.col("_k") == F.floor(j * (F.col("_n") - 1) / step)) & (j < most))
    return ranked.where(keep).drop("_k", "_n")


def causal_normalize(samples: DataFrame, detrend: bool = True, floor: float = 1e-12) -> DataFrame:
    """series_id, i, z: each sample less what a line (or mean) fitted to strictly earlier samples predicts, over their
    standard deviation; the first two are 0. Sums are centred on the series' first value. One window, no self-join."""
    past = Window.partitionBy("series_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    base = samples.withColumn("o", F.first("x").over(Window.partitionBy("series_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    c = base.withColumn("c", F.col("x") - F.col("o")).withColumn("n", F.col("i").cast("double"))
    s = c.withColumns({"s1": F.sum("c").over(past), "s2": F.sum(F.col("c") * F.col("c")).over(past), "si": F.sum(F.col("n") * F.col("c")).over(past)})
    mean = F.col("s1") / F.col("n")
    middle = (F.col("n") - 1) / 2
    slope = (F.col("si") - middle * F.col("s1")) / F.greatest(F.col("n") * (F.col("n") * F.col("n") - 1) / 12, F.lit(floor))
    guess = F.col("o") + mean + (slope * (F.col("n") - middle) if detrend else F.lit(0.0))
    spread = F.greatest(F.sqrt(F.greatest((F.col("s2") - F.col("s1") * mean) / F.greatest(F.col("n") - 1, F.lit(1.0)), F.lit(0.0))), F.lit(floor))
    return s.select("series_id", "i", F.when(F.col("n") < 2, 0.0).otherwise((F.col("x") - guess) / spread).alias("z"))


def record_normalize(samples: DataFrame) -> DataFrame:
    """series_id, i, z over the whole record: deliberately not causal, a control for leakage."""
    w = Window.partitionBy("series_id")
    return samples.select("series_id", "i", F.coalesce((F.col("x") - F.avg("x").over(w)) / F.nullif(F.stddev_samp("x").over(w), F.lit(0.0)), F.lit(0.0)).alias("z"))


def forecast_samples(samples: DataFrame, horizons: list[float], step: int = 1) -> DataFrame:
    """series_id, i, t, horizon, target: the largest |x| within (t, t + horizon] for every step-th sample whose horizon
    ends within the record; 0 if no sample lies in it."""
    micros = F.round(F.col("t") * 1e6).cast("long")
    base = samples.withColumn("m", micros).withColumn("end", F.max("t").over(Window.partitionBy("series_id")))
    out = None
    for h in horizons:
        w = Window.partitionBy("series_id").orderBy("m").rangeBetween(1, round(h * 1e6))
        part = base.withColumn("target", F.coalesce(F.max(F.abs("x")).over(w), F.lit(0.0))).where(F.col("t") + h <= F.col("end"))
        part = part.where(F.col("i") % step == 0).select("series_id", "i", "t", F.lit(float(h)).alias("horizon"), "target")
        out = part if out is None else out.unionByName(part)
    return out


def forecast_histories(samples: DataFrame, units: DataFrame, horizons: list[float], history: int, step: int, level: float, most: int | None = None) -> DataFrame:
    """series_id, i, t, horizon, target as in forecast_samples(), for every step-th sample that ends a whole and finite
    history of so many samples, lies before the event, and whose longest horizon the record holds; the first `most` of
    each series. An event within a horizon raises its target to the level."""
    w = Window.partitionBy("series_id").orderBy("i").rowsBetween(-(history - 1), 0)
    good = F.count_if(~F.isnan("x") & (F.abs("x") < float("inf")) & ~F.isnan("dx") & (F.abs("dx") < float("inf"))).over(w)
    ends = samples.withColumn("good", good).join(units.select("series_id", "t_event", "record_end"), "series_id").where((F.col("good") == history) & ((F.col("i") - (history - 1)) % step == 0) & (F.col("t") + max(horizons) <= F.col("record_end")) & (F.col("t_event").isNull() | (F.col("t") < F.col("t_event"))))
    ends = ends.withColumn("k", F.row_number().over(Window.partitionBy("series_id").orderBy("i")))
    ends = ends.where(F.col("k") <= most) if most else ends
    finite = samples.withColumn("x", F.when(~F.isnan("x") & (F.abs("x") < float("inf")), F.col("x")))
    rows = forecast_samples(finite, horizons).join(ends.select("series_id", "i", "t_event"), ["series_id", "i"])
    inside = (F.col("t_event") > F.col("t")) & (F.col("t_event") - F.col("t") <= F.col("horizon"))
    return rows.select("series_id", "i", "t", "horizon", F.when(inside, F.greatest("target", F.lit(float(level)))).otherwise(F.col("target")).alias("target"))


def snapshot(rows: DataFrame, t: float) -> DataFrame:
    """Each series' first row at or after t."""
    w = Window.partitionBy("series_id").orderBy("t")
    return rows.where(F.col("t") >= t).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def risk_end(scores: DataFrame, units: DataFrame, horizon: float) -> DataFrame:
    """series_id, risk_end: the last score time whose horizon the record holds, else the record's start."""
    own = units.join(scores.select("series_id", "t"), "series_id", "left")
    return own.groupBy("series_id").agg(F.coalesce(F.max(F.when(F.col("t") <= F.col("record_end") - horizon + 1e-9, F.col("t"))), F.first("record_start")).alias("risk_end"))
