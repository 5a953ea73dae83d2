"""Rates composed of independent sources of uncertainty, and their bootstrap, jointly and one source at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.special import poisson_quantile
from tidewatch.operators.ranks import range_of, running
from tidewatch.operators.resampling import drawn_sums, drawn_vectors, unpack

COMPONENTS = ("joint", "groups", "entries", "responses")


def _poisson(u, mean):
    """The Poisson count of a mean at a uniform number, for grouped rows."""

    @F.pandas_udf("long")
    def run(u: pd.Series, mean: pd.Series) -> pd.Series:
        return pd.Series(poisson_quantile(u.to_numpy(np.float64), mean.to_numpy(np.float64)).astype(np.int64))

    return run(u, mean)


def component_draws(groups: DataFrame, entries: DataFrame, responses: DataFrame, exposure: float, replicates: int, seed: int, count_exposure: float | None = None) -> DataFrame:
    """replicate, point, joint, groups, entries, responses (rates) and count, of `replicates` replicates.

    groups(source, kind, height), entries(entry_id, stratum), responses(response_id, kind, stratum, height). The rate is the sum over
    groups and strata of the share of entries in the stratum times the share of responses of the group's kind and the stratum at or below its
    height, over the exposure; a kind without responses in a stratum adds nothing there. A replicate draws whole sources, entries, and responses within kind and
    stratum, each from slots of its own (seed, seed + 1, seed + 2), all three or one at a time; count is a Poisson draw of the joint
    rate over count_exposure (default: exposure).

    Each kind and stratum numbers the heights that its groups ask for, and every response counts from the first of them at or above its own. Draws are
    summed by that number for all replicates at once (drawn_vectors()), of sources and of responses, and a range of numbers meets its
    sums as two matrices of numbers and replicates; what lies below a range is added from the totals of the ranges before it.
    No group meets a response, and rows are ranges x replicates, not heights x replicates.
    """
    strata = responses.select("kind", "stratum").distinct()
    none = lambda name: F.lit(0).cast("long").alias(name)
    heights = responses.groupBy("kind", "stratum", "height").agg(F.count("*").alias("c")).select("*", none("a")).unionByName(groups.select("kind", "height").distinct().join(strata, "kind").select("kind", "stratum", "height", none("c"), F.lit(1).cast("long").alias("a")))
    heights = heights.groupBy("kind", "stratum", "height").agg(F.sum("c").alias("c"), F.max("a").alias("a"))
    part = range_of(heights, "height")
    upto = running(running(heights, ["kind", "stratum"], "height", "c", part, "below", "n"), ["kind", "stratum"], "height", "a", part, "at", "asked").withColumn("f0", (F.col("below") + F.col("c")) / F.col("n"))
    weights = groups.groupBy("source", "kind", "height").agg(F.count("*").alias("w")).join(upto.where("a = 1").select("kind", "stratum", "height", "at", "f0", "n"), ["kind", "height"])
    fixed = weights.groupBy("kind", "stratum", "at", "f0", "n").agg(F.sum("w").alias("w0"))

    one = lambda df, key: df.select(F.col(key).alias("series_id"), F.lit(0).alias("stratum"))
    keys = ["kind", "stratum", "at"]
    drawn_w = drawn_vectors(weights.select(F.col("source").alias("series_id"), *keys, "w"), one(groups.select("source").distinct(), "source"), keys, ["w"], replicates, seed)

    entry0 = entries.groupBy("stratum").agg(F.count("*").alias("m"))
    total = entries.agg(F.count("*").alias("all"))
    entry_r = drawn_sums(entries.select(F.col("entry_id").alias("series_id"), "stratum", F.lit(1).alias("mr")), one(entries, "entry_id"), ["stratum"], ["mr"], replicates, seed + 1)

    units = responses.select(F.col("response_id").alias("series_id"), F.concat_ws("|", F.col("kind").cast("string"), F.col("stratum").cast("string")).alias("stratum"))
    placed = responses.join(upto.where("at < asked").select("kind", "stratum", "height", "at"), ["kind", "stratum", "height"]).select(F.col("response_id").alias("series_id"), *keys, F.lit(1).alias("w"))
    drawn_r = drawn_vectors(placed, units, keys, ["w"], replicates, seed + 2)

    plain = lambda c: F.lit(None).cast("double").alias(c)
    own = fixed.select(*keys, F.lit("f").alias("what"), F.col("w0").cast("double").alias("w0"), "f0", F.lit(None).cast("binary").alias("w"))
    for what, drawn in (("w", drawn_w), ("r", drawn_r)):
        own = own.unionByName(drawn.select(*keys, F.lit(what).alias("what"), plain("w0"), plain("f0"), "w"))
    kinds = ", ".join(f"{c} {groups.schema[c].dataType.simpleString() if c == 'kind' else responses.schema[c].dataType.simpleString()}" for c in ("kind", "stratum"))

    def met(own: pd.DataFrame) -> pd.DataFrame:
        at, row = np.unique(own["at"].to_numpy(), return_inverse=True)
        what = own["what"].to_numpy()
        w0, f0, sums = np.zeros(len(at)), np.zeros(len(at)), {"w": np.zeros((len(at), replicates)), "r": np.zeros((len(at), replicates))}
        known = what == "f"
        w0[row[known]], f0[row[known]] = own["w0"].to_numpy()[known], own["f0"].to_numpy()[known]
        for i, name, data in zip(row[~known], what[~known], own["w"][~known]):
            sums[name][i] += unpack(data, replicates)
        wr, cum = sums["w"], np.cumsum(sums["r"], axis=0)
        return pd.DataFrame({"kind": own["kind"].iloc[0], "stratum": own["stratum"].iloc[0], "part": own["part"].iloc[0], "replicate": np.arange(replicates, dtype=np.int32), "t00": w0 @ f0, "t10": f0 @ wr, "t01": w0 @ cum, "t11": (wr * cum).sum(0), "s0": w0.sum(), "sr": wr.sum(0), "d": cum[-1]})

    split = ["kind", "stratum", "part"]
    found = own.withColumn("part", F.floor(F.col("at") / 256).cast("long")).groupBy(*split).applyInPandas(met, f"{kinds}, part long, replicate int, t00 double, t10 double, t01 double, t11 double, s0 double, sr double, d double")
    before = F.coalesce(F.sum("d").over(Window.partitionBy("kind", "stratum", "replicate").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sizes = fixed.groupBy("kind", "stratum").agg(F.first("n").alias("n"))
    rows = found.withColumn("before", before).join(sizes, ["kind", "stratum"])
    sums = rows.groupBy("replicate", "stratum").agg(F.sum("t00").alias("t00"), F.sum("t10").alias("t10"), F.sum((F.col("t01") + F.col("before") * F.col("s0")) / F.col("n")).alias("t01"), F.sum((F.col("t11") + F.col("before") * F.col("sr")) / F.col("n")).alias("t11"))
    parts = sums.join(entry0, "stratum", "left").join(entry_r, ["replicate", "stratum"], "left").crossJoin(F.broadcast(total)).withColumns({"e0": F.coalesce("m", F.lit(0)) / F.col("all"), "er": F.coalesce("mr", F.lit(0.0)) / F.col("all")})
    rate = lambda e, t: F.sum(F.col(e) * F.col(t)) / exposure
    out = parts.groupBy("replicate").agg(rate("e0", "t00").alias("point"), rate("er", "t11").alias("joint"), rate("e0", "t10").alias("groups"), rate("er", "t00").alias("entries"), rate("e0", "t01").alias("responses"))
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed + 3)), F.col("replicate").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return out.withColumn("count", _poisson(u, F.col("joint") * float(exposure if count_exposure is None else count_exposure)))


def component_bootstrap(draws: DataFrame) -> DataFrame:
    """component, point, variance (of the population of replicates), 95% interval lo and hi, and for the joint one the interval count_lo,
    count_hi of predicted counts (values that occur), of component_draws()."""
    flat = draws.select("point", F.explode(F.array(*(F.struct(F.lit(c).alias("component"), F.col(c).alias("rate"), (F.col("count") if c == "joint" else F.lit(None).cast("long")).alias("count")) for c in COMPONENTS))).alias("e")).select("point", "e.*")
    out = flat.groupBy("component").agg(F.first("point").alias("point"), F.var_pop("rate").alias("variance"), F.percentile("rate", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.expr("percentile_disc(0.025) within group (order by count)").alias("count_lo"), F.expr("percentile_disc(0.975) within group (order by count)").alias("count_hi"))
    return out.select("component", "point", "variance", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), F.col("count_lo").cast("long").alias("count_lo"), F.col("count_hi").cast("long").alias("count_hi"))
