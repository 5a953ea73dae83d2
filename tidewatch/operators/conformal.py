"""Conformal calibration: order statistics, split and adaptive bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.ranks import range_of, running


def conformal_quantile(cal: DataFrame, alphas: list[float], by: list[str] | None = None, score: str = "score") -> DataFrame:
    """by, alpha, quantile: the score of rank ceil((n + 1)(1 - alpha)); infinite where that rank is outside.

    Scores are first counted by value, then counted up by ranges of values, so that neither ties nor a group without
    `by` are one task. Nulls are no scores."""
    by = by or []
    table = cal.sparkSession.createDataFrame([(float(a),) for a in alphas], "alpha double")
    values = cal.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("s")).agg(F.count("*").alias("c"))
    summed = running(values, by, "s", "c", range_of(values, "s"), "below", "n")
    sizes = summed.groupBy(*by).agg(F.first("n").alias("n"))
    rank = F.ceil(F.round((F.col("n") + 1) * (1 - F.col("alpha")), 9))
    hit = (F.col("below") < rank) & (rank <= F.col("below") + F.col("c"))
    found = summed.crossJoin(F.broadcast(table)).where(hit).groupBy(*by, "alpha").agg(F.max("s").alias("q"))
    asked = sizes.crossJoin(F.broadcast(table))
    crossed = asked.join(found, [*by, "alpha"], "left")
    q = F.when(F.col("alpha") <= 0, float("inf")).when(F.col("alpha") >= 1, float("-inf")).otherwise(F.coalesce("q", F.lit(float("inf"))))
    return crossed.select(*by, "alpha", "n", q.alias("quantile"))


def split_bounds(cal: DataFrame, test: DataFrame, alphas: list[float], by: list[str] | None = None) -> DataFrame:
    """test(bound, target) with alpha, upper (bound + quantile of target - bound over cal) and miss (0/1)."""
    q = conformal_quantile(cal.withColumn("score", F.col("target") - F.col("bound")), alphas, by)
    joined = test.join(F.broadcast(q), by) if by else test.crossJoin(F.broadcast(q))
    return joined.withColumn("upper", F.col("bound") + F.col("quantile")).withColumn("miss", (F.col("target") > F.col("upper")).cast("int"))


#: Rows of forecasts in a group of series, on average.
GROUP_ROWS = 1_000_000


class Ragged:
    """Series of different lengths laid end to end, the longest first, so that a step takes the first `active` of them."""

    def __init__(self, series: np.ndarray):
        _, first, length = np.unique(series, return_index=True, return_counts=True)
        order = np.argsort(-length, kind="stable")
        self.first, self.length = first[order], length[order]

    def steps(self):
        """For each step, how many series have it and where in the rows."""
        for k in range(int(self.length[0]) if len(self.length) else 0):
            active = int(np.searchsorted(-self.length, -k, "left"))
            yield k, active, self.first[:active] + k


def _by_series(forecasts: DataFrame, columns: str, levels, out: str) -> DataFrame:
    """Whole series in groups, each through levels(Ragged, columns as arrays), which gives the columns of out. A group
    takes memory by its rows, whatever the lengths of its series."""
    parts = max(int(forecasts.sparkSession.conf.get("spark.sql.shuffle.partitions")), forecasts.count() // GROUP_ROWS)
    keep = ["series_id", "t", "bound", "target"]
    extra = columns.split()
    rows = forecasts.select(F.pmod(F.xxhash64("series_id"), F.lit(parts)).cast("int").alias("part"), F.col("series_id").cast("long").alias("series_id"), *(F.col(c).cast("double").alias(c) for c in keep[1:]), *extra)

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["series_id", "t"], kind="stable")
        found = levels(Ragged(own["series_id"].to_numpy()), {c: own[c].to_numpy() for c in [*keep, *extra]})
        return own[keep].assign(**found)

    return rows.groupBy("part").applyInPandas(run, f"series_id long, t double, bound double, target double, {out}")


def _rank(n: int, level: np.ndarray) -> np.ndarray:
    """The rank, among n scores, of the conformal quantile at each level: 0 stands for minus infinity, n + 1 for infinity."""
    rank = np.ceil(np.round((n + 1) * (1 - level), 9))
    return np.where(level >= 1, 0, np.where((level <= 0) | (rank > n), n + 1, np.maximum(rank, 1))).astype(np.int64)


def aci(forecasts: DataFrame, cal: DataFrame, alpha: float, gamma: float, delay: int = 0) -> DataFrame:
    """Adaptive level per series: forecasts(series_id, t, bound, target) with level, upper and miss.

    The level moves by gamma (alpha - miss) after each outcome, `delay` steps late, and is not held in [0, 1].
    """
    return dtaci(forecasts, cal, alpha, [gamma], delay=delay)


def sliding_aci(forecasts: DataFrame, cal: DataFrame, alpha: float, gamma: float, window: int, delay: int = 0) -> DataFrame:
    """Adaptive level whose scores are the last `window` known ones of the series, at first the last ones of cal in
    order of time; columns as aci(). All series of a group take a step at once; a row of scores stays sorted, as each step takes
    the oldest out and puts the new one in. Only the last `window` scores of cal are looked at, so they are collected."""
    lag = max(delay, 1)
    order = [F.col(c).desc() for c in ("t", "series_id") if c in cal.columns]
    last = cal.select((F.col("target") - F.col("bound")).cast("double").alias("s"), *(c for c in ("t", "series_id") if c in cal.columns))
    begin = np.array([r.s for r in (last.orderBy(*order) if order else last).limit(window).collect()][::-1], float)

    def levels(ragged: Ragged, c: dict) -> dict:
        n = len(ragged.first)
        gained = c["target"] - c["bound"]
        by_age, ordered = np.tile(begin, (n, 1)), np.tile(np.sort(begin), (n, 1))
        level, upper = np.full(len(gained), alpha), np.empty(len(gained))
        now = np.full(n, alpha)
        for k, active, rows in ragged.steps():
            by_age, ordered, now = by_age[:active], ordered[:active], now[:active]
            if k >= lag:
                known = rows - lag
                new = gained[known]
                if by_age.shape[1] == window:
                    gone = (ordered < by_age[:, :1]).sum(axis=1)
                    ordered = ordered[np.arange(window)[None, :] != gone[:, None]].reshape(active, window - 1)
                    by_age = by_age[:, 1:]
                by_age = np.concatenate([by_age, new[:, None]], axis=1)
                place = (ordered < new[:, None]).sum(axis=1)
                wide = np.empty((active, ordered.shape[1] + 1))
                at = np.arange(wide.shape[1])[None, :]
                wide[at != place[:, None]] = ordered.ravel()
                wide[np.arange(active), place] = new
                ordered = wide
                now = now + gamma * (alpha - (c["target"][known] > upper[known]))
            m = ordered.shape[1]
            rank = _rank(m, now)
            inside = ordered[np.arange(active), np.clip(rank, 1, max(m, 1)) - 1] if m else np.full(active, np.inf)
            level[rows] = now
            upper[rows] = c["bound"][rows] + np.where(rank == 0, -np.inf, np.where(rank > m, np.inf, inside))
        return {"level": level, "upper": upper, "miss": (c["target"] > upper).astype("int32")}

    return _by_series(forecasts, "", levels, "level double, upper double, miss int")


def dtaci(forecasts: DataFrame, cal: DataFrame, alpha: float, gammas: list[float], interval: int = 500, delay: int = 0) -> DataFrame:
    """Adaptive level averaged over experts of several rates, by exponential weights with a little mixing; columns as
    aci(). With one rate it is aci().

    What an outcome teaches follows from its score's rank among the calibration scores, which is counted for all forecasts beforehand, by running counts over
    ranges of values of both tables; and a level's bound is the calibration score of a rank, joined to afterwards. So
    no task holds the calibration scores. In between all series of a group take a step at once, with their experts.
    """
    rates, mixing, lag = np.array(gammas, float), 1 / (2 * interval), max(delay, 1)
    eta = np.sqrt((np.log(2 * len(rates) * interval) + 1) / (interval * (1 - alpha) ** 2 * alpha**2 / 3))
    known = cal.select((F.col("target") - F.col("bound")).cast("double").alias("s")).where("s is not null").groupBy("s").agg(F.count("*").alias("c"))
    n = int(known.agg(F.sum("c")).first()[0] or 0)
    scored = forecasts.select("series_id", "t", "bound", "target", (F.col("target") - F.col("bound")).cast("double").alias("s"))
    values = known.unionByName(scored.where("s is not null").select("s", F.lit(0).cast("long").alias("c"))).groupBy("s").agg(F.sum("c").alias("c"))
    counted = running(values, [], "s", "c", range_of(values, "s"), "below", "total")
    ranked_rows = scored.join(counted.select("s", "below"), "s", "left").drop("s").withColumn("below", F.coalesce("below", F.lit(0)))

    def levels(ragged: Ragged, c: dict) -> dict:
        count, size = c["below"].astype(np.int64), len(ragged.first)
        rank = 1 - count / (n + 1)
        experts = np.empty((len(count), len(rates)))
        now, weights, level = np.full((size, len(rates)), alpha), np.ones((size, len(rates))), np.empty(len(count))
        for k, active, rows in ragged.steps():
            now, weights = now[:active], weights[:active]
            if k >= lag:
                past = rows - lag
                then = experts[past]
                off = rank[past][:, None] - then
                loss = np.where(off < 0, (alpha - 1) * off, alpha * off)
                weights = weights * np.exp(eta * (loss.min(axis=1, keepdims=True) - loss))
                weights += mixing * (weights.mean(axis=1, keepdims=True) - weights)
                at = _rank(n, then)
                # a score lies above the one of rank r if r or more lie below it
                now = now + rates * (alpha - (count[past][:, None] >= at))
            experts[rows] = now
            level[rows] = (weights * now).sum(axis=1) / weights.sum(axis=1)
        return {"level": level, "rank": _rank(n, level)}

    moved = _by_series(ranked_rows, "below", levels, "level double, rank long")
    # a rank's score: the value whose running count passes it
    order = counted.where("c > 0").select((F.col("below") + 1).alias("first"), (F.col("below") + F.col("c")).alias("last"), "s")
    asked = moved.select("rank").distinct().where(F.col("rank").between(1, n))
    places = asked.select(F.col("rank").alias("k"), F.lit(None).cast("double").alias("s")).unionByName(order.select(F.col("first").alias("k"), "s"))
    held = F.last("s", ignorenulls=True).over(Window.partitionBy("part").orderBy("k", F.asc_nulls_last("s")).rowsBetween(Window.unboundedPreceding, 0))
    width = max(1, n // 4096)
    part = F.floor((F.col("k") - 1) / width)
    # values of many scores may begin ranges before those asked for, so each range is begun with its last value before
    begins, ends = F.floor((F.col("first") - 1) / width) + 1, F.floor((F.col("last") - 1) / width)
    edges = order.where(begins <= ends).select(F.explode(F.sequence(begins, ends)).alias("part"), "s").select((F.col("part") * width + 1).alias("k"), "s")
    scores = places.unionByName(edges).withColumn("part", part).withColumn("s", held).select(F.col("k").alias("rank"), "s").groupBy("rank").agg(F.max("s").alias("s"))
    out = moved.join(scores, "rank", "left").withColumn("q", F.when(F.col("rank") == 0, float("-inf")).when(F.col("rank") > n, float("inf")).otherwise(F.col("s")))
    return out.select("series_id", "t", "bound", "target", "level", (F.col("bound") + F.col("q")).alias("upper")).withColumn("miss", (F.col("target") > F.col("upper")).cast("int"))
