"""Fitted forecasters, classifiers and medoids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Least number of parts in which rows are kept that are read at every step of a fit.
PARTS = 16


def fit_envelope(fs: DataFrame, quantiles: list[float], by: list[str] | None = None) -> DataFrame:
    """by, q, scale: the factor s for which s * top is the q-quantile bound of target with least pinball loss, that is
    the q-quantile of target / top weighted by top. fs(top, target)."""
    by = by or []
    rows = fs.where("top > 0").groupBy(*by, (F.col("target") / F.col("top")).alias("ratio")).agg(F.sum("top").alias("w"))
    w = Window.partitionBy(*(by or [F.lit(0)]))
    ranked = rows.withColumns({"below": F.sum("w").over(w.orderBy("ratio").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("w").over(w)})
    table = F.explode(F.array(*(F.lit(float(q)) for q in quantiles)))
    return ranked.select(*by, "ratio", "below", "total", table.alias("q")).where(F.col("below") >= F.col("q") * F.col("total") - 1e-9).groupBy(*by, "q").agg(F.min("ratio").alias("scale"))


def fit_linear_quantile(df: DataFrame, columns: list[str], target: str, quantiles: list[float], steps: int = 200, rate: float = 0.05) -> dict[float, list[float]]:
    """Intercept and weights of a linear quantile regression for each quantile, by full-gradient descent with a decaying
    step; every step is one aggregate of a few numbers over the whole table. Each task of a step tells the driver how it went,
    so the rows are kept in a number of parts that goes by the cores, not by the rows."""
    own = df.select(*(F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)), F.col(target).cast("double").alias("_y"))
    own = own.coalesce(max(PARTS, 2 * df.sparkSession.sparkContext.defaultParallelism)).cache()
    weights = {q: [0.0] * (len(columns) + 1) for q in quantiles}
    try:
        for step in range(steps):
            sums = []
            for k, q in enumerate(quantiles):
                b = weights[q]
                miss = F.col("_y") - (F.lit(b[0]) + sum((F.lit(b[i + 1]) * F.col(f"_{i}") for i in range(len(columns))), F.lit(0.0)))
                slope = F.when(miss > 0, -q).otherwise(1 - q)
                sums += [F.avg(slope).alias(f"g{k}_0"), *(F.avg(slope * F.col(f"_{i}")).alias(f"g{k}_{i + 1}") for i in range(len(columns)))]
            got = own.agg(*sums).first()
            for k, q in enumerate(quantiles):
                weights[q] = [v - rate / (1 + 0.02 * step) * (got[f"g{k}_{i}"] or 0.0) for i, v in enumerate(weights[q])]
    finally:
        own.unpersist()
    return weights


def fit_logistic(df: DataFrame, columns: list[str], label: str, l2: float = 0.0):
    """An MLlib logistic model over standardised columns, and df scored with `p`."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=columns, outputCol="_features", handleInvalid="skip").transform(df)
    model = LogisticRegression(featuresCol="_features", labelCol=label, regParam=l2 / max(1, df.count())).fit(rows)
    return model, _scored(model, rows)


def fit_trees(df: DataFrame, columns: list[str], label: str, depth: int = 3, rounds: int = 20, step: float = 0.05, seed: int = 1):
    """MLlib boosted trees, and df scored with `p`."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=columns, outputCol="_features", handleInvalid="skip").transform(df)
    model = GBTClassifier(featuresCol="_features", labelCol=label, maxDepth=depth, maxIter=rounds, stepSize=step, subsamplingRate=0.8, seed=seed).fit(rows)
    return model, _scored(model, rows)


def _scored(model, rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).withColumn("p", vector_to_array("probability")[1]).drop("_features", "rawPrediction", "probability", "prediction")


def medoids(df: DataFrame, key: str, vector: str, k: int, first=None) -> DataFrame:
    """key, medoid, distance: k rows chosen farthest first (the first is that of smallest key, unless a row with key and v is given; the smaller key wins
    ties) and each row's nearest of them. Each round is one aggregate over the rows and k rows on the driver."""
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    chosen = [first or rows.orderBy("key").select("key", "v").first()]

    def distances(found):
        table = [F.sqrt(F.aggregate(F.zip_with("v", F.array(*(F.lit(float(x)) for x in r.v)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)) for r in found]
        return F.array_min(F.array(*(F.struct(F.round(d, 9).alias("d"), F.lit(r.key).alias("m")) for d, r in zip(table, found, strict=True))))

    while len(chosen) < k:
        far = rows.withColumn("n", distances(chosen)).agg(F.min_by(F.struct("key", "v"), F.struct(-F.col("n.d"), F.col("key"))).alias("x"), F.max("n.d").alias("d")).first()
        if not far.d:
            break
        chosen.append(far.x)
    return rows.withColumn("n", distances(chosen)).select(F.col("key").alias(key), F.col("n.m").alias("medoid"), F.col("n.d").alias("distance"))


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with `scaled`, an array of columns less their median, over the median of the absolute differences from it; where
    that is 0, over the standard deviation (of the population), and where that is 0 too, over 1. Two passes, each one row."""
    middle = df.agg(*(F.median(c).alias(c) for c in columns)).first()
    off = {c: F.abs(F.col(c) - F.lit(middle[c])) for c in columns}
    spread = df.agg(*(F.median(off[c]).alias(f"m{i}") for i, c in enumerate(columns)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns))).first()
    unit = [spread[f"m{i}"] or spread[f"s{i}"] or 1.0 for i in range(len(columns))]
    return df.withColumn("scaled", F.array(*((F.col(c) - F.lit(middle[c])).cast("double") / F.lit(float(u)) for c, u in zip(columns, unit, strict=True))))


def cluster_medoids(df: DataFrame, key: str, columns: list[str], k: int) -> DataFrame:
    """key, medoid, distance: k medoids of robust_scale(), the first farthest from the centre, each next one farthest from those
    before, the smaller key on ties (to nine places), and each row's nearest."""
    rows = robust_scale(df.dropna(subset=columns), columns)
    length = F.round(F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, v: s + v * v)), 9)
    first = rows.agg(F.min_by(F.struct(F.col(key).alias("key"), F.col("scaled").alias("v")), F.struct(-length, F.col(key))).alias("x")).first()
    return medoids(rows, key, "scaled", k, None if first is None else first.x)


def trial_grid(entries: DataFrame, groups: DataFrame, multipliers: list[float]) -> DataFrame:
    """Trials (entry x group of the same class x multiplier) with label 1 where the scaled height reaches the entry's
    critical height. entries(entry_id, kind, critical), groups(group_id, kind, height)."""
    crossed = entries.join(groups, "kind").select("entry_id", "group_id", "kind", "critical", "height", F.explode(F.array(*(F.lit(float(m)) for m in multipliers))).alias("multiplier"))
    return crossed.withColumn("label", (F.col("height") * F.col("multiplier") >= F.col("critical")).cast("int"))


def trial_counts(entries: DataFrame, groups: DataFrame, multipliers: list[float]) -> DataFrame:
    """kind, multiplier, n, hits: the trials of trial_grid and those with label 1, counted without forming a pair.

    Rows are counted by class and height first. Critical heights are then merged with scaled heights in order: a running
    count over ranges of heights, and within each range, tells how many critical heights a group reaches, so that a
    class isn't one task. Null classes meet none; null heights are trials without a label.
    """
    by = ["kind", "multiplier"]
    table = F.explode(F.array(*(F.lit(float(m)) for m in multipliers))).alias("multiplier")
    given = entries.where("kind is not null").select("kind", F.col("critical").cast("double").alias("height"), table).groupBy(*by, "height").agg(F.count("*").alias("entries")).withColumn("groups", F.lit(0).cast("long"))
    asked = groups.where("kind is not null").select("kind", F.col("height").cast("double").alias("h"), table).select("kind", "multiplier", (F.col("h") * F.col("multiplier")).alias("height"))
    asked = asked.groupBy(*by, "height").agg(F.count("*").alias("groups")).withColumn("entries", F.lit(0).cast("long"))
    merged = given.unionByName(asked).groupBy(*by, "height").agg(F.sum("entries").alias("entries"), F.sum("groups").alias("groups"))
    totals = merged.groupBy(*by).agg((F.sum("entries") * F.sum("groups")).alias("n")).where("n > 0")
    known = merged.where("height is not null")
    cuts = known.groupBy(*by).agg(F.array_distinct(F.percentile_approx("height", F.array(*(F.lit(k / 64) for k in range(1, 64))), 10000)).alias("cuts"))
    parts = known.join(F.broadcast(cuts), by).withColumn("part", F.size(F.filter("cuts", lambda c: F.col("height") >= c))).drop("cuts")
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy(*by, "part").agg(F.sum("entries").alias("own")).withColumn("before", F.coalesce(F.sum("own").over(before), F.lit(0).cast("long"))).drop("own")
    inside = Window.partitionBy(*by, "part").orderBy("height").rowsBetween(Window.unboundedPreceding, 0)
    reached = parts.withColumn("reached", F.sum("entries").over(inside)).join(F.broadcast(starts), [*by, "part"])
    hits = reached.groupBy(*by).agg(F.sum(F.col("groups") * (F.col("before") + F.col("reached"))).alias("hits"))
    return totals.join(hits, by, "left").select(*by, "n", F.coalesce("hits", F.lit(0).cast("long")).alias("hits"))


def predict_quantiles(df: DataFrame, fitted: dict[float, list[float]], columns: list[str]) -> DataFrame:
    """df with `quantiles`, the forecasts of fit_linear_quantile() in the order of their levels, each at least as high
    as those of lower levels; null where a column is null."""
    lines = [F.lit(float(b[0])) + sum((F.lit(float(s)) * F.col(c) for s, c in zip(b[1:], columns, strict=True)), F.lit(0.0)) for _, b in sorted(fitted.items())]
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    rising = [lines[0], *(F.greatest(*lines[: k + 1]) for k in range(1, len(lines)))]
    return df.withColumn("quantiles", F.when(known, F.array(*rising)))
