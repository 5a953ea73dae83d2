"""Whole-series bootstrap and exact intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.digest import md5_heads
from tidewatch.functions.special import beta_quantile, gamma_quantile
from tidewatch.operators.ranks import digest_range, range_of, ranked


#: Units of a stratum, by rank, whose draws meet in one group; and slots that one row hashes.
BLOCK, CHUNK = 4096, 1 << 17


def shuffle_tasks(df: DataFrame) -> int:
    """Tasks of what Python computes from few bytes, which Spark would otherwise put together: a number of its own."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def _drawn(units: DataFrame, replicates: int, seed: int, stratum: str) -> tuple[DataFrame, DataFrame]:
    """series_id with the stratum, block and place of its rank; and stratum, block, replicate and the places that its slots drew
    there. Slot k of a stratum in a replicate draws the rank that a seeded hash gives modulo the stratum's size."""
    own = units.select("series_id", F.col(stratum).cast("string").alias("_stratum")).where("_stratum is not null")
    rank = F.col("_rank") - 1
    numbered = ranked(own, ["_stratum"], ["series_id"], range_of(own, "series_id"), "_rank").select("series_id", "_stratum", F.floor(rank / BLOCK).cast("int").alias("_block"), (rank % BLOCK).cast("int").alias("_place"))
    tasks = shuffle_tasks(units)
    slots = own.groupBy("_stratum").agg(F.count("*").alias("n")).select("_stratum", "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    slots = slots.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))).alias("start")).repartition(tasks, "_stratum", "replicate", "start")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, n, replicate, start in batch[["_stratum", "n", "replicate", "start"]].itertuples(index=False):
                at = np.sort(md5_heads(f"{seed}|{name}|{replicate}|".encode(), start, min(n, start + CHUNK)) % n)
                block, first = np.unique(at // BLOCK, return_index=True)
                places = np.split((at % BLOCK).astype(np.uint16), first[1:])
                yield pd.DataFrame({"_stratum": name, "_block": block.astype(np.int32), "replicate": np.int32(replicate), "places": [x.tobytes() for x in places]})

    return numbered, slots.mapInPandas(hashed, "_stratum string, _block int, replicate int, places binary")


def _times(slots: pd.DataFrame, replicates: int) -> np.ndarray:
    """How often each place of a block is drawn (rows) by each replicate (columns)."""
    out = np.zeros((replicates, BLOCK), np.uint32)
    for r, places in zip(slots["replicate"], slots["places"]):
        out[r] += np.bincount(np.frombuffer(places, np.uint16), minlength=BLOCK).astype(np.uint32)
    return np.ascontiguousarray(out.T)


def _pack(row: np.ndarray) -> bytes:
    """Numbers in the least width that holds them all: 1, 2 or 4 bytes if they are counts, else 8."""
    top = row.max(initial=0)
    kind = np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32
    if top < 2**32:
        small = row.astype(kind)
        if (small == row).all():
            return small.tobytes()
    return row.astype(np.float64).tobytes()


def unpack(data: bytes, replicates: int) -> np.ndarray:
    """The numbers of drawn_vectors(), one for each replicate."""
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.float64}[len(data) // replicates])


def drawn_vectors(rows: DataFrame, units: DataFrame, by: list[str], values: list[str], replicates: int, seed: int, stratum: str = "stratum", whole: bool = False) -> DataFrame:
    """by, and for each of values a binary column: the sum over rows(series_id, by, values) of the value times the number of
    draws of its series, in every replicate of bootstrap_draws(); unpack() reads it. Several rows may have the same `by`: one
    for each block of units, or more, to be added up. Values aren't null. With `whole` a last number is added: the sum over all
    rows, each once, those of no unit or stratum too, so that nobody has to compute the rows again for it.

    A block of units meets its own draws once, as a matrix of units and replicates, whatever the number of rows; what leaves
    it is one row for each value of `by`, not one for each replicate.
    """
    numbered, slots = _drawn(units, replicates, seed, stratum)
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in by), *(f"`{v}` binary" for v in values)])
    own = rows.select("series_id", *by, *(F.col(v).cast("double").alias(v) for v in values)).join(numbered, "series_id", "left" if whole else "inner")
    tasks = shuffle_tasks(units)
    if whole:  # rows that nothing draws are dealt to as many blocks as there are tasks
        own = own.withColumns({"_block": F.coalesce("_block", -1 - F.pmod(F.xxhash64("series_id"), F.lit(tasks)).cast("int")), "_place": F.coalesce("_place", F.lit(0))})
    own = own.drop("series_id")

    def run(own: pd.DataFrame, slots: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not (whole or len(slots)):
            return pd.DataFrame({c: [] for c in [*by, *values]})
        times = _times(slots, replicates)
        if whole:
            times = np.column_stack([times, np.ones(BLOCK, times.dtype)])
        group = own.groupby(by, dropna=False, sort=False).ngroup().to_numpy() if by else np.zeros(len(own), np.int64)
        order = np.argsort(group, kind="stable")
        group, own = group[order], own.iloc[order]
        place, numbers = own["_place"].to_numpy(), own[values].to_numpy(np.float64)
        at, packed = [], [[] for _ in values]
        step = max(1, (1 << 20) // replicates)
        for a in range(0, len(own), step):
            part = group[a : a + step]
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            drawn = times[place[a : a + step]].astype(np.float64)
            at.append(a + first)
            for j, out in enumerate(packed):
                with np.errstate(invalid="ignore"):
                    number = numbers[a : a + step, j : j + 1]
                    product = drawn * number if np.isfinite(number).all() else np.where(drawn > 0, drawn * number, 0.0)
                    out.extend(_pack(row) for row in np.add.reduceat(product, first, axis=0))
        at = np.concatenate(at)
        return pd.DataFrame({**{c: own[c].iloc[at].to_numpy() for c in by}, **dict(zip(values, packed))})

    keys = ["_stratum", "_block"]
    return own.repartition(tasks, *keys).groupBy(*keys).cogroup(slots.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(run, schema)


def drawn_sums(rows: DataFrame, units: DataFrame, by: list[str], values: list[str], replicates: int, seed: int, stratum: str = "stratum", whole: bool = False) -> DataFrame:
    """by, replicate and the sums of drawn_vectors(), for few values of `by`; those that a replicate doesn't draw are left out.
    With `whole` the sums over all rows have the number after that of the last replicate."""
    vectors = drawn_vectors(rows.withColumn("_one", F.lit(1)), units, by, ["_one", *values], replicates, seed, stratum, whole)
    width = replicates + whole
    fields = {f.name: f.dataType.simpleString() for f in vectors.schema}
    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in by), "replicate int", *(f"`{v}` double" for v in ["_one", *values])])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.iloc[i : i + 1]
                numbers = {v: unpack(row[v].iloc[0], width).astype(np.float64) for v in ["_one", *values]}
                keys = row[by].loc[row.index.repeat(width)].reset_index(drop=True)
                out = pd.concat([keys, pd.DataFrame({"replicate": np.arange(width, dtype=np.int32), **numbers})], axis=1)
                yield out[out["_one"] > 0]

    flat = vectors.mapInPandas(run, schema)
    return flat.groupBy(*by, "replicate").agg(*(F.sum(v).alias(v) for v in values))


def bootstrap_draws(units: DataFrame, replicates: int, seed: int, stratum: str = "stratum") -> DataFrame:
    """replicate, series_id, times: how often each replicate draws each series, with replacement within its stratum.

    Slot k of a stratum in a replicate draws the series whose rank is a seeded hash modulo the stratum's size, so
    draws don't depend on partitions and can be replayed. Ranks are found by ranges of series_id (a number), so that a
    stratum is no task; slots are hashed in arrays, and only the places that they drew are shuffled, packed by block.
    """
    numbered, slots = _drawn(units, replicates, seed, stratum)
    kind = units.schema["series_id"].dataType.simpleString()
    tasks = shuffle_tasks(units)

    def run(own: pd.DataFrame, slots: pd.DataFrame) -> pd.DataFrame:
        times = _times(slots, replicates)[own["_place"].to_numpy()]
        which, replicate = np.nonzero(times)
        return pd.DataFrame({"replicate": replicate.astype(np.int32), "series_id": own["series_id"].to_numpy()[which], "times": times[which, replicate].astype(np.int64)})

    keys = ["_stratum", "_block"]
    return numbered.repartition(tasks, *keys).groupBy(*keys).cogroup(slots.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(run, f"replicate int, series_id {kind}, times long")


def bootstrap_ratio(contribution: DataFrame, units: DataFrame, top: str, bottom: str, replicates: int, seed: int) -> DataFrame:
    """estimate and 95% percentile interval of sum(top) / sum(bottom) under bootstrap_draws(); replicates whose bottom
    is 0 are left out. Contributions are one row per series, summed by block of series for all replicates and the estimate at once."""
    own = contribution.select("series_id", F.coalesce(F.col(top).cast("double"), F.lit(0.0)).alias("a"), F.coalesce(F.col(bottom).cast("double"), F.lit(0.0)).alias("b"))
    sums = drawn_sums(own, units, [], ["a", "b"], replicates, seed, whole=True)
    ratio, last = F.col("a") / F.col("b"), F.col("replicate") == replicates
    # nothing below the line is inf or NaN, as in SQL
    each = sums.select(F.when(last, F.when(F.col("b") == 0, F.col("a") * float("inf")).otherwise(ratio)).alias("whole"), F.when(~last & (F.col("b") > 0), ratio).alias("drawn"))
    spread = each.agg(F.max("whole").alias("estimate"), F.percentile("drawn", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count("drawn").alias("replicates"))
    return spread.select("estimate", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "replicates")


def drawn_ranks(rows: DataFrame, units: DataFrame, replicates: int, seed: int, edges: list[float] | None = None) -> DataFrame:
    """replicate, p, n (drawn rows of label 1 and 0) and u (pairs of them in which the first has the larger score, ties half)
    of rows(series_id, score, label), whole series drawn; and bins, an array of n, sp, sy, sq: rows, scores, labels and
    squared differences of both, summed over the scores from edge to next edge (all, without edges).

    Rows are summed by series, score and label, then over draws by score and label, and ordered by ranges of scores: a
    range holds its scores once for all replicates, and is told by few numbers how many negatives lie below it.
    """
    packed = rows.groupBy("series_id", F.col("score").alias("s"), F.col("label").cast("int").alias("label")).agg(F.count("*").alias("c"))
    vectors = drawn_vectors(packed, units, ["s", "label"], ["c"], replicates, seed).withColumn("part", range_of(packed, "s"))
    inner = [] if edges is None else edges[1:-1]
    bins = len(inner) + 1

    def run(own: pd.DataFrame) -> pd.DataFrame:
        s, at = np.unique(own["s"].to_numpy(np.float64), return_inverse=True)
        weight = np.zeros((3, len(s), replicates))
        for i, y, data in zip(at, own["label"].fillna(2).to_numpy(), own["c"]):
            weight[0 if y == 0 else 1 if y == 1 else 2, i] += unpack(data, replicates)
        neg, pos = weight[:2]
        below = np.cumsum(neg, axis=0) - neg
        out = {"part": own["part"].iloc[0], "replicate": np.arange(replicates, dtype=np.int32), "u": (pos * (below + neg / 2)).sum(0), "p": pos.sum(0), "n": neg.sum(0)}
        bin_ = np.searchsorted(inner, s, "right")
        sums = np.zeros((4, replicates, bins))
        for b in np.unique(bin_):
            inside, x = bin_ == b, s[bin_ == b, None]
            n0, n1 = neg[inside], pos[inside]
            sums[:, :, b] = (n0 + n1).sum(0), (x * (n0 + n1)).sum(0), n1.sum(0), (x**2 * n0 + (x - 1) ** 2 * n1).sum(0)
        return pd.DataFrame(out | {c: list(sums[k]) for k, c in enumerate(("bn", "bp", "by", "bq"))})

    found = vectors.repartition(shuffle_tasks(units), "part").groupBy("part").applyInPandas(run, "part int, replicate int, u double, p double, n double, bn array<double>, bp array<double>, by array<double>, bq array<double>")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("replicate").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = lambda c: F.array(*(F.sum(F.get(c, F.lit(k))) for k in range(bins)))
    sums = found.withColumn("before", before).groupBy("replicate").agg(F.sum(F.col("u") + F.col("p") * F.col("before")).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"), F.arrays_zip(*(total(c).alias(name) for c, name in (("bn", "n"), ("bp", "sp"), ("by", "sy"), ("bq", "sq")))).alias("bins"))
    return sums


def bootstrap_auc(labelled: DataFrame, units: DataFrame, replicates: int, seed: int) -> DataFrame:
    """estimate and 95% interval of the AUC of labelled(series_id, score, label), whole series drawn together; single
    class replicates are left out."""
    from tidewatch.operators.metrics import auc

    aucs = drawn_ranks(labelled, units, replicates, seed).where("p > 0 and n > 0").select((F.col("u") / (F.col("p") * F.col("n"))).alias("auc"))
    spread = aucs.agg(F.expr("percentile(auc, array(0.025D, 0.975D))").alias("q"), F.count("*").alias("replicates"))
    return auc(labelled).select(F.col("auc").alias("estimate")).crossJoin(spread).select("estimate", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "replicates")


def proportion_wilson(df: DataFrame, by: list[str], hit: str, z: float = 1.959963984540054) -> DataFrame:
    """by, hits, n, share and its Wilson interval."""
    out = df.groupBy(*by).agg(F.count_if(F.col(hit)).alias("hits"), F.count("*").alias("n"))
    p, n = F.col("hits") / F.col("n"), F.col("n")
    middle, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return out.select(*by, "hits", "n", p.alias("share"), (middle - half).alias("lo"), (middle + half).alias("hi"))


def proportion_bounds(hits: str, n: str, confidence: float = 0.95) -> tuple:
    """Columns lo and hi: the exact Clopper-Pearson interval of hits of n; NaN for n = 0. For grouped rows."""
    tail = (1 - confidence) / 2

    def bound(upper: bool):
        @F.pandas_udf("double")
        def run(k: pd.Series, n: pd.Series) -> pd.Series:
            k, n = k.to_numpy(np.float64), n.to_numpy(np.float64)
            a, b = (k + 1, n - k) if upper else (k, n - k + 1)
            q = beta_quantile(1 - tail if upper else tail, np.maximum(a, 1e-3), np.maximum(b, 1e-3))
            q = np.where(k == n, 1.0, q) if upper else np.where(k == 0, 0.0, q)
            return pd.Series(np.where(n == 0, np.nan, q))

        return run

    return bound(False)(hits, n), bound(True)(hits, n)


def poisson_bounds(events: str, confidence: float = 0.95) -> tuple:
    """Columns lo and hi: Garwood's exact interval of a Poisson mean. For grouped rows."""
    tail = (1 - confidence) / 2

    def bound(upper: bool):
        @F.pandas_udf("double")
        def run(k: pd.Series) -> pd.Series:
            k = k.to_numpy(np.float64)
            q = gamma_quantile(1 - tail if upper else tail, k + 1 if upper else np.maximum(k, 1e-3))
            return pd.Series(q if upper else np.where(k == 0, 0.0, q))

        return run

    return bound(False)(events), bound(True)(events)


def proportion_ci(df: DataFrame, by: list[str], hit: str, confidence: float = 0.95) -> DataFrame:
    """by, hits, n, lo, hi: exact Clopper-Pearson interval; NaN for an empty group. Only the grouped rows reach Python."""
    out = df.groupBy(*by).agg(F.count_if(F.col(hit)).alias("hits"), F.count("*").alias("n"))
    lo, hi = proportion_bounds("hits", "n", confidence)
    return out.withColumns({"lo": lo, "hi": hi})


def rate_ci(df: DataFrame, by: list[str], event: str, exposure: str, confidence: float = 0.95) -> DataFrame:
    """by, events, exposure, rate, lo, hi: Garwood's exact Poisson interval over the summed exposure."""
    out = df.groupBy(*by).agg(F.count_if(F.col(event)).alias("events"), F.sum(exposure).alias("exposure"))
    lo, hi = poisson_bounds("events", confidence)
    return out.select(*by, "events", "exposure", (F.col("events") / F.col("exposure")).alias("rate"), (lo / F.col("exposure")).alias("lo"), (hi / F.col("exposure")).alias("hi"))


def stratified_sample(df: DataFrame, strata: list[str], n: int, seed: int, key: str) -> DataFrame:
    """n rows shared out over strata in turns, none beyond its size, with weight N / n of the stratum. Rows of a
    stratum come in the order of a seeded hash of the key, and are ranked by ranges of it, so that a stratum is no task.

    Turns aren't walked: a stratum gives its size or the level that fills n, and of what is left one more to the first
    strata that have it. Strata are few rows beside the table; the join with them is Spark's choice.
    """
    sizes = df.groupBy(*strata).agg(F.count("*").alias("size"))
    every = Window.partitionBy(F.lit(0)).orderBy("size")
    count = F.count("*").over(Window.partitionBy(F.lit(0)))
    # if the level is `size`, smaller strata are used up and all others give `size`
    filled = sizes.withColumns({"less": F.coalesce(F.sum("size").over(every.rangeBetween(Window.unboundedPreceding, 0)), F.lit(0)), "more": count - F.count("*").over(every.rangeBetween(Window.unboundedPreceding, 0))})
    filled = filled.withColumn("at", F.col("less") + F.col("more") * F.col("size"))
    step = filled.where(F.col("at") <= n).agg(F.max_by(F.struct("size", "at", "more"), "size").alias("s"), F.count("*").alias("c")).crossJoin(sizes.agg(F.count("*").alias("all")))
    base, more, used = F.when(F.col("c") > 0, F.col("s.size")).otherwise(0), F.when(F.col("c") > 0, F.col("s.more")).otherwise(F.col("all")), F.when(F.col("c") > 0, F.col("s.at")).otherwise(0)
    level = F.when(more > 0, base + F.floor((n - used) / more)).otherwise(base)
    level = step.select(level.alias("level"), F.when(more > 0, n - used - F.floor((n - used) / more) * more).otherwise(0).alias("left"))
    turn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.col("size") > F.col("level")), *strata))
    taken = sizes.crossJoin(level).withColumn("_turn", turn).select(*strata, (F.least("size", "level") + F.when((F.col("size") > F.col("level")) & (F.col("_turn") <= F.col("left")), 1).otherwise(0)).alias("_take")).where("_take > 0")
    rows = df.withColumn("_digest", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")))
    out = ranked(rows, strata, ["_digest", key], digest_range(F.col("_digest")), "_k", "_size").drop("_digest")
    return out.join(taken, strata).where("_k <= _take").select(*df.columns, (F.col("_size") / F.col("_take")).alias("weight"))
