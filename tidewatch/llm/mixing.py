"""Mixing sources to target weights by hierarchical budgets.

A tree of domains, languages and sources splits the token budget by weights from the top down. A node that can't use
its share (its texts, repeated for at most `epochs` epochs, hold fewer tokens) passes the rest to its siblings by
their weights, and only what these can't use goes back to be shared further up. Each leaf then takes a prefix, by
tokens, of its seeded epochs.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import Scratch

#: Slices of a leaf's seeded order; each is summed up by itself and only the one in which the budget ends is walked.
SLICES = 16_384
#: What a budget may lack to the next whole token by rounding.
TINY = 1e-6


def share(budget: float, weights: Mapping[str, float], capacity: Mapping[str, float]) -> dict[str, float]:
    """budget by weights, none above its capacity; what a full one leaves goes to the others by their weights."""
    out = dict.fromkeys(weights, 0.0)
    open_, left = {k for k, w in weights.items() if w > 0 and capacity[k] > 0}, float(budget)
    while open_ and left > 1e-9:
        total = sum(weights[k] for k in sorted(open_))
        full = {k for k in open_ if out[k] + left * weights[k] / total >= capacity[k]}
        if not full:
            for k in open_:
                out[k] += left * weights[k] / total
            break
        for k in sorted(full):
            left -= capacity[k] - out[k]
            out[k] = float(capacity[k])
        open_ -= full
    return out


def budgets(leaves: dict[tuple, int], weights: Mapping[tuple, float], total: float, epochs: int) -> dict[tuple, int]:
    """Tokens for each leaf of a small tree. leaves: its path and the tokens it holds; weights: of paths of any depth,
    1 for others. plan() does the same for a table."""
    out: dict[tuple, int] = {}

    def spread(prefix: tuple, paths: list[tuple], budget: float) -> None:
        if len(paths) == 1 and paths[0] == prefix:
            out[prefix] = int(budget + TINY)
            return
        below: dict[tuple, list[tuple]] = {}
        for p in sorted(paths):
            below.setdefault(p[: len(prefix) + 1], []).append(p)
        capacity = {k: epochs * sum(leaves[p] for p in v) for k, v in below.items()}
        for k, b in share(budget, {k: weights.get(k, 1.0) for k in below}, capacity).items():
            spread(k, below[k], b)

    if leaves:
        spread((), list(leaves), min(float(total), float(epochs * sum(leaves.values()))))
    return out


def plan(leaves: DataFrame, depth: int, weights: Mapping[tuple, float], total: float | None, fraction: float, epochs: int) -> DataFrame:
    """leaf, held, budget of leaves(leaf array<string>, held): budgets from the root down, one level of the tree at a
    time. Of a node's children, in the order of capacity over weight, those that their share by weight would overfill
    come first and get what they hold; all others share the rest by weight. No tree on the driver."""
    spark = leaves.sparkSession
    whole = leaves.agg(F.sum("held").alias("all"))
    budget = F.least(F.lit(float("inf")) if total is None else F.lit(float(total)), F.col("all") * float(epochs))
    wanted = budget if total is not None else F.least(budget, F.col("all") * float(fraction))
    nodes = whole.select(F.expr("cast(array() as array<string>)").alias("up"), wanted.alias("share"))
    given = spark.createDataFrame([(list(k), float(v)) for k, v in weights.items()], "node array<string>, w double")
    for d in range(1, depth + 1):
        own = leaves.groupBy(F.slice("leaf", 1, d).alias("node")).agg((F.sum("held") * float(epochs)).alias("room"))
        own = own.join(given, "node", "left").select("node", F.slice("node", 1, d - 1).alias("up"), "room", F.coalesce("w", F.lit(1.0)).alias("w"))
        able = (F.col("w") > 0) & (F.col("room") > 0)
        own = own.withColumn("w", F.when(able, F.col("w")).otherwise(0.0)).withColumn("ratio", F.when(able, F.col("room") / F.col("w")))
        before = Window.partitionBy("up").orderBy(F.asc_nulls_first("ratio"), "node").rowsBetween(Window.unboundedPreceding, -1)
        spent = F.coalesce(F.sum(F.when(F.col("w") > 0, F.col("room"))).over(before), F.lit(0.0))
        rest = F.sum("w").over(Window.partitionBy("up")) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
        own = own.withColumns({"spent": spent, "rest": rest}).join(nodes, "up")
        # The first child that the shares don't overfill sets what a weight of 1 gets
        fits = (F.col("w") > 0) & (F.col("spent") + F.col("ratio") * F.col("rest") >= F.col("share"))
        unit = F.min(F.when(fits, F.struct("ratio", "node", ((F.col("share") - F.col("spent")) / F.col("rest")).alias("unit")))).over(Window.partitionBy("up"))
        own = own.withColumn("unit", unit["unit"])
        got = F.when(F.col("w") == 0, 0.0).when(F.col("unit").isNull(), F.col("room")).otherwise(F.least("room", F.col("w") * F.col("unit")))
        nodes = own.select(F.col("node").alias("up"), got.alias("share"))
    return leaves.join(nodes.withColumnRenamed("up", "leaf"), "leaf").select("leaf", "held", F.floor(F.col("share") + TINY).cast("long").alias("budget"))


def mix(docs: DataFrame, levels: list, weights: Mapping[tuple, float] | None = None, total: float | None = None, fraction: float = 1.0, epochs: int = 1, tokens=None, seed: int = 3, key: str = "doc_id") -> DataFrame:
    """The rows of docs that fill the budget, with `epoch` (int, from 0); a row comes once for each epoch taken.

    levels: columns or expressions from the root's children to the leaves; null is a value of its own, "". weights of
    paths, such as ("web",) or ("web", "en"), are relative to siblings; others count 1. tokens: an expression for a
    row's length, by default the number of words. total: tokens to take, by default `fraction` of what one epoch holds.
    A leaf takes rows in the order of a seeded hash, another in each epoch, as long as their tokens fit into its
    budget: the first row that would pass it ends the prefix. Rows that repeat a key follow each other by a hash of
    the whole row. Rows without tokens cost nothing and come while the prefix lasts. A column of docs named epoch is
    replaced, all others stay; an empty table stays empty.

    Work: one pass sums tokens by leaf, epoch and slice of the leaf's order before the shuffle; budgets are planned on
    these sums. A second pass takes whole slices by a comparison; only the slice in which a budget ends is sorted, so
    a source with a third of all rows weighs no more on a task than another.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != "epoch"))
    path = F.array(*(F.coalesce((F.col(x) if isinstance(x, str) else x).cast("string"), F.lit("")) for x in levels))
    size = tokens if tokens is not None else F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(path.alias("leaf"), F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("n"), F.col(f"`{key}`").cast("string").alias("key"), F.struct(*columns).alias("given"))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("key")).cast("binary"))
    drawn = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("order", order)
    drawn = drawn.withColumn("slice", (F.conv(F.substring("order", 1, 4), 16, 10).cast("long") * SLICES / 65536).cast("int"))
    sums = scratch.cut(drawn.groupBy("leaf", "epoch", "slice").agg(F.sum("n").alias("n")))
    leaves = scratch.cut(sums.where("epoch = 0").groupBy("leaf").agg(F.sum("n").alias("held")))
    wanted = plan(leaves, len(levels), weights or {}, total, fraction, epochs).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    wanted = wanted.withColumn("left", F.col("budget") - F.col("epoch") * F.col("held")).where("left > 0 or (epoch = 0 and held = 0)").select("leaf", "epoch", "left")
    wanted = scratch.cut(wanted)
    running = Window.partitionBy("leaf", "epoch").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = sums.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0).cast("long"))).join(wanted, ["leaf", "epoch"])
    ends = slices.where("before <= left and before + n > left").groupBy("leaf", "epoch").agg(F.min_by(F.struct("slice", "before"), "slice").alias("x"))
    decided = scratch.cut(wanted.join(ends, ["leaf", "epoch"], "left").select("leaf", "epoch", "left", F.col("x.slice").alias("end"), F.col("x.before").alias("before")))
    scratch.drop(sums, leaves, wanted)
    marked = drawn.join(decided, ["leaf", "epoch"])
    whole = marked.where("end is null or slice < end")
    inside = Window.partitionBy("leaf", "epoch").orderBy("order", "key", F.xxhash64("given")).rowsBetween(Window.unboundedPreceding, 0)
    part = marked.where("slice = end").withColumn("run", F.sum("n").over(inside)).where("before + run <= left")
    out = [F.col("given").getField(c).alias(c) for c in docs.columns]
    return whole.select(*out, "epoch").unionByName(part.select(*out, "epoch"))
