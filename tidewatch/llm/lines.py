"""Line dedup: later copies of repeated runs of lines are deleted.

The suffix array over line ids is built by prefix doubling: places that agree in their next h lines have one name for
them, the first such place, and names for 2h lines are pairs of names for h lines that lie h apart. Each name that
several places share is an interval of the suffix array with a common prefix of that length; a round keeps only such
places, and doubling ends when none is left. Then the steps are walked back by halves to the exact longest common
prefix of every interval: places of an interval that agree in half a step more form one of their own, of which only
the first place stays behind with the others. Every interval names a maximal repeated run; its later places are
copies, which are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import Scratch, without

#: A value that more than one in HOT rows share is hot (so that fewer than HOT values are), and is dealt over SPREAD parts.
HOT, SPREAD = 1024, 64

_PLACE = ["id", "th", "line"]


def _place(prefix: str = "") -> Column:
    return F.struct(*(F.col(prefix + c) for c in _PLACE))


def _shared(places: DataFrame, parts: list[str], scratch: Scratch) -> DataFrame:
    """Values of parts that several places have: name (the first of them) and n (rows that have it)."""
    same = places.groupBy(*parts).agg(F.min(_place()).alias("name"), F.max(_place()).alias("last"), F.count("*").alias("n"))
    return scratch.cut(same.where("name < last").drop("last"))


def _joined(places: DataFrame, same: DataFrame, parts: list[str], how: str = "inner") -> DataFrame:
    """places with the name of their parts; rows of hot values are dealt out, those of `same` repeated for each part."""
    total = same.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT > total
    few = F.broadcast(same.where(hot).select(*parts, F.lit(True).alias("hot")))
    dealt = places.join(few, parts, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(*_PLACE), F.lit(SPREAD))).otherwise(0).cast("long")).drop("hot")
    every = F.when(hot, F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return dealt.join(same.select(*parts, "name", F.explode(every).alias("salt")), [*parts, "salt"], how).drop("salt")


def _named(places: DataFrame, parts: list[str], scratch: Scratch) -> DataFrame:
    """The places whose parts others share, with their name in place of the parts."""
    same = _shared(places, parts, scratch)
    out = scratch.cut(_joined(places, same, parts).drop(*parts))
    scratch.drop(same)
    return out


def _doubled(named: DataFrame, step: int) -> DataFrame:
    """Names a, b of each place and of the place `step` lines on in the same text, where both have one."""
    order = Window.partitionBy("id", "th").orderBy("line").rangeBetween(step, step)
    return named.select(*_PLACE, F.col("name").alias("a"), F.first("name").over(order).alias("b")).where("b is not null")


def _intervals(levels: list[DataFrame], scratch: Scratch) -> DataFrame:
    """id, th, line, size, name: for each place the intervals in which it is not a first place of a longer one, by
    their longest common prefix. levels: names of 1, 2, 4, ... lines."""

    def begun(k: int) -> DataFrame:
        rows = levels[k].select(*_PLACE, F.lit(1 << k).alias("size"), "name")
        if k + 1 == len(levels):
            return rows
        return rows.join(levels[k + 1].where(F.col("name") != _place()).select(*_PLACE), _PLACE, "left_anti")

    rows = None
    for j in range(len(levels) - 2, -1, -1):
        rows = begun(j + 1) if rows is None else rows.unionByName(begun(j + 1))
        ahead = levels[j].select("id", "th", F.col("line").alias("at"), F.col("name").alias("b")).distinct()
        tried = scratch.cut(rows.withColumnRenamed("name", "a").withColumn("at", F.col("line") + F.col("size")).join(ahead, ["id", "th", "at"], "left").drop("at"))
        same = _shared(tried.where("b is not null"), ["size", "a", "b"], scratch)
        longer = F.struct((F.col("size") + (1 << j)).alias("size"), "name")
        stays = F.struct("size", F.col("a").alias("name"))
        states = F.when(F.col("name").isNull(), F.array(stays)).when(F.col("name") == _place(), F.array(longer, stays)).otherwise(F.array(longer))
        rows = scratch.cut(_joined(tried, same, ["size", "a", "b"], "left").select(*_PLACE, F.explode(states).alias("s")).select(*_PLACE, "s.*").distinct())
        scratch.drop(tried, same)
    return begun(0) if rows is None else rows.unionByName(begun(0))


def dedup_lines(docs: DataFrame, min_lines: int = 2, text: str = "text", key: str = "doc_id", min_words: int | None = None) -> DataFrame:
    """docs with n_lines, n_removed, longest_run and longest_repeat (all long), and the text without later copies.

    A text's lines are what lies between newlines; a null text has none and stays null, an empty one has one. A line
    is deleted if it lies in a run of `min_lines` lines or more of its text that also begins at an earlier place:
    in a text of smaller key, or further up in the same one. With min_words, a line of so many words or more (as for
    mixing) is such a run by itself, whatever its neighbours; without, lines go only in runs of `min_lines`. Texts
    left without any line are null. Rows with equal key and text are one text: all of them lose the same lines. Null
    keys come first. longest_run is the longest run of neighbouring lines that went, longest_repeat the longest
    maximal run of lines of this text, 1 or more, that is also at another place. Columns named as the new ones are
    replaced, all others stay.

    Work: lines cross the network as two hashes and their place; only places of lines that repeat go further. Names
    are counted with min() before the shuffle; joined back, rows of a name that more than one in 1,024 rows share are
    dealt over 64 parts, so a line in every text doesn't gather in one task. Rounds are twice the logarithm of the
    longest repeat. Texts cross once, to meet the numbers of their deleted lines.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    docs = without(docs, "n_lines", "n_removed", "longest_run", "longest_repeat")
    given = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    keyed = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("th"), F.col(f"`{text}`").cast("string").alias("text"), given.alias("given"))
    lines = keyed.where("text is not null").select("id", "th", F.posexplode(F.split("text", "\n", -1)).alias("line", "s"))
    own = [] if min_words is None else [(F.regexp_count("s", F.lit(r"[^\x20\x09-\x0D]+")) >= min_words).alias("alone")]
    lines = lines.select(*_PLACE, F.xxhash64("s").alias("h"), F.xxhash64(F.lit(1), F.col("s")).alias("g"), *own)
    levels = [_named(lines, ["h", "g"], scratch)]
    while not levels[-1].isEmpty():
        levels.append(_named(_doubled(levels[-1], 1 << (len(levels) - 1)), ["a", "b"], scratch))
    found = scratch.cut(_intervals(levels[:-1] or levels, scratch))
    copies = found.where((F.col("name") != _place()) & (F.col("size") >= min_lines)).select(*_PLACE, "size")
    if own:
        copies = copies.unionByName(levels[0].where(F.col("alone") & (F.col("name") != _place())).select(*_PLACE, F.lit(1).alias("size")))
    before = Window.partitionBy("id", "th").orderBy("line", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("line") + F.col("size")
    new = copies.withColumn("begin", F.greatest("line", F.coalesce(F.max(end).over(before), F.lit(0)))).where(F.col("begin") < end)
    gone = new.groupBy("id", "th").agg(F.flatten(F.collect_list(F.sequence("begin", end - 1))).alias("gone"))
    longest = found.groupBy("id", "th").agg(F.max("size").cast("long").alias("longest"))
    joined = keyed.join(longest.join(gone, ["id", "th"], "left"), ["id", "th"], "left")
    parts = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
    rest = F.when(F.col("gone").isNull(), F.col("text")).when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"))
    run = F.aggregate(F.array_sort("gone"), F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most")), lambda s, i: F.struct(i.alias("last"), F.when(i == s["last"] + 1, s["run"] + 1).otherwise(1).alias("run"), F.greatest(s["most"], F.when(i == s["last"] + 1, s["run"] + 1).otherwise(1)).alias("most")), lambda s: s["most"])
    return joined.select(
        *(rest.alias(c) if c.lower() == text.lower() else F.col("given").getField(c).alias(c) for c in docs.columns),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.coalesce(run, F.lit(0)).cast("long").alias("longest_run"),
        F.coalesce("longest", F.lit(0).cast("long")).alias("longest_repeat"),
    )
