"""Exact ranks and running sums of large groups without one task for a group: groups are cut into ranges of their order,
each range is numbered by itself, and the counts of the ranges before it are added."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_of(df: DataFrame, column: str, ranges: int | None = None) -> Column:
    """Which of a number of ranges of about equal counts a value of a numeric column lies in: an expression, from
    approximate quantiles of the whole column (one pass; nulls come first). Four ranges for each shuffle partition, 256
    at least, so that they grow in number with what the session is set up for."""
    n = ranges or max(256, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(df.agg(F.percentile_approx(column, [k / n for k in range(1, n)], 20 * n)).first()[0] or []))
    if not cuts:
        return F.lit(0)
    # two steps of about sqrt(n) comparisons: which run of cuts, then where in it
    wide = math.isqrt(len(cuts) - 1) + 1
    runs = [cuts[k : k + wide] for k in range(0, len(cuts), wide)]
    below = lambda values: F.size(F.filter(values, lambda c: c <= F.col(column)))
    array = lambda values: F.array(*(F.lit(c) for c in values))
    run = F.greatest(below(array([r[0] for r in runs])) - 1, F.lit(0))
    return run * wide + below(F.get(F.array(*(array(r) for r in runs)), run))


def digest_range(digest: Column) -> Column:
    """The range of a hexadecimal digest: its first three places, 4,096 ranges without any pass over the data."""
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def ranked(df: DataFrame, by: list[str], order: list, part: Column, rank: str = "rank", size: str | None = None) -> DataFrame:
    """df with the exact row number of each row of a group (`rank`, from 1) and, if named, the group's size.

    part is a range of the order: it must not fall where the order rises. Rows are shuffled once, by group and range;
    the ranges' counts are few rows. order must be total for ranks to be defined; null groups are groups.
    """
    rows = df.withColumn("_part", part)
    inside = rows.withColumn("_own", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)))
    counts = rows.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part") if by else Window.partitionBy(F.lit(0)).orderBy("_part")
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    known = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_size": F.sum("_n").over(whole)})
    keys = [*by, "_part"]
    a, b = inside.alias("a"), known.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), "_before", "_size").alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b._k{i}")) for i, c in enumerate(keys)]
    joined = a.join(b, same)
    extra = [F.col("_size").alias(size)] if size else []
    return joined.select(*(F.col(f"a.{c}") for c in df.columns), (F.col("_own") + F.col("_before")).alias(rank), *extra)


def running(df: DataFrame, by: list[str], order: str, value: str, part: Column, out: str = "before", total: str = "total") -> DataFrame:
    """df with the sum of `value` over a group's rows of smaller order (`before`), and over the whole group."""
    rows = df.withColumn("_part", part)
    earlier = lambda *p: Window.partitionBy(*p).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_own", F.coalesce(F.sum(value).over(earlier(*by, "_part")), F.lit(0)))
    sums = rows.groupBy(*by, "_part").agg(F.sum(value).alias("_s"))
    group = by or [F.lit(0)]
    known = sums.withColumns({"_before": F.coalesce(F.sum("_s").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), total: F.sum("_s").over(Window.partitionBy(*group))})
    keys = [*by, "_part"]
    a, b = inside.alias("a"), known.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), "_before", total).alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b._k{i}")) for i, c in enumerate(keys)]
    return a.join(b, same).select(*(F.col(f"a.{c}") for c in df.columns), (F.col("_own") + F.col("_before")).alias(out), total)
