"""Dataset control: splits, audits, overlays, manifests and paired comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.operators.ranks import range_of, ranked


def read_series(spark: SparkSession, root: str, split: str | None = None, limit: int | None = None, config_hash: str | None = None, key: str = "series_id", checked: bool = False) -> DataFrame:
    """Series of a folder, of one split (a partition column) and configuration; a limit takes the smallest keys.

    Rows of another configuration are passed over, or with `checked` fail the scan at the first, as do rows without one.
    """
    out = spark.read.parquet(root)
    if split is not None:
        out = out.where(F.col("split") == split)
    if config_hash is not None:
        own = F.get_json_object("meta", "$.config_hash")
        if checked:
            wrong = F.raise_error(F.concat(F.lit(f"a row of another configuration, {key} "), F.col(key).cast("string"))).cast("string")
            out = out.withColumn("meta", F.when(own == config_hash, F.col("meta")).otherwise(wrong))
        else:
            out = out.where(own == config_hash)
    return out if limit is None else out.orderBy(key).limit(limit)


def write_series(series: DataFrame, path: str, rows_per_file: int, key: str = "series_id") -> None:
    """Range-partitioned, sorted write with at most rows_per_file rows in a file."""
    series.repartitionByRange(key).sortWithinPartitions(key).write.option("maxRecordsPerFile", rows_per_file).parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, sha256 and rows of every Parquet file under a path."""
    name = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1)
    digests = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"))
    rows = spark.read.parquet(path).groupBy(name.alias("file")).agg(F.count("*").alias("rows"))
    return digests.join(rows, "file", "left").select("file", "sha256", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"))


def verify_files(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """Files that don't agree with a manifest, and how: missing, unknown, digest or rows."""
    own = manifest(spark, path).toDF("file", "sha256_b", "rows_b")
    both = known.select("file", "sha256", "rows").join(own, "file", "full")
    fault = F.when(F.col("sha256_b").isNull(), "missing").when(F.col("sha256").isNull(), "unknown").when(F.col("rows") != F.col("rows_b"), "rows").when(F.col("sha256") != F.col("sha256_b"), "digest")
    return both.withColumn("fault", fault).where("fault is not null").select("file", "fault")


def audit_samples(samples: DataFrame, units: DataFrame) -> DataFrame:
    """rule, series_id of violations: times that don't increase, events outside the record, values that aren't finite,
    duplicate units."""
    w = Window.partitionBy("series_id").orderBy("i")
    stuck = samples.withColumn("pt", F.lag("t").over(w)).where("t <= pt").select(F.lit("time").alias("rule"), "series_id")
    wild = samples.where("isnan(x) or abs(x) = double('infinity')").select(F.lit("finite").alias("rule"), "series_id")
    outside = units.where("t_event < record_start or t_event > record_end").select(F.lit("event").alias("rule"), "series_id")
    twice = units.groupBy("series_id").count().where("count > 1").select(F.lit("unique").alias("rule"), "series_id")
    return stuck.unionByName(wild).unionByName(outside).unionByName(twice).distinct()


def audit_records(samples: DataFrame, units: DataFrame) -> DataFrame:
    """rule, series_id of violations in samples(series_id, i, t, x, dx) and units(series_id, record_start, record_end, t_event):

    time: a time that isn't finite, or doesn't increase with i (samples of one i go by time); before: x or dx that isn't finite at or before the event (anywhere
    without one); after: x or dx that isn't NaN after the event; event: an event outside the record; unique: a series with several
    units, or a place i with several samples; unit: samples without a unit; grid: times other than those of the smallest series_id. Times are compared by
    their number and a digest of places and times, so no series meets another. Nulls count as not finite.
    """
    w = Window.partitionBy("series_id").orderBy("i", "t")
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    one = units.groupBy("series_id").agg(F.min("t_event").alias("t_event"), F.count("*").alias("n"), F.max(((F.col("t_event") < F.col("record_start")) | (F.col("t_event") > F.col("record_end"))).cast("int")).alias("outside"))
    rows = samples.withColumns({"pt": F.lag("t").over(w), "pi": F.lag("i").over(w)}).join(one.select("series_id", "t_event", F.lit(True).alias("known")), "series_id", "left")
    later = F.coalesce(F.col("t") > F.col("t_event"), F.lit(False))
    nan = lambda c: F.coalesce(F.isnan(c), F.lit(False))
    tests = {
        "time": ~finite("t") | (F.col("t") <= F.col("pt")),
        "before": ~later & ~(finite("x") & finite("dx")),
        "after": later & ~(nan("x") & nan("dx")),
        "unique": F.col("i") == F.col("pi"),
        "unit": F.col("known").isNull(),
    }
    flags = rows.groupBy("series_id").agg(*(F.max(F.coalesce(t, F.lit(False)).cast("int")).alias(rule) for rule, t in tests.items()), F.count("*").alias("n"), F.bit_xor(F.xxhash64("i", "t")).alias("digest"))
    first = flags.agg(F.min_by(F.struct("n", "digest"), "series_id").alias("g"))
    flags = flags.crossJoin(F.broadcast(first)).withColumn("grid", (F.struct("n", "digest") != F.col("g")).cast("int"))
    found = [flags.where(F.col(rule) == 1).select(F.lit(rule).alias("rule"), "series_id") for rule in [*tests, "grid"]]
    found += [one.where("outside = 1").select(F.lit("event").alias("rule"), "series_id"), one.where("n > 1").select(F.lit("unique").alias("rule"), "series_id")]
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.distinct()


def outcome_counts(units: DataFrame, by: list[str]) -> DataFrame:
    """by, n, events and the share of units with an event."""
    return units.groupBy(*by).agg(F.count("*").alias("n"), F.count("t_event").alias("events"), F.avg(F.col("t_event").isNotNull().cast("double")).alias("share"))


def assign_split(df: DataFrame, ranges: list[tuple[str, int, int]], key: str) -> DataFrame:
    """df with the split whose half-open range [lo, hi) holds its key, null outside all of them."""
    split = F.lit(None).cast("string")
    for name, lo, hi in ranges:
        split = F.when((F.col(key) >= lo) & (F.col(key) < hi), name).otherwise(split)
    return df.withColumn("split", split)


def assert_split(df: DataFrame, split: str) -> DataFrame:
    """df, failing at the first row of another split."""
    wrong = F.raise_error(F.concat(F.lit(f"a row outside split {split}: "), F.coalesce("split", F.lit("none")))).cast("string")
    return df.withColumn("split", F.when(F.col("split") == split, F.col("split")).otherwise(wrong))


def overlay(base: DataFrame, patch: DataFrame, on: list[str]) -> DataFrame:
    """Rows of base whose group patch doesn't have, and all of patch."""
    return base.join(patch.select(*on).distinct(), on, "left_anti").unionByName(patch)


def restrict(scores: DataFrame, units: DataFrame, lo: Column, hi: Column) -> tuple[DataFrame, DataFrame]:
    """Scores within [lo, hi] (expressions over units) and units with records clipped to it."""
    clipped = units.withColumns({"record_start": F.greatest("record_start", lo), "record_end": F.least("record_end", hi)}).where("record_start <= record_end")
    return scores.join(clipped.select("series_id", "record_start", "record_end"), "series_id").where("t >= record_start and t <= record_end").drop("record_start", "record_end"), clipped


def take_rows(units: DataFrame, quota: int) -> DataFrame:
    """All units without an event and the `quota` with one of smallest id, ranked by ranges of ids."""
    with_event = units.where("t_event is not null")
    first = ranked(with_event, [], ["series_id"], range_of(with_event, "series_id"), "_k").where(F.col("_k") <= quota).drop("_k")
    return units.where("t_event is null").unionByName(first)


def take_half(units: DataFrame, second: bool = False) -> DataFrame:
    """The first half of the units by series_id (n // 2 of them), or the second. The border is found from counts by
    ranges of ids, of which there are 1,024, so that no task orders all units."""
    low, high, n = units.agg(F.min("series_id"), F.max("series_id"), F.count("*")).first()
    rank = n // 2
    while rank and high > low:
        width = -(-(high - low + 1) // 1024)
        part = F.floor((F.col("series_id") - low) / width).cast("long")
        seen = 0
        for r in units.where(F.col("series_id").between(low, high)).groupBy(part.alias("part")).count().orderBy("part").collect():
            if seen + r["count"] >= rank:
                low, high, rank = low + r.part * width, min(high, low + (r.part + 1) * width - 1), rank - seen
                break
            seen += r["count"]
    first = F.col("series_id") <= high if n // 2 else F.lit(False)
    return units.where(~first if second else first)


def union_campaigns(parts: dict[str, DataFrame]) -> DataFrame:
    """All rows, each with the name of its campaign."""
    out = None
    for name, df in parts.items():
        one = df.withColumn("campaign", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def rotations(df: DataFrame, group: str) -> DataFrame:
    """Every row once for each group held out, with role test or train."""
    held = df.select(F.col(group).alias("held_out")).distinct()
    return df.join(F.broadcast(held)).withColumn("role", F.when(F.col(group) == F.col("held_out"), "test").otherwise("train"))


def paired_compare(a: DataFrame, b: DataFrame, on: str, tolerance: float) -> DataFrame:
    """Outcome times (null: none) of the same keys in two runs: pairs, discordant, both, median and largest
    difference, shift of prevalence, pairs over the tolerance."""
    both = a.select(on, F.col("t_event").alias("ta")).join(b.select(on, F.col("t_event").alias("tb")), on)
    gap = F.abs(F.col("ta") - F.col("tb"))
    return both.agg(F.count("*").alias("pairs"), F.count_if(F.col("ta").isNull() != F.col("tb").isNull()).alias("discordant"), F.count_if(gap.isNotNull()).alias("both"), F.percentile(gap, F.lit(0.5)).alias("median_gap"), F.max(gap).alias("largest_gap"), (F.avg(F.col("tb").isNotNull().cast("double")) - F.avg(F.col("ta").isNotNull().cast("double"))).alias("shift"), F.count_if(gap > tolerance).alias("over"))
