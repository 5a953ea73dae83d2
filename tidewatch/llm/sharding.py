"""A two-pass external shuffle: records are scattered over buckets that fit in memory by seeded hashes, then each
bucket is shuffled by Fisher-Yates. All of it is DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import Scratch, without

#: Bytes of text in a bucket, on average.
BUCKET_BYTES = 4 << 20


def shard_of(key: str, shards: int, seed: int) -> str:
    """SQL for the shard of a key: that of the largest of one seeded hash for each shard. With one more shard a key
    stays or goes into the new one."""
    return f"array_max(transform(sequence(0, {shards - 1}), j -> struct(xxhash64({key}, j, {seed}L) as h, j as j))).j"


def shuffle_shards(docs: DataFrame, shards: int = 40, seed: int = 7, text: str = "text", key: str = "doc_id", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with shard (int), slot (long, gapless from 0 in each shard, in shuffled order) and grown_shard (int, the
    shard if there were one more).

    The key and the number of shards alone decide the shard. Rows with equal or null keys share a shard, in which
    their texts deal them over its buckets; null texts weigh nothing. An empty table stays empty. Columns named as the new ones are replaced, all others stay.

    Work: one pass adds up bytes to size the buckets, one counts keys by bucket for each bucket's first slot, and one
    scatters whole records over the buckets, which is the only shuffle of texts. A bucket is one array in memory; its
    number of rows is chosen by hash, so hot sources are spread. No shuffle follows the random step (write_shards() cuts before its own), and a
    bucket is shuffled in one task, so a task that runs again after a lost executor renumbers whole buckets only.
    """
    docs = without(docs, "shard", "slot", "grown_shard")
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
    parts = max(1, -(-total // (shards * bucket_bytes)))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("content"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    new = f"xxhash64(key, {shards}, {seed}L) > array_max(transform(sequence(0, {shards - 1}), j -> xxhash64(key, j, {seed}L)))"
    placed = rows.withColumn("shard", F.expr(shard_of("key", shards, seed)).cast("int"))
    placed = placed.withColumns({"part": F.pmod(F.xxhash64("key", F.lit(seed), F.lit("bucket"), "content"), F.lit(parts)), "grown": F.when(F.expr(new), shards).otherwise(F.col("shard"))})
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("first"))
    record = F.struct(F.xxhash64("key", F.lit(seed), F.lit("order")).alias("h"), "content", "row", "grown")
    buckets = placed.groupBy("shard", "part").agg(F.collect_list(record).alias("rows"))
    sorted_rows = F.array_sort("rows", lambda a, b: F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).when(a["content"] < b["content"], -1).when(a["content"] > b["content"], 1).otherwise(0))
    drawn = buckets.join(offsets, ["shard", "part"]).select("shard", "first", F.posexplode(F.shuffle(sorted_rows, seed)).alias("at", "r"))
    return drawn.select(*(F.col("r.row").getField(c).alias(c) for c in docs.columns), "shard", (F.col("first") + F.col("at")).alias("slot"), F.col("r.grown").cast("int").alias("grown_shard"))


def write_shards(shuffled: DataFrame, path: str, pieces: int = 16) -> None:
    """Writes each shard to its folder, in `pieces` files or fewer of consecutive slots, rows in the order of slots. The
    shuffled rows are written to the shared folder first: a task that runs again must find the slots already drawn."""
    scratch = Scratch(shuffled.sparkSession, "sharding")
    shuffled = scratch.cut(shuffled)
    most = F.max("slot").over(Window.partitionBy("shard"))
    shuffled.withColumn("piece", F.floor(F.col("slot") * pieces / (most + 1)).cast("int")).repartition("shard", "piece").sortWithinPartitions("shard", "slot").drop("piece").write.partitionBy("shard").parquet(path)
    scratch.drop(shuffled)
