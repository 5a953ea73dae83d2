"""Event tables as streams, and finite streams run to their end."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.tables import EPOCH, read


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, t, x, ts of the events table as a stream of its files."""
    schema = read(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")
    t = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{EPOCH}', ts) / 1e6D")
    return rows.select(F.col("user_id").alias("series_id"), t.alias("t"), F.col("value").alias("x"), F.col("ts").cast("timestamp").alias("ts"), "event_type")


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that a finite stream gives, through a table in the shared folder."""
    spark = stream.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: streams need a folder that all executors share")
    root = root or f"file://{tempfile.mkdtemp(prefix='stream-')}"
    base = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out/{'all' if mode == 'complete' else f'batch={batch}'}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/out")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{base}/out/all" if mode == "complete" else f"{base}/out/*")
