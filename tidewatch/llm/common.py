"""Helpers shared by the corpus operators: scratch tables, and word hashing over Arrow text buffers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on at a time (a longer text is a pass of its own).
PASS_BYTES = 1 << 20


#: Whether Spark removes a job's shuffle files as soon as the job has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the checkpoint folder of the running context.

    Where neither is set, a local session (one machine) gets a temporary folder as its checkpoint folder, once; a
    cluster, whose executors share no such folder, gets an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: corpus operators need a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tidewatch-')}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; drop() removes those that are no longer read, what is left
    goes when the driver's JVM ends. The shuffle files behind a table go when it is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tidewatch-{name}-{uuid.uuid4().hex}"
        self.n = 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        if self.n == 1:
            root, files = self._files(self.root)
            files.deleteOnExit(root)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path, files = self._files(t.scratch_path)
            files.delete(path, True)


def tune(spark: SparkSession) -> None:
    """Texts are long: what goes to Python at a time is at most 1,000 rows and 4 MB (or one row)."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def lean(run):
    """A function of Arrow batches that gives memory back to the system when its task ends; idle workers stay small."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return own


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts of df, counted in one pass."""
    return int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def part_of(keys: np.ndarray, parts: int, bits: int = 64) -> np.ndarray:
    """Which of `parts` equal ranges of numbers of so many bits each of the (sorted) keys lies in."""
    return ((keys >> np.uint64(bits - 32)) * np.uint64(parts)) >> np.uint64(32)


def slices_of(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins, and the borders of all runs."""
    first = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]])) if len(parts) else np.zeros(0, np.int64)
    return parts[first].astype(np.int32), np.append(first, len(parts))


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n+1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        length = np.diff(at) * np.asarray(column.is_valid().to_numpy(zero_copy_only=False), dtype=np.int64)
        raw = np.concatenate([np.zeros(0, np.uint8), *(raw[s : s + n] for s, n in zip(at[:-1], length, strict=True))])
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(length)])
    return raw, at


def passes(at: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together hold about limit bytes."""
    start, n = 0, len(at) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


def gaps(bytes_: bytes) -> np.ndarray:
    """A table that says of each byte whether it stands between words."""
    table = np.zeros(256, bool)
    table[np.frombuffer(bytes_, np.uint8)] = True
    return table


#: What stands between words where nothing else is said.
SPACE = gaps(b" \t\n\v\f\r")
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes or values that a hash is summed over at a time; the tables of powers are no longer, however long a text is.
STEP = 1 << 18


def _byte_values(fold: bool, seed: int) -> np.ndarray:
    values = np.random.default_rng(seed).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
    if fold:
        values[65:91] = values[97:123]
    return values


_VALUES = {(fold, lane): _byte_values(fold, 1009 + lane) for fold in (False, True) for lane in (0, 1)}


def _powers(base: np.uint64) -> np.ndarray:
    step = np.full(STEP + 1, base, np.uint64)
    step[0] = 1
    return np.multiply.accumulate(step)


_UP, _DOWN = _powers(_B), _powers(_B_INV)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over the word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def words_in(raw: np.ndarray, at: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes that aren't gaps) of texts laid end to end: start and end bytes of each, and the n+1
    offsets of each text's first word. Looks at STEP bytes at a time."""
    n = len(raw)
    cuts = at[(at > 0) & (at < n)]
    starts, ends = [], []
    before, word = False, ~gap
    for x in range(0, n, STEP):
        y = min(x + STEP, n)
        dark = word[raw[x:y]]
        left = np.concatenate([[before], dark[:-1]])
        own = cuts[np.searchsorted(cuts, x) : np.searchsorted(cuts, y)] - x
        cut = np.zeros(y - x, bool)
        cut[own] = True
        starts.append(np.flatnonzero(dark & (~left | cut)) + x)
        ends.append(np.flatnonzero(left & (~dark | cut)) + x)
        before = bool(dark[-1])
    first = np.concatenate([np.zeros(0, np.int64), *starts])
    last = np.concatenate([np.zeros(0, np.int64), *ends, [n] if before else []]).astype(np.int64)
    return first, last, np.searchsorted(first, at)


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of each word's byte values, each times B to the power of its place in the word. A word that goes over the
    end of a step is taken up in the next."""
    out = np.zeros(len(starts), np.uint64)
    for x in range(0, len(raw), STEP):
        y = min(x + STEP, len(raw))
        total = np.zeros(y - x + 1, np.uint64)
        np.cumsum(values[raw[x:y]] * _UP[: y - x], out=total[1:])
        a, b = int(np.searchsorted(ends, x, "right")), int(np.searchsorted(starts, y))
        if a == b:
            continue
        s, e = np.maximum(starts[a:b] - x, 0), np.minimum(ends[a:b] - x, y - x)
        part = (total[e] - total[s]) * _DOWN[s]
        if starts[a] < x:
            part[:1] *= np.uint64(pow(int(_B), int(x - starts[a]), 1 << 64))
        out[a:b] += part
    return out


def word_hashes(raw: np.ndarray, at: np.ndarray, fold: bool = False, lanes: int = 1, gap: np.ndarray = SPACE):
    """Words of texts laid end to end.

    Returns the words' start and end bytes, n+1 offsets of each text's first word, and a 64-bit hash of each word
    (a list of `lanes` independent ones). A word's hash depends on its bytes only; with fold, A-Z count as a-z.
    Besides what it returns, 24 bytes for each word and 8 for each further lane, it takes the same memory for every text.
    """
    starts, ends, of = words_in(raw, at, gap)
    size = (ends - starts).astype(np.uint64)
    return starts, ends, of, [mix(_hashes(raw, starts, ends, _VALUES[fold, lane]) ^ size) for lane in range(lanes)]


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of every `width` consecutive values; empty when there are fewer."""
    n = len(h) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    step = max(STEP - width, 1)
    if step < width:
        raise ValueError(f"at most {STEP // 2} values are hashed together")
    for x in range(0, n, step):
        y = min(x + step, n)
        total = np.zeros(y - x + width, np.uint64)
        np.cumsum(h[x : y + width - 1] * _UP[: y - x + width - 1], out=total[1:])
        out[x:y] = mix((total[width:] - total[: y - x]) * _DOWN[: y - x])
    return out


def top(rows: DataFrame, key: list[str], order: list, k: int, salt: int = 64) -> DataFrame:
    """The first k rows of each key, with their rank: first of each of `salt` parts of a key (Spark keeps k of each task
    before it shuffles), then of what these leave."""
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(salt))
    some = rows.withColumn("_part", part).withColumn("_rank", F.row_number().over(Window.partitionBy(*key, "_part").orderBy(*order))).where(F.col("_rank") <= k).drop("_part", "_rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that an operator is about to add."""
    clash = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in clash])
