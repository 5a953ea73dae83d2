"""Toxicity by compression distance: windows of a text are compressed with a dictionary of ordinary text and with one of
toxic text, and what the second saves tells of toxicity.

Both dictionaries are trained on a bounded sample of labelled texts. The ordinary one holds the commonest words of
ordinary texts. The toxic one holds the beginnings of words that set toxic texts apart, and then the same ordinary
words in the same places: a window that says nothing toxic compresses alike with both, so that a few bytes saved are
evidence. The largest savings of a text and its number of windows are held against thresholds calibrated on texts
that the dictionaries in use for them have not seen (two folds).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import SPACE, lean, passes, texts_of, tune, words_in

#: Bytes of a window, zstandard's level, bytes of ordinary words in both dictionaries, and fragments of the toxic one.
WINDOW, LEVEL, ORDINARY_BYTES, FRAGMENTS = 64, 6, 30_000, 100
#: Labelled texts of each label that dictionaries are trained on at most, in the order of a hash of doc_id.
SAMPLE = {1: 2048, 0: 4096}
#: Lengths of a fragment (a space and the beginning of a word), and how much commoner it must be in toxic text (e to this power).
SHORTEST, LONGEST, CONTRAST = 5, 14, 3.5
#: Bytes at which a word without an end is cut into windows all the same.
LONG = 4096
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[SPACE] = 32


def held_out(key: str = "doc_id"):
    """Whether a row's label is kept from training: crc32 of doc_id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def windows(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts laid end to end, folded, a space before each; where each window begins, and n+1 offsets of the texts' first
    windows. Windows begin before words, about WINDOW bytes apart, and together hold every byte."""
    n = len(at) - 1
    raw = _FOLD[np.insert(raw, at[:-1], 32)] if n else raw
    at = at + np.arange(n + 1)
    words, ends, _ = words_in(raw, at)
    before = words - 1
    place = before - at[np.searchsorted(at, before, "right") - 1]
    first = np.ones(len(before), bool)
    first[1:] = (place[1:] // WINDOW != place[:-1] // WINDOW) | (place[1:] < place[:-1])
    long = np.flatnonzero(ends - words > LONG)
    cuts = np.concatenate([at[:-1], before[first], *(np.arange(words[i] + LONG, ends[i], LONG) for i in long)])
    cuts = np.unique(cuts)
    return raw, cuts, np.searchsorted(cuts, at)


@dataclass
class Dictionaries:
    """An ordinary and a toxic dictionary; at most 64 kB together."""

    ordinary: bytes
    toxic: bytes

    def __post_init__(self):
        self._ready = None

    def __getstate__(self):
        return {"ordinary": self.ordinary, "toxic": self.toxic, "_ready": None}

    def savings(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bytes that each window takes with the ordinary dictionary, less those with the toxic one."""
        if self._ready is None:
            self._ready = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (self.ordinary, self.toxic)]
        if not len(starts):
            return np.zeros(0, np.int64)
        size = np.diff(starts, append=len(raw))
        segments = np.stack([starts, size], axis=1).astype(np.uint64)
        took = []
        for one in self._ready:
            out = one.multi_compress_to_buffer(zstandard.BufferWithSegments(raw.tobytes(), segments.tobytes()), threads=1)
            took.append(np.fromiter((len(x) for x in out), np.int64, len(starts)))
        return took[0] - took[1]


#: The three largest savings of a text's windows and the logarithm of their number.
FEATURES = 4


def features(dictionaries: Dictionaries, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Texts x FEATURES."""
    raw, starts, of = windows(raw, at)
    saved = np.maximum(dictionaries.savings(raw, starts), 0)
    row = np.repeat(np.arange(len(at) - 1), np.diff(of))
    order = np.lexsort((-saved, row))
    out = np.zeros((len(at) - 1, FEATURES))
    for k in range(3):
        has = np.flatnonzero(np.diff(of) > k)
        out[has, k] = saved[order[of[has] + k]]
    out[:, 3] = np.log(np.maximum(np.diff(of), 1))
    return out


def fragments(text: bytes) -> set[bytes]:
    """Beginnings of a folded text's words, each with a space before."""
    return {b" " + w[: n - 1] for w in set(text.split()) for n in range(SHORTEST, min(len(w) + 1, LONGEST) + 1)}


def choose(toxic: Counter, ordinary: Counter, toxic_bytes: int, ordinary_bytes: int, texts: int) -> list[bytes]:
    """Fragments that set toxic texts apart, best first; none that lies within one chosen before."""
    scores = {}
    for f, n in toxic.items():
        if n >= max(3, texts // 200):
            value = np.log((n / toxic_bytes) / ((ordinary[f] + 0.5) / ordinary_bytes))
            if value > CONTRAST:
                scores[f] = n * value
    out, within = [], set()
    for f in sorted(scores, key=lambda f: (-scores[f], -len(f), f)):
        if f not in within:
            out.append(f)
            within |= {f[a:b] for a in range(len(f)) for b in range(a + SHORTEST, len(f) + 1)}
        if len(out) == FRAGMENTS:
            break
    return out


def dictionaries(chosen: list[bytes], common: list[bytes]) -> Dictionaries:
    """common: ordinary words, the commonest first. The better a fragment or word, the nearer to the end it stands. What stands before the words is
    filled up to whole steps of 12 bytes, so that zstandard enters the same places of the words in its tables."""
    words, size = [], 0
    for w in common:
        if size + len(w) + 1 > ORDINARY_BYTES:
            break
        words.append(b" " + w)
        size += len(w) + 1
    base = b"".join(reversed(words)) or b" " * 8
    extra = b"".join(reversed(chosen))
    return Dictionaries(base, b" " * (-len(extra) % 12) + extra + base)


@dataclass
class Model:
    """What a text is scored with: two dictionaries, and weights of its features with their constant."""

    dictionaries: Dictionaries
    weights: np.ndarray

    def score(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        x = features(self.dictionaries, raw, at)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve through features of unseen texts, by Newton's method with a slight ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.full(x.shape[1], 1e-2)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + np.diag(ridge), slope)
        w -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> Model | float:
    """A model from labelled documents; the share of label 1 (0 without labels) if a label has fewer than two texts.

    Of labels(doc_id, toxic) only rows with both values whose crc32(doc_id) mod 4 isn't 2 are used; of each label the
    first `sample` doc_ids in the order of a hash. Of several labels of a doc_id the largest counts, of several texts
    that of the smallest hash. Texts don't reach the driver: it gets counts of fragments and words above a floor, and
    four numbers for each text of the sample.
    """
    spark, sample = docs.sparkSession, SAMPLE if sample is None else sample
    tune(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not shares.get(1) or not shares.get(0):
        return float(shares.get(1, 0) > 0)
    share = shares[1] / (shares[0] + shares[1])
    picked = known.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample[1]).unionByName(known.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample[0]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).cast("int")).cache()
    try:
        return _fit(texts, share)
    finally:
        texts.unpersist()


def _fit(texts: DataFrame, share: float) -> Model | float:
    fold = _FOLD.tobytes()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for toxic, part, text in zip(batch.column("toxic").to_pylist(), batch.column("fold").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                text = (text or b"").translate(fold)
                found[(toxic, part, "bytes", b"")] += len(text)
                found[(toxic, part, "texts", b"")] += 1
                found.update((toxic, part, "fragment", f) for f in fragments(text))
                if not toxic:
                    found.update((0, part, "word", w) for w in text.split() if len(w) < 64)
            columns = list(zip(*found, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.binary()), pa.array(list(found.values()), pa.int64())], ["toxic", "fold", "kind", "what", "n"])

    sums = texts.select("toxic", "fold", "text").mapInArrow(lean(counted), "toxic int, fold int, kind string, what binary, n long")
    wide = sums.groupBy("kind", "what").agg(*(F.coalesce(F.sum(F.when((F.col("toxic") == t) & (F.col("fold") == p), F.col("n"))), F.lit(0)).alias(f"n{t}{p}") for t in (0, 1) for p in (0, 1))).cache()
    totals = {r["kind"]: r for r in wide.where("kind in ('bytes', 'texts')").collect()}
    if "texts" not in totals or totals["texts"]["n10"] + totals["texts"]["n11"] < 2 or totals["texts"]["n00"] + totals["texts"]["n01"] < 2:
        wide.unpersist()
        return share
    most = ORDINARY_BYTES // 2
    floor = f"n10 + n11 >= 3 and (n10 + n11) * {totals['bytes']['n00'] + totals['bytes']['n01'] + 1} > 8 * (n00 + n01) * {totals['bytes']['n10'] + totals['bytes']['n11'] + 1}"
    cut = wide.where("kind = 'fragment'").where(floor).orderBy(F.expr("(n10 + n11) * (n10 + n11) / (n00 + n01 + 0.5)").desc(), "what").limit(20_000).collect()
    words = {p: [bytes(r["what"]) for r in wide.where(f"kind = 'word' and {by} > 0").orderBy(F.expr(by).desc(), "what").limit(most).select("what").collect()] for p, by in ((0, "n00"), (1, "n01"), (None, "n00 + n01"))}
    wide.unpersist()

    def made(folds: tuple[int, ...], common: list[bytes]) -> Dictionaries:
        toxic, ordinary = Counter(), Counter()
        for r in cut:
            toxic[bytes(r["what"])] = sum(r[f"n1{p}"] for p in folds)
            ordinary[bytes(r["what"])] = sum(r[f"n0{p}"] for p in folds)
        size = {t: max(1, sum(totals["bytes"][f"n{t}{p}"] for p in folds)) for t in (0, 1)}
        return dictionaries(choose(toxic, ordinary, size[1], size[0], sum(totals["texts"][f"n1{p}"] for p in folds)), common)

    unseen = [made((1,), words[1]), made((0,), words[0])]  # fold 0 is looked at with what fold 1 gave, and the reverse

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = texts_of(batch.column("text"))
            both = np.stack([features(d, raw, at) for d in unseen])
            own = both[batch.column("fold").to_numpy(), np.arange(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *(pa.array(own[:, k]) for k in range(FEATURES))], ["doc_id", "toxic", *(f"x{k}" for k in range(FEATURES))])

    rows = texts.select("doc_id", "toxic", "fold", "text").mapInArrow(lean(looked), "doc_id long, toxic int, " + ", ".join(f"x{k} double" for k in range(FEATURES))).toArrow().sort_by("doc_id")
    y = rows.column("toxic").to_numpy().astype(float)
    x = np.column_stack([rows.column(f"x{k}").to_numpy() for k in range(FEATURES)])
    weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    return Model(made((0, 1), words[None]), calibrate(x, y, weight))


def score(docs: DataFrame, model: Model | float, out: str = "score") -> DataFrame:
    """docs with the score (double, 0 to 1, higher: label 1 likelier) of each whole text.

    Only the text is an input. Null and empty texts score as one window without any saving; without a model all score
    the share of label 1. Equal texts score equally; a column named as the new one is replaced. No shuffle; the
    model is broadcast (64 kB at most).
    """
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    docs = docs.select(*(F.col(f"`{c}`") for c in kept))
    if not isinstance(model, Model):
        return docs.withColumn(out, F.lit(float(model)))
    tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.withColumn(out, F.lit(1.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            raw, at = texts_of(batch.column(batch.schema.get_field_index("text")))
            for a, b in passes(at):
                got = own.score(raw[at[a] : at[b]], at[a : b + 1] - at[a])
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(got)], [*batch.schema.names, out])

    return docs.mapInArrow(lean(run), schema)
