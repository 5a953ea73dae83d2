"""Quality classification by nearest-neighbour voting in a latent-semantic space.

Texts are counted by hashed pairs of bytes, weighted by tf-idf and projected on the leading singular vectors of a
bounded sample of labelled texts. The sample's vectors are broadcast; every document takes exact cosines with all of
them, block by block, and the nearest ones vote, each with the weight of its similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import lean, passes, texts_of, tune, word_hashes

#: Hashed pairs, columns that tell of a word said again at once (many, so that they weigh in), latent dimensions, labelled texts that a model is fitted on at most, and neighbours that vote.
PAIRS, STUTTERS, DIMENSIONS, SAMPLE, NEIGHBOURS = 2048, 32, 48, 4096, 9
FEATURES = PAIRS + STUTTERS


def counts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Texts x FEATURES: how often each hashed pair of neighbouring bytes occurs in each text, and how often a word
    is the same as the one before it."""
    n = len(at) - 1
    pair = raw[:-1].astype(np.uint32) << np.uint32(8) | raw[1:] if len(raw) > 1 else np.zeros(0, np.uint32)
    bucket = ((pair * np.uint32(2654435761)) >> np.uint32(32 - 11)).astype(np.int64)
    size = np.diff(at)
    row = np.repeat(np.arange(n), size)[: len(bucket)]
    inside = np.arange(len(bucket)) + 1 < at[1:][row]
    out = np.bincount(row[inside] * FEATURES + bucket[inside], minlength=n * FEATURES).reshape(n, FEATURES).astype(np.float32)
    _, _, of, (h,) = word_hashes(raw, at, fold=True)
    again = np.concatenate([[0, 0], np.cumsum(h[1:] == h[:-1])]) if len(h) else np.zeros(1, np.int64)
    full = of[1:] > of[:-1]
    out[full, PAIRS:] = (again[of[1:]] - again[of[:-1] + full])[full, None]
    return out


@dataclass
class Model:
    """What a document is scored with; its size is bounded by SAMPLE, FEATURES and DIMENSIONS."""

    weight: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int

    def latent(self, count: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space; zero for texts without any feature."""
        x = np.log1p(count) * self.weight
        x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
        x = x @ self.axes
        return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)

    def score(self, count: np.ndarray) -> np.ndarray:
        """Votes of the nearest labelled texts for label 1, by similarity; the share of label 1 for texts near none."""
        near = self.latent(count) @ self.vectors.T
        k = min(self.neighbours, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** 4
        total = weight.sum(axis=1)
        return np.where(total > 1e-9, (weight * self.labels[top]).sum(axis=1) / np.maximum(total, 1e-9), self.prior)


def fit(count: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS) -> Model:
    """A model from counts of labelled texts: tf-idf, a seeded randomised truncated SVD, and the latent vectors."""
    seen = (count > 0).sum(axis=0)
    weight = np.where(seen > 0, np.log((1 + len(count)) / (1 + seen)) + 1, 0).astype(np.float32)
    x = np.log1p(count) * weight
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
    guess = x.T @ (x @ np.random.default_rng(5).standard_normal((x.shape[1], min(dimensions + 8, *x.shape))).astype(np.float32))
    for _ in range(3):
        guess, _ = np.linalg.qr(guess)
        guess = x.T @ (x @ guess)
    base, _ = np.linalg.qr(guess)
    _, _, right = np.linalg.svd(x @ base, full_matrices=False)
    axes = (base @ right[:dimensions].T).astype(np.float32)
    model = Model(weight, axes, np.zeros((0, axes.shape[1]), np.float32), labels.astype(np.float64), float(labels.mean()), neighbours)
    model.vectors = model.latent(count)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, neighbours: int = NEIGHBOURS) -> Model | None:
    """A model from the labelled documents, None if there are none.

    Of labels(doc_id, quality) only rows with both values, and with crc32(doc_id) mod 5 other than 0, are used, and of
    these the `sample` first in the order of a hash of doc_id. Of several labels of a doc_id the smallest counts, of
    several texts that of the smallest hash, so that the sample is bounded in rows too. The bound keeps what is broadcast the same size for
    every corpus; a labelled text of any length counts whole.
    """
    tune(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").where(~held_out())
    picked = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    texts = texts.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = texts_of(batch.column(2))
            for a, b in passes(at):
                c = counts(raw[at[a] : at[b]], at[a : b + 1] - at[a]).astype(np.uint32)
                rows, columns = np.nonzero(c)
                ends = np.searchsorted(rows, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.ListArray.from_arrays(ends, pa.array(columns.astype(np.int16))), pa.ListArray.from_arrays(ends, pa.array(c[rows, columns].astype(np.int32)))], ["doc_id", "quality", "at", "n"])

    rows = texts.mapInArrow(lean(run), "doc_id long, quality int, at array<short>, n array<int>").toArrow().sort_by("doc_id")
    if not len(rows):
        return None
    count = np.zeros((len(rows), FEATURES), np.float32)
    for i, (where, n) in enumerate(zip(rows.column("at"), rows.column("n"), strict=True)):
        count[i, np.array(where.values, np.int64)] = np.array(n.values)
    return fit(count, np.array(rows.column("quality")), neighbours=neighbours)


def held_out(key: str = "doc_id"):
    """Whether a row's label is kept from training: crc32 of doc_id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, model: Model | None, out: str = "score") -> DataFrame:
    """docs with the score (double, 0 to 1, higher: label 1 likelier) of each whole text.

    Only the text is an input. Null and empty texts, and texts near no labelled one, score the share of label 1 among
    the labelled; without a model every score is 1, so that nothing is rejected unseen. A column named as the new one
    is replaced. No shuffle; the model is broadcast (3 MB at most).
    """
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    docs = docs.select(*(F.col(f"`{c}`") for c in kept))
    if model is None:
        return docs.withColumn(out, F.lit(1.0))
    tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.withColumn(out, F.lit(1.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            raw, at = texts_of(batch.column(batch.schema.get_field_index("text")))
            for a, b in passes(at):
                got = []
                for x in range(a, b, 512):
                    y = min(b, x + 512)
                    got.append(own.score(counts(raw[at[x] : at[y]], at[x : y + 1] - at[x])))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(np.concatenate(got))], [*batch.schema.names, out])

    return docs.mapInArrow(lean(run), schema)
