"""Nearest neighbours by cosine: a vantage-point tree for each shard, searched for a block of queries at a time.

On unit vectors the chord is a metric that orders as the cosine does. A side of a node is passed over if the triangle
inequality puts it farther away than `factor` times the k-th best chord so far; factor 1 makes the search exact,
smaller ones trade recall for work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import shuffle_parts

#: Vectors in a shard, queries in a block, and vectors in a leaf, at most on average.
SHARD_ROWS, BLOCK_QUERIES, LEAF = 65_536, 8_192, 256
#: Rows kept beyond the k nearest, so that rounding in the tree can't decide between near ties.
SLACK = 8
#: Rows of a shard that a query with near ties is held against at a time.
BLOCK_ROWS = 4096


class Tree:
    """A vantage-point tree over unit vectors, as nested (vantage row, median chord, inner, outer) or leaf rows."""

    def __init__(self, unit: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.unit, self.ids, self.leaf = unit, ids, leaf
        self.root = self._build(np.arange(len(unit)), np.random.default_rng(11))

    def _build(self, rows: np.ndarray, rng):
        if len(rows) <= self.leaf:
            return rows
        pick = rng.integers(len(rows))
        vantage, rest = rows[pick], np.delete(rows, pick)
        chord = self._chord(self.unit[rest] @ self.unit[vantage])
        middle = np.median(chord)
        inner = chord <= middle
        if inner.all():
            return rows
        return vantage, middle, self._build(rest[inner], rng), self._build(rest[~inner], rng)

    @staticmethod
    def _chord(cosine: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * cosine))

    def search(self, unit: np.ndarray, ids: np.ndarray, k: int, factor: float):
        """Cosines and rows of the k nearest of each query, -inf and -1 where there are fewer."""
        best = np.full((len(unit), k), -np.inf)
        rows = np.full((len(unit), k), -1)

        def offer(q: np.ndarray, own: np.ndarray, cosine: np.ndarray) -> None:
            cosine = np.where(self.ids[own][None, :] == ids[q][:, None], -np.inf, cosine)
            use = cosine.max(axis=1) >= best[q, -1]
            if not use.any():
                return
            q, cosine = q[use], cosine[use]
            both = np.concatenate([best[q], cosine], axis=1)
            which = np.concatenate([rows[q], np.broadcast_to(own, cosine.shape)], axis=1)
            order = np.lexsort((np.where(which < 0, np.iinfo(np.int64).max, self.ids[which]), -both), axis=1)[:, :k]
            best[q] = np.take_along_axis(both, order, 1)
            rows[q] = np.take_along_axis(which, order, 1)

        def visit(node, q: np.ndarray) -> None:
            if not len(q):
                return
            if isinstance(node, np.ndarray):
                for a in range(0, len(node), 4 * self.leaf):
                    offer(q, node[a : a + 4 * self.leaf], unit[q] @ self.unit[node[a : a + 4 * self.leaf]].T)
                return
            vantage, middle, inner, outer = node
            cosine = unit[q] @ self.unit[vantage]
            offer(q, np.array([vantage]), cosine[:, None])
            chord = self._chord(cosine)
            near = chord <= middle
            visit(inner, q[near])
            visit(outer, q[~near])
            reach = np.where(np.isfinite(best[q, -1]), factor * self._chord(best[q, -1]), np.inf) + 1e-6
            visit(outer, q[near & (chord + reach >= middle)])
            reach = np.where(np.isfinite(best[q, -1]), factor * self._chord(best[q, -1]), np.inf) + 1e-6
            visit(inner, q[~near & (chord - reach <= middle)])

        visit(self.root, np.arange(len(unit)))
        best[rows < 0] = -np.inf
        return best, rows


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _settle(wanted: np.ndarray, wanted_length: float, own: int, given: np.ndarray, length: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k nearest of one query by its cosines with all of a shard, BLOCK_ROWS rows at a time, so that ties of
    any number take the memory of a block."""
    rows, score = np.zeros(0, np.int64), np.zeros(0)
    for a in range(0, len(ids), BLOCK_ROWS):
        b = min(a + BLOCK_ROWS, len(ids))
        got = np.arange(a, b)[ids[a:b] != own]
        rows = np.concatenate([rows, got])
        score = np.concatenate([score, (wanted * given[got]).sum(axis=1) / (wanted_length * length[got])])
        best = np.lexsort((ids[rows], -score))[:k]
        rows, score = rows[best], score[best]
    return rows


def nearest(vectors: DataFrame, query: str, k: int = 5, factor: float = 1.0, id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest other rows of every row for which `query` holds.

    score is the cosine in double precision on the vectors as given; larger comes first, then the smaller id; fewer
    rows come if there are fewer candidates. Rows without an id, and vectors that are null, zero, or have null or
    non-finite components take no part. Vectors are compared with those of the same length. Rows that repeat an id
    are candidates of their own, but never of a query with that id. Other columns are neither read nor returned.

    Work: shards are dealt by a hash of the id, and each block of queries goes to every shard (queries x shards cross
    the network). Of equal vectors a shard keeps the k + 1 rows of smallest id, which can't change a result.
    """
    spark = vectors.sparkSession
    good = f"size(`{vector}`) > 0 and forall(`{vector}`, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(`{vector}`, x -> x <> 0)"
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.expr(query).alias("asks")).where(F.expr(f"vec_id is not null and v is not null and {good.replace(f'`{vector}`', 'v')}"))
    total, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    shards = max(shuffle_parts(spark), -(-total // shard_rows))
    blocks = max(1, -(-asking // BLOCK_QUERIES))
    keyed = rows.withColumns({"dim": F.size("v"), "h": F.xxhash64("vec_id")})
    left = keyed.select("dim", F.pmod("h", F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v")
    right = keyed.where("asks").select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(F.shiftright("h", 20), F.lit(blocks)).cast("int").alias("block"), "vec_id", "v")

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not len(own) or not len(asked):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        ids, given = own.column("vec_id").to_numpy(), _matrix(own.column("v"))
        order = np.argsort(ids, kind="stable")
        ids, given = ids[order], given[order]
        _, same = np.unique(given, axis=0, return_inverse=True)
        by = np.argsort(same.ravel(), kind="stable")
        first = np.concatenate([[True], np.diff(same.ravel()[by]) != 0])
        place = np.arange(len(by)) - np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
        keep = np.sort(by[place <= k])
        ids, given = ids[keep], given[keep]
        length = np.sqrt((given * given).sum(axis=1))
        asked_ids, wanted = asked.column("vec_id").to_numpy(), _matrix(asked.column("v"))
        wanted_length = np.sqrt((wanted * wanted).sum(axis=1))
        best, found = Tree(given / length[:, None], ids).search(wanted / wanted_length[:, None], asked_ids, k + SLACK, factor)
        exact = lambda q, r: (wanted[q] * given[r]).sum(axis=1) / (wanted_length[q] * length[r])
        q, c = np.nonzero(found >= 0)
        r = found[q, c]
        # A query whose spare rows are all as near as its k-th is settled against the whole shard
        close = np.flatnonzero((found[:, -1] >= 0) & (best[:, k - 1] - best[:, -1] < 1e-11))
        if len(close):
            q, r = q[~np.isin(q, close)], r[~np.isin(q, close)]
            settled = [_settle(wanted[i], wanted_length[i], asked_ids[i], given, length, ids, k) for i in close]
            q = np.concatenate([q, np.repeat(close, [len(x) for x in settled])])
            r = np.concatenate([r, *settled])
        score = exact(q, r)
        order = np.lexsort((ids[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        first = np.searchsorted(q, q)
        near = np.arange(len(q)) - first < k
        q, r, score = q[near], r[near], score[near]
        return pa.table([pa.array(asked_ids[q]), pa.array(ids[r]), pa.array(score)], names=names)

    key = ["dim", "shard", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
