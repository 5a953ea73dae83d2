"""Ranked lexical search over geometric blocks of posting lists.

Documents are cut into shards, and each shard is an inverted index of its own. A term's posting list is clustered by
the similarity of its documents into blocks; a block keeps a summary, for every term the largest impact that any of
its documents has. A query walks the lists of its terms, strongest first, and skips a block only if the summary's
exact bound on its documents' scores lies below the score that a document needs to be among the best; of the blocks
that are left documents are scored in full. Lists whose bounds together stay below that score are not walked. The
score needed comes first from a seeded share of the documents, and rises within each shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Scratch, gaps, lean, passes, texts_of, top, tune, word_hashes, words_in

#: What stands between terms: all of ASCII but letters and digits.
BETWEEN = gaps(bytes(c for c in range(128) if not chr(c).isalnum()))
#: Distinct terms of the items that are searched together (an item with more is searched by itself), cells of a shard's matrix of
#: documents and terms, documents of a block, dimensions of the projection that similarity is taken in.
TERMS, CELLS, BLOCK, DIMENSIONS = 4096, 16_000_000, 48, 24
#: Tasks that shards are dealt over at most; beyond that a task has several.
TASKS = 20_000


def _terms_of(items: DataFrame) -> DataFrame:
    """(item_id, term) of every item, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = texts_of(batch.column(1))
            starts, ends, of = words_in(raw, at, BETWEEN)
            if len(starts):
                low = raw.copy()
                low[(raw > 64) & (raw < 91)] += 32
                low = low.tobytes()
                words = pa.array([low[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(of)))), words.cast(pa.string())], ["item_id", "term"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "item_id long, term string").distinct()


class Lookup:
    """The terms that are looked for, by hash and then by their bytes."""

    def __init__(self, words: list[bytes]):
        at = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        h = word_hashes(raw, at, fold=True, gap=BETWEEN)[3][0] if words else np.zeros(0, np.uint64)
        if len(np.unique(h)) < len(h):
            raise ValueError("two terms have one hash")
        self.number = np.argsort(h)
        self.known, self.size = h[self.number], np.diff(at)[self.number]
        self.bytes = {int(n): np.stack([raw[at[i] : at[i + 1]] for i in self.number[self.size == n]]) for n in np.unique(self.size)}
        self.place = np.zeros(len(h), np.int64)  # of a term among those of its length
        for n in self.bytes:
            self.place[self.size == n] = np.arange(len(self.bytes[n]))
        self.may = np.zeros(1 << 16, bool)
        self.may[h >> np.uint64(48)] = True

    def find(self, raw: np.ndarray, at: np.ndarray):
        """Number of terms of each text, and (text, term, count) of those that are looked for."""
        starts, ends, of, (h,) = word_hashes(raw, at, fold=True, gap=BETWEEN)
        hit = np.flatnonzero(self.may[h >> np.uint64(48)])
        near = np.minimum(np.searchsorted(self.known, h[hit]), len(self.known) - 1)
        same = (self.known[near] == h[hit]) & (self.size[near] == (ends - starts)[hit])
        hit, near = hit[same], near[same]
        right = np.zeros(len(hit), bool)
        for n, words in self.bytes.items():
            own = np.flatnonzero(self.size[near] == n)
            for x in range(0, len(own), max(1, (1 << 22) // n)):
                some = own[x : x + max(1, (1 << 22) // n)]
                text = raw[starts[hit[some]][:, None] + np.arange(n)]
                text = np.where((text > 64) & (text < 91), text + 32, text)
                right[some] = (text == words[self.place[near[some]]]).all(axis=1)
        row = np.repeat(np.arange(len(at) - 1), np.diff(of))[hit[right]]
        pair, count = np.unique(row * len(self.known) + self.number[near[right]], return_counts=True)
        return np.diff(of), pair // len(self.known), pair % len(self.known), count


def _forward(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, n (terms of the whole text, with repeats), and the numbers and counts of those among `terms`."""
    sent = docs.sparkSession.sparkContext.broadcast(Lookup([t.encode() for t in terms]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = sent.value
        for batch in batches:
            raw, at = texts_of(batch.column(1))
            for a, b in passes(at):
                n, row, number, count = lookup.find(raw[at[a] : at[b]], at[a : b + 1] - at[a])
                ends = pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32))
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.ListArray.from_arrays(ends, pa.array(number.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(count.astype(np.int64)))], ["doc_id", "n", "terms", "counts"])
                yield out.filter(pa.array(n > 0))

    return docs.mapInArrow(lean(run), "doc_id long, n long, terms array<int>, counts array<long>")


def impact(count: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 20 m), m = 50 + (50 n N) div L, of postings; below 10^6."""
    small = 50 * int(n.max(initial=0)) * docs < 1 << 63
    m = 50 + (50 * n * docs // total if small else np.array([50 * int(x) * docs // total for x in n], dtype=np.int64))
    if int(count.max(initial=0)) >= 9 * 10**9:
        return np.array([10**9 * int(c) // (1000 * int(c) + 20 * int(x)) for c, x in zip(count, m, strict=True)], dtype=np.int64)
    return 10**9 * count // (1000 * count + 20 * m)


class Shard:
    """An inverted index of some documents: a matrix of impacts, and for each term that is asked for blocks of its
    posting list with their summaries, made when a query first needs them. with_: for each term all terms that some
    query asks together with it, in order; a summary has these coordinates."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, with_: list[np.ndarray], seed: int = 7):
        self.ids, self.matrix, self.with_ = ids, matrix, with_
        self.most = matrix.max(axis=0).astype(np.float64)
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        direction = np.random.default_rng(seed).standard_normal((matrix.shape[1], DIMENSIONS)).astype(np.float32)
        sketch = matrix @ direction
        self.sketch = sketch / np.maximum(np.sqrt((sketch * sketch).sum(axis=1, keepdims=True)), 1e-9)

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents of the term's list, block by block; where blocks begin, and the list ends; and each block's summary."""
        if term not in self.blocks:
            docs = np.flatnonzero(self.matrix[:, term])
            heads = docs[::BLOCK]
            cuts = np.array([0, len(docs)])
            if len(heads) > 1:
                near = (self.sketch[docs] @ self.sketch[heads].T).argmax(axis=1)
                order = np.argsort(near, kind="stable")
                docs, near = docs[order], near[order]
                cuts = np.flatnonzero(np.concatenate([[True], near[1:] != near[:-1], [True]]))
            own = self.matrix[np.ix_(docs, self.with_[term])]
            self.blocks[term] = docs, cuts, np.stack([own[a:b].max(axis=0) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        return self.blocks[term]

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, need: int, ids: np.ndarray, scores: np.ndarray):
        """The k best of (ids, scores) and this shard's documents; need is a score that the k-th best has at least.
        Sums stay below 2^53 (Index sees to that), so doubles hold them exactly."""
        bound = weights * self.most[terms]
        order = np.argsort(bound, kind="stable")
        below = np.cumsum(bound[order])
        done = np.zeros(len(self.ids), bool)
        for j in range(len(order) - 1, -1, -1):
            if below[j] < max(need, 1):
                break
            term, left = int(terms[order[j]]), order[: j + 1]
            docs, cuts, summary = self.of(term)
            # what this list and the weaker ones can add up to; documents of stronger lists have been looked at
            place = np.searchsorted(self.with_[term], terms[left])
            open_ = summary[:, place].astype(np.float64) @ weights[left] >= max(need, 1)
            found = docs[np.repeat(open_, np.diff(cuts))]
            found = found[~done[found]]
            done[found] = True
            full = (self.matrix[np.ix_(found, terms)].astype(np.float64) @ weights).astype(np.int64)
            good = full >= max(need, 1)
            if good.any():
                ids, scores = np.concatenate([ids, self.ids[found[good]]]), np.concatenate([scores, full[good]])
                if len(ids) > k:
                    best = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    need = max(need, int(scores.min()))
        return ids, scores, need


def _search(forward: DataFrame, queries: list, weights: np.ndarray, docs: int, total: int, k: int, need: dict) -> DataFrame:
    """item, doc_id and score of the best k of each task's documents for each item, if at least as good as `need` says."""
    width = len(weights)
    size = max(64, min(8192, CELLS // max(width, 1)))
    forward = forward.repartition(max(1, min(TASKS, -(-docs // size))))
    with_: list = [[] for _ in range(width)]
    for _, terms in queries:
        for t in terms.tolist():
            with_[t].append(terms)
    with_ = [np.unique(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in with_]
    sent = forward.sparkSession.sparkContext.broadcast((queries, weights, need, with_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, need, with_ = sent.value
        state = {q: (np.zeros(0, np.int64), np.zeros(0, np.int64), need.get(q, 0)) for q, _ in queries}

        def take(parts: list) -> None:
            ids, n, length, term, count = (np.concatenate(x) for x in zip(*parts, strict=True))
            row = np.repeat(np.arange(len(ids)), length)
            matrix = np.zeros((len(ids), width), np.float32)  # impacts are below 10^6, so exact
            matrix[row, term] = impact(count, n[row], docs, total)
            shard = Shard(ids, matrix, with_)
            for q, terms in queries:
                ids_, scores, low = state[q]
                state[q] = shard.search(terms, weights[terms], k, low, ids_, scores)

        parts, held = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                own = batch.slice(a, min(size, batch.num_rows - a))
                terms, counts = own.column(2), own.column(3)
                parts.append((own.column(0).fill_null(np.iinfo(np.int64).max).to_numpy(), own.column(1).to_numpy(), terms.value_lengths().to_numpy(), terms.flatten().to_numpy(), counts.flatten().to_numpy()))
                held += own.num_rows
                if held >= size:
                    take(parts)
                    parts, held = [], 0
        if parts:
            take(parts)
        rows = [(np.full(len(ids), q), ids, scores) for q, (ids, scores, low) in state.items()]
        if rows:
            item, ids, scores = (np.concatenate(x) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(ids, pa.int64(), mask=ids == np.iinfo(np.int64).max), pa.array(scores)], ["item", "doc_id", "score"])

    return forward.mapInArrow(lean(run), "item int, doc_id long, score long")


def _blocks(terms: DataFrame, limit: int = TERMS) -> list[tuple[int, int]]:
    """Ranges of item places that have about `limit` terms together, a term counted for each item that has it."""
    out, first, held = [], None, 0
    for r in terms.groupBy("place").agg(F.count("*").alias("n")).orderBy("place").toLocalIterator():
        if first is not None and held + r["n"] > limit:
            out.append((first, last))
            first, held = None, 0
        first = r["place"] if first is None else first
        last, held = r["place"], held + r["n"]
    return [*out, (first, last)] if first is not None else out


def search(docs: DataFrame, items: DataFrame, k: int = 50, terms: int = TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the k best rows of docs(doc_id, text) for each of items(item_id, text).

    Terms are runs of letters, digits and whatever is not ASCII, A-Z folded, of whole texts. N counts the rows with a
    term, L their terms, df the rows that have a term; a term weighs w = floor(1000 ln((2N + 2) / (2df + 1))), and a row
    scores the sum of w * ((10^9 tf) div (1000 tf + 20 m)) over the item's terms, with m = 50 + (50 n N) div L. Only scores above 0 count; equal
    ones go by ascending doc_id, rows without doc_id last. Null and empty texts have no terms: as rows they are never found, as
    items they give nothing. Rows of items with one item_id (null too) are one item with all their terms; repeated rows of docs
    are rows of their own. Other columns are neither read nor returned.

    Items are searched in blocks of about `terms` terms, so that what is broadcast is bounded; each block reads docs once. Besides that
    a block writes its postings (no more than a few bytes each) and sends k rows of a task and item at most.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "search")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = _terms_of(items)
    # items are numbered by range partitions and the counts of these, never in one task
    numbers = asked.select("item_id").distinct().repartitionByRange("item_id").sortWithinPartitions("item_id").withColumn("part", F.spark_partition_id()).withColumn("own", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    numbers = scratch.cut(numbers)
    offsets, total = {}, 0
    for r in numbers.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        offsets[r["part"]], total = total, total + r["n"]
    if not total:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    start = F.create_map(*(F.lit(x) for pair in offsets.items() for x in pair))
    numbers = numbers.select("item_id", (start[F.col("part")] + F.col("own")).alias("place"))
    asked = scratch.cut(asked.alias("a").join(numbers.alias("b"), F.col("a.item_id").eqNullSafe(F.col("b.item_id"))).select("a.item_id", "place", "term"))
    out = None
    for low, high in _blocks(asked, terms):
        found = _searched(docs, asked.where(F.col("place").between(low, high)), k, scratch)
        out = found if out is None else out.unionByName(found)
    return out


def _searched(docs: DataFrame, asked: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    rows = asked.toArrow()  # bounded: a block of items
    words = sorted(set(rows.column("term").to_pylist()))
    number = {w: i for i, w in enumerate(words)}
    names, queries = {}, {}
    for item, place, term in zip(*(rows.column(c).to_pylist() for c in ("item_id", "place", "term")), strict=True):
        names[place] = item
        queries.setdefault(place, []).append(number[term])
    queries = [(p, np.array(sorted(queries[p]))) for p in sorted(queries)]
    forward = scratch.cut(_forward(docs, words))
    stats = forward.agg(F.count("*").alias("docs"), F.sum("n").alias("total")).first()
    n, total = int(stats["docs"]), int(stats["total"] or 0)
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not n:
        return empty
    df = np.zeros(len(words), np.int64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(df), np.int64)
        for batch in batches:
            sums += np.bincount(batch.column(0).flatten().to_numpy(), minlength=len(sums))
        own = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(sums[own])], ["term", "df"])

    got = forward.select("terms").mapInArrow(counted, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df[got.column("term").to_numpy()] = got.column("df").to_numpy()
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.float64)
    if max((float(weights[t].sum()) for _, t in queries), default=0) * 10**6 >= 1 << 53:
        raise ValueError("an item has more than half a million terms, so that doubles don't hold its scores")
    # a share of the documents, the square root of k N but 4,096 at least, gives scores that the best k have at least
    share = min(1.0, max(4096.0, math.sqrt(k * n)) / n)
    seeds = forward.where((F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < max(1, int(share * (1 << 20)))))
    first = top(_search(seeds, queries, weights, n, total, k, {}), ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], k)
    need = {r["item"]: r["score"] for r in first.where(F.col("rank") == k).select("item", "score").collect()}
    best = top(_search(forward, queries, weights, n, total, k, need), ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], k)
    items = spark.createDataFrame(list(names.items()), "item int, item_id long")
    return best.join(F.broadcast(items), "item").select("item_id", "rank", "doc_id", "score")
