"""Near-duplicate detection over word shingles by a signature-coordinate inverted join.

Each text's shingle set is reduced to a MinHash signature; every (coordinate, value) of it is a posting. Pairs whose
sets are alike share at least `matches` of the coordinates, so, with postings ordered from rare to frequent, they
meet in a prefix: a text with m postings that any other text shares needs only its m - matches + 1 rarest. The
lists of the prefix nominate pairs, each once however often it meets there; the longer lists are skipped, and the
collisions of a nominated pair are counted on the two signatures.
Merging skips what lies near a common text: a list's leader is compared with all of the list, and what matches it
falls into its cluster; then only pairs across clusters are counted. Links are confirmed on the full sets. Inside a
cluster, where a third of all texts may match each other and yet be no links, full sets are compared by what tells
them from the cluster's leader: texts that link share much of it, and so meet in a prefix of it, rarest first.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Scratch, lean, passes, rolling, texts_of, tune, word_hashes
from tidewatch.llm.graph import components

#: Coordinates of a signature. At 64, a pair at the threshold of 0.8 agrees in 51 on average and in fewer than 35 once in about a million times.
COORDINATES = 64


def least_matches(percent: int, coordinates: int = COORDINATES) -> int:
    """Coordinates that a pair of this similarity shares but for five standard deviations; 1 at least."""
    p = percent / 100
    return max(1, math.floor(coordinates * p - 5 * math.sqrt(coordinates * p * (1 - p))))


def shingle_sets(raw: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """Each text's set of shingles as sorted distinct 64-bit hashes: width words (A-Z as a-z), or all words of a
    text that has fewer."""
    out: list[np.ndarray] = []
    for a, b in passes(at):
        _, _, of, (h,) = word_hashes(raw[at[a] : at[b]], at[a : b + 1] - at[a], fold=True)
        windows = rolling(h, width)
        for x, y in zip(of[:-1], of[1:], strict=True):
            if y - x >= width:
                out.append(np.unique(windows[x : y - width + 1]))
            else:
                out.append(rolling(h[x:y], int(y - x)) ^ np.uint64(y - x) if y > x else np.zeros(0, np.uint64))
    return out


def sign(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Signatures of sets that aren't empty: the least of each of `coordinates` random orders, upper 32 bits."""
    odd = np.random.default_rng(20011).integers(0, 1 << 64, coordinates, np.uint64, endpoint=False) | np.uint64(1)
    flat = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    out = np.empty((len(sets), coordinates), np.uint32)
    for j, k in enumerate(odd):
        out[:, j] = np.minimum.reduceat(flat * k, first) >> np.uint64(32)
    return out.view(np.int32)


def signatures(docs: DataFrame, width: int, coordinates: int) -> DataFrame:
    """doc_id, n (size of the set), digest (of the set), sig and sketch (four bits of each coordinate, 16 in a long);
    the last three are null for empty sets."""
    schema = "doc_id long, n long, digest binary, sig array<int>, sketch array<long>"
    longs = -(-coordinates // 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = texts_of(batch.column(1))
            for a, b in passes(at):
                sets = shingle_sets(raw[at[a] : at[b]], at[a : b + 1] - at[a], width)
                n = np.array([len(s) for s in sets], np.int64)
                full = [s for s in sets if len(s)]
                sig = sign(full, coordinates) if full else np.zeros((0, coordinates), np.int32)
                four = np.zeros((len(full), longs * 16), np.uint64)
                four[:, :coordinates] = sig & 15
                sketch = np.bitwise_or.reduce(four.reshape(len(full), longs, 16) << np.arange(0, 64, 4, np.uint64), axis=2).view(np.int64)
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((n > 0) * x.shape[1])]).astype(np.int32)), pa.array(x.ravel()), mask=pa.array(n == 0)) for x in (sig, sketch)]
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(digests, pa.binary()), *lists], ["doc_id", "n", "digest", "sig", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), schema)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = texts_of(batch.column(1))
            for a, b in passes(at):
                sets = shingle_sets(raw[at[a] : at[b]], at[a : b + 1] - at[a], width)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(digests, pa.binary()), grams], ["id", "digest", "grams"])

    return docs.mapInArrow(lean(run), "id long, digest binary, grams array<long>")


def _could_match(a: str, b: str, longs: int, coordinates: int, matches: int) -> Column:
    """Whether sketches a and b agree in `matches` coordinates or more: signatures that do always pass."""

    def unlike(i: int) -> Column:
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    total = unlike(0)
    for i in range(1, longs):
        total = total + unlike(i)
    return total <= coordinates - matches


def _alike(a: str, b: str, percent: int):
    """Whether sets of these sizes can be as similar as asked."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _nominated(met: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, that met in a prefix list, once each."""
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _near(met: DataFrame, reps: DataFrame, matches: int) -> DataFrame:
    """Of pairs that met, those above the match threshold, by the collisions of both signatures."""
    sig = reps.select("id", "sig")
    both = _nominated(met).join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")
    count = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda same: same))
    return both.where(count >= matches).select("a", "b").distinct()


def _texts_of(pairs: DataFrame, docs: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """The sets of all texts in pairs: id, grams."""
    ids = scratch.cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    out = scratch.cut(_sets(docs.join(ids, "doc_id", "left_semi"), width).dropDuplicates(["id", "digest"]).select("id", "grams"))
    scratch.drop(ids)
    return out


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are as similar as asked."""
    both = pairs.join(sets.toDF("a", "grams_a"), "a").join(sets.toDF("b", "grams_b"), "b")
    common = F.size(F.array_intersect("grams_a", "grams_b"))
    return both.select("a", "b", common.alias("i"), (F.size("grams_a") + F.size("grams_b") - common).alias("u")).where(F.col("i") * 100 >= F.col("u") * percent).select("a", "b").distinct()


def _inside(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of one cluster but different components that can link. members(id, cluster, comp, head), where
    head is the cluster's leader.

    With d the difference of a text's set from the leader's, two texts differ by what one d has and the other hasn't;
    for a link that is at most a share (100 - percent) / (100 + percent) of both sizes. So both d's share a number of
    shingles that follows from the sizes, and of the smaller d one is among its rarest ones. Texts that link with
    the leader come as pairs with it.
    """
    heads = members.select("head").distinct().join(sets.toDF("head", "lead"), "head")
    apart = members.join(sets, "id").join(heads, "head").select("id", "cluster", "comp", "head", F.size("grams").cast("long").alias("n"), F.size("lead").cast("long").alias("nl"), F.concat(F.array_except("grams", "lead"), F.array_except("lead", "grams")).alias("d"))
    apart = scratch.cut(apart)
    direct = apart.where((F.col("id") != F.col("head")) & (F.size("d") * (100 + percent) <= (F.col("n") + F.col("nl")) * (100 - percent))).select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b"))
    flat = apart.select("id", "cluster", "comp", "n", F.size("d").cast("long").alias("d"), F.explode("d").alias("s"))
    often = scratch.cut(flat.groupBy("cluster", "s").agg(F.count("*").alias("c"), (F.min("comp") != F.max("comp")).alias("mixed")).where("c > 1"))
    entry = F.struct(F.coalesce("c", F.lit(1).cast("long")).alias("c"), "s", F.coalesce("mixed", F.lit(False)).alias("mixed"))
    ordered = flat.join(often, ["cluster", "s"], "left").groupBy("id", "cluster", "comp", "n", "d").agg(F.sort_array(F.collect_list(entry)).alias("list"))
    rows = scratch.cut(ordered.select("id", "cluster", "comp", "n", "d", F.posexplode("list").alias("i", "p")).where("p.mixed").select("id", "cluster", "comp", "n", "d", F.col("i").cast("long").alias("i"), "p.s"))
    small = rows.where(F.col("i") * 2 * percent <= F.col("n") * (100 - percent)).select("cluster", "s", *(F.col(c).alias(f"{c}_b") for c in ("id", "comp", "n", "d", "i")))
    # Twice the shingles that both d's must share, times 100 + percent
    share = (F.col("d") + F.col("d_b")) * (100 + percent) - (F.col("n") + F.col("n_b")) * (100 - percent)
    room = lambda d, i: (F.col(d) - F.col(i)) * 2 * (100 + percent) >= share
    smaller = (F.col("d_b") < F.col("d")) | ((F.col("d_b") == F.col("d")) & (F.col("id_b") < F.col("id")))
    pairs = rows.join(small, ["cluster", "s"]).where((F.col("comp") != F.col("comp_b")) & smaller & _alike("n", "n_b", percent) & (share > 0) & room("d", "i") & room("d_b", "i_b"))
    pairs = pairs.select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b"))
    out = scratch.cut(direct.unionByName(pairs).distinct())
    scratch.drop(apart, often, rows)
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, coordinates: int = COORDINATES, matches: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs(doc_id, text, ...).

    Texts link when their sets of `width`-word shingles have a Jaccard similarity of percent / 100 or more;
    component_id is the smallest doc_id that links lead to, kept marks the row that bears it. Null and empty texts
    have n_shingles 0 and link with nothing. Rows without a doc_id link with nothing, have no component_id and are
    kept. Rows with equal sets are one class and count once; repeated rows stay repeated. Rows that repeat a doc_id
    with different texts are one document, which links by each of its texts. Other columns of docs are neither read
    nor returned. `matches` is the number of coordinates that a pair must share, by default least_matches(percent).

    Work: one pass over all texts; postings are shuffled by value; texts of the pairs that are left (few) are read a
    second time. A list's rows meet its leader, then rows of other clusters, each test being one of four longs
    inside the join, so that only pairs near the threshold leave it. A list that a third of all texts share is one
    cluster, whose rows never meet each other by it; joins are Spark's, which can split it.
    Lost executors: every table that later steps read lies in the shared folder.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "minhash")
    matches = least_matches(percent, coordinates) if matches is None else matches
    longs = -(-coordinates // 16)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.cut(signatures(docs, width, coordinates))
    reps = scratch.cut(signed.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "n", "sig", "sketch")).alias("x")).select("x.*", "digest").withColumnRenamed("doc_id", "id"))

    posted = reps.select("id", F.posexplode("sig").alias("c", "v")).select("id", (F.shiftleft(F.col("c").cast("long"), 32) + F.col("v").cast("long") + (1 << 31)).alias("key"))
    shared = posted.groupBy("key").count().where("count > 1")
    lists = posted.join(shared, "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("count", "key"))).alias("list"), F.sum("count").alias("fame")).where(F.size("list") >= matches)
    prefix = lists.select("id", "fame", F.explode(F.slice("list", F.lit(1), F.size("list") - (matches - 1))).alias("p")).select("id", "fame", "p.key")
    prefix = scratch.cut(prefix.join(reps.select("id", "n", "sketch"), "id"))

    leader = F.max(F.struct("fame", (-F.col("id")).alias("other"), F.col("n").alias("nb"), F.col("sketch").alias("sketch_b"))).alias("l")
    leaders = prefix.groupBy("key").agg(leader, F.count("*").alias("c")).where("c > 1").select("key", (-F.col("l.other")).alias("b"), "l.nb", "l.sketch_b")
    could = _could_match("sketch", "sketch_b", longs, coordinates, matches) & _alike("n", "nb", percent)
    met = prefix.join(leaders, "key").where((F.col("id") != F.col("b")) & could).select(F.col("id").alias("a"), "b")
    near = scratch.cut(_near(met, reps, matches))
    sets = _texts_of(near, docs, width, scratch)
    links = scratch.cut(_confirmed(near, sets, percent))
    clusters = scratch.cut(components(near, scratch).toDF("id", "cluster"))
    scratch.drop(near)
    known = clusters.join(components(links, scratch).toDF("id", "comp"), "id", "left").select("id", "cluster", F.coalesce("comp", "id").alias("comp"))
    fame = prefix.select("id", "fame").distinct()
    known = scratch.cut(known.join(fame, "id"))
    mixed = known.groupBy("cluster").agg(F.max_by("id", F.struct("fame", "id")).alias("head"), (F.min("comp") != F.max("comp")).alias("mixed")).where("mixed").select("cluster", "head")
    inside = _inside(scratch.cut(known.join(mixed, "cluster").select("id", "cluster", "comp", "head")), sets, percent, scratch)
    links = scratch.cut(links.unionByName(_confirmed(inside, sets, percent)))
    scratch.drop(sets, inside)

    held = prefix.join(clusters, "id", "left").select("key", "id", "n", "sketch", F.coalesce("cluster", "id").alias("cluster"))
    tops = held.groupBy("key", "cluster").count().groupBy("key").agg(F.max_by("cluster", F.struct("count", "cluster")).alias("most"), F.count("*").alias("c")).where("c > 1").select("key", "most")
    left = scratch.cut(held.join(tops, "key").select("key", "id", "n", "cluster", "sketch", (F.col("cluster") == F.col("most")).alias("top")))
    one = left.where("not top").select("key", F.col("id").alias("a"), F.col("cluster").alias("ca"), "n", "sketch")
    two = left.select("key", F.col("id").alias("b"), F.col("cluster").alias("cb"), F.col("n").alias("nb"), F.col("sketch").alias("sketch_b"), "top")
    met = one.join(two, "key").where((F.col("ca") != F.col("cb")) & (F.col("top") | (F.col("a") < F.col("b"))) & could).select("a", "b")
    near = scratch.cut(_near(met, reps, matches))
    sets = _texts_of(near, docs, width, scratch)
    more = scratch.cut(_confirmed(near, sets, percent))
    scratch.drop(prefix, left, near, sets)

    # Rows of one doc_id with different sets are one document
    own = signed.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("doc_id")
    own = signed.join(own, "doc_id").join(reps.select("digest", "id"), "digest").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    known = components(links.unionByName(more).unionByName(own), scratch)

    classes = reps.select("digest", "id").join(known.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("comp", "id").alias("comp")).dropDuplicates(["digest"])
    out = signed.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(classes, "digest", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
