"""Phrase collocations from depth-truncated suffix trees, built group by group after a vertical partitioning of words.

Every place of a text is the beginning of a suffix, cut off after three words or at the end of its piece. First words
are counted; by these counts prefixes are packed into groups that fit a memory budget, and a word too frequent for any
group is extended to the full depth, so that its suffixes spread over all groups. Suffixes whose first two words can't
be frequent are left out, those whose last two can't be end after two words; a filter of fixed size says so and never
leaves out a frequent pair. Each group then builds its subtrees from what reaches it, apart from all others: a leaf
is a suffix with its total, a node the sum of the leaves below it. Phrases are the nodes of two and three words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Scratch, gaps, lean, mix, part_of, passes, shuffle_parts, slices_of, text_bytes, texts_of, top, tune, word_hashes

#: What ends a piece, and what stands between words.
ENDS = gaps(b".,;:!?\n\v\f\r")
BETWEEN = ENDS | gaps(b" \t")
#: Places that a task gathers before it sends them on, suffixes that a group may hold, bytes of input for each part of the filter.
GATHERED, GROUP, PART_BYTES = 1_000_000, 2_000_000, 16 << 20
#: Ranges of hashes that words are packed into groups by; a word with more than a share of 1 / HOT of all words is extended.
SLOTS, HOT = 1 << 16, 4096
#: Bits of the filter, at most.
MOST_BITS = 29
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def _keys(raw: np.ndarray, at: np.ndarray, langs: np.ndarray, seed: int):
    """Words of texts laid end to end: start and end bytes, offsets, a key of each word and its text's language, and
    whether the next word follows in the same piece."""
    starts, ends, of, (h,) = word_hashes(raw, at, fold=True, gap=BETWEEN)
    row = np.repeat(np.arange(len(at) - 1), np.diff(of))
    key = mix(h ^ mix(langs[row] + np.uint64(seed)))
    key[key == 0] = 1
    piece = np.cumsum(ENDS[raw], dtype=np.int64)[starts] if len(starts) else starts
    return starts, ends, row, key, (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """The texts of a batch (lang_hash, text, ...) in passes: bytes, offsets, hashes of languages, and the first row."""
    raw, at = texts_of(batch.column(1))
    langs = batch.column(0).to_numpy().view(np.uint64)
    for a, b in passes(at):
        yield raw[at[a] : at[b]], at[a : b + 1] - at[a], langs[a:b], a


def _summed(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct tuples of keys in order, with their counts added."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    if not len(order):
        return keys, counts
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return [k[first] for k in keys], np.add.reduceat(counts[order], first)


def _words(docs: DataFrame, seed: int) -> DataFrame:
    """key, lang, word and n of a task's gathering: each distinct word once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, names, texts = [], [], [], []
        seen, held = np.zeros(0, np.uint64), 0

        def sent() -> pa.RecordBatch:
            (k,), n = _summed([np.concatenate(keys)], np.concatenate(counts))
            place = np.argsort(np.concatenate([x for x, _, _ in texts]))
            lang, word = (pa.concat_arrays([t[i] for t in texts]).take(pa.array(place)) for i in (1, 2))
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), lang, word.cast(pa.string()), pa.array(n)], ["key", "lang", "word", "n"])

        for batch in batches:
            for raw, at, langs, a in _rows(batch):
                starts, ends, row, key, _ = _keys(raw, at, langs, seed)
                own, first, n = np.unique(key, return_index=True, return_counts=True)
                keys.append(own)
                counts.append(n)
                fresh = seen[np.minimum(np.searchsorted(seen, own), len(seen) - 1)] != own if len(seen) else np.ones(len(own), bool)
                own, first = own[fresh], first[fresh]
                size = (ends - starts)[first]
                end = np.cumsum(size)
                text = _LOW[raw[np.repeat(starts[first] - (end - size), size) + np.arange(end[-1] if len(end) else 0)]]
                words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(np.concatenate([[0], end]).astype(np.int64)), pa.py_buffer(text)])
                texts.append((own, batch.column(2).take(pa.array(row[first] + a)), words.cast(pa.binary())))
                seen = np.sort(np.concatenate([seen, own]))
                held += len(keys[-1])
                if held >= 2 * GATHERED:
                    if len(seen) >= GATHERED:
                        yield sent()
                        keys, counts, texts, seen, held = [], [], [], np.zeros(0, np.uint64), 0
                    else:
                        (k,), n = _summed([np.concatenate(keys)], np.concatenate(counts))
                        keys, counts, held = [k], [n], len(k)
        if keys:
            yield sent()

    return docs.mapInArrow(lean(run), "key long, lang string, word string, n long")


def _pair(key: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """46-bit fingerprints of neighbouring words, where the second follows the first."""
    return mix(key[:-1] * np.uint64(0x9E3779B97F4A7C15) + key[1:])[follows] >> np.uint64(18)


def _filter(docs: DataFrame, seed: int, least: int, parts: int, bits: int) -> np.ndarray:
    """A table of 2**bits bits; that of a pair is set if pairs of its fingerprint occur `least` times together."""
    most = np.uint64(15)

    def out(gathered: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        prints, n = np.unique(np.concatenate(gathered), return_counts=True)
        v = prints << np.uint64(4) | np.minimum(n.astype(np.uint64), most)
        own, cuts = slices_of(part_of(v, parts, 50))
        for k in range(0, len(own), 64):
            some = own[k : k + 64]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([_pack(v[cuts[i] : cuts[i + 1]]) for i in range(k, k + len(some))], pa.binary())], ["part", "blob"])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, held = [], 0
        for batch in batches:
            for raw, at, langs, _ in _rows(batch):
                *_, key, follows = _keys(raw, at, langs, seed)
                gathered.append(_pair(key, follows))
                held += len(gathered[-1])
                if held >= 2 * GATHERED:
                    yield from out(gathered)
                    gathered, held = [], 0
        if held:
            yield from out(gathered)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [_unpack(x) for batch in batches for x in batch.column(1).to_pylist()]
        if not got:
            return
        v = np.sort(np.concatenate(got))
        del got
        prints = v >> np.uint64(4)
        first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
        frequent = prints[first[np.add.reduceat(v & np.uint64(15), first) >= least]]
        slots = np.unique(frequent >> np.uint64(46 - bits)).astype(np.int64)
        if len(slots):
            low = slots[0] >> 3
            table = np.zeros(((slots[-1] >> 3) - low + 1) << 3, np.uint8)
            table[slots - (low << 3)] = 1
            yield pa.RecordBatch.from_arrays([pa.array([low], pa.int64()), pa.array([np.packbits(table).tobytes()], pa.binary())], ["at", "bits"])

    table = np.zeros((1 << bits) >> 3, np.uint8)
    pieces = docs.mapInArrow(lean(sent), "part int, blob binary").repartitionById(parts, "part").mapInArrow(lean(met), "at long, bits binary").toArrow()
    for at, some in zip(pieces.column(0).to_pylist(), pieces.column(1).to_pylist(), strict=True):
        table[at : at + len(some)] |= np.frombuffer(some, np.uint8)
    return table


def _pack(v: np.ndarray) -> bytes:
    """Sorted numbers as 32-bit steps; as they are where a step is too wide."""
    steps = np.diff(v)
    if len(steps) and int(steps.max()) < 1 << 32:
        return b"s" + v[:1].tobytes() + steps.astype(np.uint32).tobytes()
    return b"w" + v.tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    if blob[:1] == b"w":
        return np.frombuffer(blob, np.uint64, offset=1)
    return np.cumsum(np.concatenate([np.frombuffer(blob, np.uint64, 1, 1), np.frombuffer(blob, np.uint32, offset=9).astype(np.uint64)]), dtype=np.uint64)


def _leaves(docs: DataFrame, seed: int, table: np.ndarray, bits: int, groups: np.ndarray, hot: np.ndarray) -> DataFrame:
    """part and blob: the suffixes of a task's gathering with their counts, by group. groups: the group of each slot of
    words; hot: sorted keys of the words that are extended to the full depth."""
    shared = docs.sparkSession.sparkContext.broadcast((table, groups, hot))
    parts = int(groups.max()) + 1

    def out(gathered: list) -> Iterator[pa.RecordBatch]:
        (a, b, c), n = _summed([np.concatenate(x) for x in zip(*gathered, strict=True)], np.ones(sum(len(x[0]) for x in gathered), np.int64))
        _, groups, hot = shared.value
        part = groups[a >> np.uint64(48)].astype(np.int64)
        if len(hot):
            wide = hot[np.minimum(np.searchsorted(hot, a), len(hot) - 1)] == a
            part[wide] = ((mix(mix(a[wide] ^ mix(b[wide])) ^ c[wide]) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        a, b, c, n, part = a[order], b[order], c[order], n[order], part[order]
        own, cuts = slices_of(part)
        for k in range(0, len(own), 64):
            some = own[k : k + 64]
            blobs = [b"".join(x[cuts[i] : cuts[i + 1]].tobytes() for x in (a, b, c, n)) for i in range(k, k + len(some))]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(blobs, pa.binary())], ["part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value[0]
        gathered, held = [], 0
        for batch in batches:
            for raw, at, langs, _ in _rows(batch):
                *_, key, follows = _keys(raw, at, langs, seed)
                slot = (_pair(key, follows) >> np.uint64(46 - bits)).astype(np.int64)
                frequent = np.zeros(len(key) + 1, bool)  # whether this word and the next may be a frequent pair
                frequent[:-2][follows] = (table[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1
                place = np.flatnonzero(frequent[:-2])
                third = np.where(frequent[place + 1], key[np.minimum(place + 2, len(key) - 1)], np.uint64(0))
                gathered.append((key[place], key[place + 1], third))
                held += len(place)
                if held >= GATHERED:
                    yield from out(gathered)
                    gathered, held = [], 0
        if held:
            yield from out(gathered)

    return docs.mapInArrow(lean(run), "part int, blob binary")


def _nodes(leaves: DataFrame, least: int, hot: np.ndarray, parts: int) -> DataFrame:
    """Nodes of the subtrees: two words (c null) or three, and n; nodes with fewer than `least` only where a group may hold
    a part of them, the pairs of extended words."""
    shared = leaves.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, held = [], 0
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                m = len(blob) // 32
                gathered.append([np.frombuffer(blob, kind, m, 8 * m * i) for i, kind in enumerate((np.uint64, np.uint64, np.uint64, np.int64))])
                held += m
                if held >= 2 * GROUP:
                    keys, n = _summed([np.concatenate(x) for x in zip(*(g[:3] for g in gathered), strict=True)], np.concatenate([g[3] for g in gathered]))
                    gathered, held = [[*keys, n]], 0
        if not gathered:
            return
        (a, b, c), n = _summed([np.concatenate(x) for x in zip(*(g[:3] for g in gathered), strict=True)], np.concatenate([g[3] for g in gathered]))
        del gathered
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        total = np.add.reduceat(n, first)
        hot = shared.value
        wide = hot[np.minimum(np.searchsorted(hot, a[first]), len(hot) - 1)] == a[first] if len(hot) else np.zeros(len(first), bool)
        keep = first[(total >= least) | wide]
        leaf = np.flatnonzero((c != 0) & (n >= least))
        total = total[(total >= least) | wide]
        for at, count, third in ((keep, total, False), (leaf, n[leaf], True)):
            for k in range(0, len(at), 200_000):
                some = at[k : k + 200_000]
                last = pa.array(c[some].view(np.int64)) if third else pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(a[some].view(np.int64)), pa.array(b[some].view(np.int64)), last, pa.array(count[k : k + 200_000])], ["a", "b", "c", "n"])

    return leaves.repartitionById(parts, "part").mapInArrow(lean(run), "a long, b long, c long, n long")


def _grouped(words: DataFrame, total: int, least: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The vertical partition: the group of each slot of words, and the words that no group may hold whole."""
    share = max(1, total // HOT)
    hot = np.sort(words.where(F.col("f") > share).select("key").toArrow().column(0).to_numpy().view(np.uint64))  # HOT at most
    slots = words.where(f"f >= {least} and f <= {share}").groupBy(F.shiftrightunsigned("key", 48).cast("int").alias("slot")).agg(F.sum("f").alias("f")).toArrow()
    weight = np.zeros(SLOTS, np.int64)
    weight[slots.column(0).to_numpy()] = slots.column(1).to_numpy()
    budget = max(1, min(GROUP, int(weight.sum()) // parts))
    return ((np.cumsum(weight) - weight) // budget).astype(np.int32), hot


def collocations(docs: DataFrame, least: int = 10, within: int = 50, k: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first k phrases of docs(text, lang).

    Texts fold A-Z, split at `.,;:!?` and line ends into pieces and these at spaces and tabs into words. n counts all words of a
    language (null: `und`), f(phrase) its occurrences within pieces. Candidates are phrases of 2 or 3 words with
    a = f >= least. The cut after 1 or 2 words with the lowest floor(10^6 a^2 / (l r)) counts (l, r: f of the two parts), the first of equal ones.
    Candidates go whose words lie in a candidate of three with 100 f >= within * a. Order: score and a descending, phrase ascending by bytes.

    Null and empty texts and empty tables give nothing, repeated rows count again, other columns aren't read. Words are told
    apart by 64-bit keys that are checked to be one for each word of the input, and dealt again if they aren't. Texts
    are read three times, and once to count bytes; what crosses the network is pre-aggregated by task, a word or suffix once from each gathering.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "phrases")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    docs = docs.select(F.xxhash64(lang).alias("lang_hash"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    for seed in range(8):
        words = scratch.cut(_words(docs, seed).groupBy("key", "lang", "word").agg(F.sum("n").alias("f")))
        stats = words.agg(F.count("*").alias("rows"), F.sum("f").alias("total"), F.count(F.when(F.col("f") >= least, 1)).alias("frequent")).first()
        if words.groupBy("key").count().where("count > 1").isEmpty():
            break
        scratch.drop(words)
    else:
        raise ValueError("no seed gives every word a key of its own")
    frequent = words.where(F.col("f") >= least)
    parts = max(shuffle_parts(spark), text_bytes(docs) // PART_BYTES + 1)
    bits = min(MOST_BITS, max(20, int(stats["frequent"] * 64).bit_length()))
    table = _filter(docs, seed, least, parts, bits)
    groups, hot = _grouped(words, int(stats["total"] or 0), least, parts)
    nodes = scratch.cut(_nodes(_leaves(docs, seed, table, bits, groups, hot), least, hot, int(groups.max()) + 1))
    pairs = scratch.cut(nodes.where("c is null").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    triples = nodes.where("c is not null")
    result = _ranked(frequent, pairs, triples, within, words.groupBy("lang").agg(F.sum("f").alias("n")))
    return top(result, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], k).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _score(a: str, l: str, r: str):
    return F.expr(f"cast((cast({a} as decimal(19,0)) * cast({a} as decimal(19,0)) * 1000000bd) div (cast({l} as decimal(19,0)) * cast({r} as decimal(19,0))) as bigint)")


def _ranked(words: DataFrame, pairs: DataFrame, triples: DataFrame, within: int, totals: DataFrame) -> DataFrame:
    """Candidates that stay, with their cut and score."""
    word = {x: words.select(F.col("key").alias(x), F.col("word").alias(f"w{x}"), F.col("f").alias(f"f{x}"), *([F.col("lang")] if x == "a" else [])) for x in "abc"}
    cover = triples.select("a", "b", "n").unionByName(triples.select(F.col("b").alias("a"), F.col("c").alias("b"), "n")).groupBy("a", "b").agg(F.max("n").alias("most"))
    two = pairs.join(cover, ["a", "b"], "left").where(f"most is null or 100 * most < {within} * n")
    two = two.join(word["a"], "a").join(word["b"], "b").select("lang", F.concat_ws(" ", "wa", "wb").alias("phrase"), F.col("n").alias("a"), F.col("fa").alias("l"), F.col("fb").alias("r"), _score("n", "fa", "fb").alias("score"))
    three = triples.join(pairs.select("a", "b", F.col("n").alias("fab")), ["a", "b"]).join(pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("fbc")), ["b", "c"])
    three = three.join(word["a"], "a").join(word["b"], "b").join(word["c"], "c").withColumn("s1", _score("n", "fa", "fbc")).withColumn("s2", _score("n", "fab", "fc"))
    first = F.col("s1") <= F.col("s2")
    three = three.select("lang", F.concat_ws(" ", "wa", "wb", "wc").alias("phrase"), F.col("n").alias("a"), F.when(first, F.col("fa")).otherwise(F.col("fab")).alias("l"), F.when(first, F.col("fbc")).otherwise(F.col("fc")).alias("r"), F.least("s1", "s2").alias("score"))
    return two.unionByName(three).join(totals, "lang")
