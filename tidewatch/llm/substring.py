"""Removal of repeated passages by fixed-block anchors.

Every text is cut into reference blocks of about half a window, so that each window holds a whole block of its own
text (one or, where the width is even, sometimes two). The blocks are indexed and probed with every rolling block-wide window of all texts; a block that
nothing else meets rules out the windows around it. The hits that are left are extended: every window around a hit
block is looked up among the windows around all other hit blocks, and runs of windows that occur again are the
maximal exact repeats, which are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import PASS_BYTES, Scratch, lean, part_of, passes, rolling, shuffle_parts, slices_of, text_bytes, texts_of, tune, word_hashes

#: Windows that a task gathers before it sends them on.
GATHERED = 2_000_000
#: Bytes of input for each partition of fingerprints.
PART_BYTES = 16 << 20


def _pack(keys: np.ndarray) -> bytes:
    """Sorted numbers as 32-bit steps; as they are where a step is too wide."""
    steps = np.diff(keys, prepend=np.uint64(0))
    steps[:1] = 0
    if len(keys) and int(steps.max()) < 1 << 32:
        return b"s" + keys[:1].tobytes() + steps[1:].astype(np.uint32).tobytes()
    return b"w" + keys.tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    if blob[:1] == b"w":
        return np.frombuffer(blob, np.uint64, offset=1)
    steps = np.concatenate([np.frombuffer(blob, np.uint64, 1, 1), np.frombuffer(blob, np.uint32, offset=9).astype(np.uint64)])
    return np.cumsum(steps, dtype=np.uint64)


def _block_marks(raw: np.ndarray, at: np.ndarray, block: int):
    """46-bit fingerprints of all rolling windows of `block` words of each text, whether each is a reference block,
    and the text and position of each."""
    _, _, of, (h,) = word_hashes(raw, at)
    prints = rolling(h, block) >> np.uint64(18)
    rows = np.repeat(np.arange(len(of) - 1), np.diff(of))[: len(prints)]
    where = np.arange(len(prints)) - of[rows]
    whole = np.arange(len(prints)) + block <= of[rows + 1]
    return prints[whole], (where[whole] % block) == 0, rows[whole], where[whole]


def _probes(docs: DataFrame, block: int, parts: int) -> DataFrame:
    """Packed fingerprints of all rolling windows, each once for a task's gathering; of each number's two lowest bits
    one says that it is a reference block somewhere there, the other that it occurs more than once there."""

    def sent(gathered: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        v = np.sort(np.concatenate(gathered))
        last = np.flatnonzero(np.concatenate([(v[1:] >> np.uint64(2)) != (v[:-1] >> np.uint64(2)), [True]]))
        many = np.diff(last, prepend=-1) > 1
        v = v[last] | (many.astype(np.uint64) << np.uint64(1))
        own, cuts = slices_of(part_of(v, parts, 48))
        for k in range(0, len(own), 64):
            some = own[k : k + 64]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([_pack(v[cuts[i] : cuts[i + 1]]) for i in range(k, k + len(some))], pa.binary())], ["part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, n = [], 0
        for batch in batches:
            raw, at = texts_of(batch.column(0))
            for a, b in passes(at):
                prints, first, _, _ = _block_marks(raw[at[a] : at[b]], at[a : b + 1] - at[a], block)
                gathered.append((prints << np.uint64(2)) | first)
                n += len(prints)
                if n >= GATHERED:
                    yield from sent(gathered)
                    gathered, n = [], 0
        if n:
            yield from sent(gathered)

    return docs.select("text").mapInArrow(lean(run), "part int, blob binary")


def _met(probes: DataFrame, parts: int) -> DataFrame:
    """Fingerprints of reference blocks whose words occur at two places or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [_unpack(x) for batch in batches for x in batch.column(1).to_pylist()]
        if not got:
            return
        v = np.sort(np.concatenate(got))
        del got
        key = v >> np.uint64(2)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        flags = np.bitwise_or.reduceat((v & np.uint64(3)).astype(np.uint8), first)
        count = np.diff(first, append=len(v))
        out = key[first[(flags & 1 > 0) & ((flags & 2 > 0) | (count > 1))]].view(np.int64)
        for k in range(0, len(out), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(out[k : k + 200_000])], ["print"])

    return probes.repartitionById(parts, "part").mapInArrow(lean(run), "print long")


def _index(docs: DataFrame, block: int) -> DataFrame:
    """The reference blocks: print, and the row and number of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = texts_of(batch.column(2))
            ids, hashes = batch.column(0), batch.column(1)
            for a, b in passes(at):
                prints, first, rows, where = _block_marks(raw[at[a] : at[b]], at[a : b + 1] - at[a], block)
                rows = pa.array(rows[first] + a)
                yield pa.RecordBatch.from_arrays([pa.array(prints[first].view(np.int64)), ids.take(rows), hashes.take(rows), pa.array((where[first] // block).astype(np.int32))], ["print", "id", "th", "block"])

    return docs.select("id", "th", "text").mapInArrow(lean(run), "print long, id long, th long, block int")


_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
_PACKS = f"{_OUT}, pack long, ids array<long>, texts array<binary>, hits array<binary>"


def _packs(marked: DataFrame, keep_text: bool) -> DataFrame:
    """Finished rows of texts without a hit block; the others in packs of about PASS_BYTES, each in one row."""
    names = [x.split(" ")[0] for x in _PACKS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary())]

    def rows(columns: dict) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns.get(name, [None] * n), kind) for name, kind in zip(names, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, ids, texts, hits, size = TaskContext.get().partitionId() << 32, [], [], [], 0
        for batch in batches:
            out = {name: [] for name in names[:5]}
            for doc, text, blocks in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if blocks is None:
                    words = (text or b"").split()
                    kept = b" ".join(words)
                    for name, x in zip(names[:5], (doc, len(words), 0, hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None), strict=True):
                        out[name].append(x)
                else:
                    ids.append(doc)
                    texts.append(text)
                    hits.append(np.sort(np.array(blocks, np.int32)).tobytes())
                    size += len(text)
                    if size >= PASS_BYTES:
                        yield rows({"pack": [seq], "ids": [ids], "texts": [texts], "hits": [hits]})
                        seq, ids, texts, hits, size = seq + 1, [], [], [], 0
            if out["doc_id"]:
                yield rows(out)
        if ids:
            yield rows({"pack": [seq], "ids": [ids], "texts": [texts], "hits": [hits]})

    return marked.mapInArrow(lean(run), _PACKS)


def _around(texts: list[bytes], hits: list[bytes], width: int, block: int):
    """Windows whose first whole block is a hit block of a pack: two hashes, text and position of each, and the order in which they
    sort; first marks the first of equal ones in that order."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    _, _, of, (h0, h1) = word_hashes(raw, at, lanes=2)
    hi, lo = rolling(h0, width), (rolling(h1, width) >> np.uint64(32)).astype(np.uint32)
    starts, rows = [], []
    for r, packed in enumerate(hits):
        places = (np.frombuffer(packed, np.int32).astype(np.int64) * block)[:, None] - np.arange(min(block, width - block + 1))[None, :]
        places = places[(places >= 0) & (places + width <= of[r + 1] - of[r])]
        starts.append(places)
        rows.append(np.full(len(places), r))
    where, row = np.concatenate(starts), np.concatenate(rows)
    flat = where + of[row]
    hi, lo = hi[flat], lo[flat]
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    first = np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]) if len(hi) else np.zeros(0, bool)
    return hi, lo, first, row[order], where[order], np.diff(of)


def _asked(packs: DataFrame, width: int, block: int, parts: int) -> DataFrame:
    """What each pack asks of each part: its distinct windows, and which of them it holds twice itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, texts, hits in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                hi, lo, first, *_ = _around(texts, hits, width, block)
                if not len(hi):
                    continue
                own = np.flatnonzero(first)
                many = np.diff(own, append=len(hi)) > 1
                hi, lo = hi[own], lo[own]
                full, cuts = slices_of(part_of(hi, parts))
                blobs = [hi[a:b].tobytes() + lo[a:b].tobytes() + many[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(full), pa.array([pack] * len(full), pa.int64()), pa.array(blobs, pa.binary())], ["part", "pack", "blob"])

    return packs.mapInArrow(lean(run), "part int, pack long, blob binary")


def _answered(asked: DataFrame, parts: int) -> DataFrame:
    """For each pack and part a bit for every window that was asked: whether it occurs at two places or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, packs, his, los, manys = None, [], [], [], []
        for batch in batches:
            for p, pack, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                part, n = p, len(blob) // 13
                packs.append(pack)
                his.append(np.frombuffer(blob, np.uint64, n))
                los.append(np.frombuffer(blob, np.uint32, n, 8 * n))
                manys.append(np.frombuffer(blob, bool, n, 12 * n))
        if not packs:
            return
        hi, lo, many = np.concatenate(his), np.concatenate(los), np.concatenate(manys)
        order = np.lexsort((lo, hi))
        h, s = hi[order], lo[order]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (s[1:] != s[:-1])]))
        count = np.diff(first, append=len(h))
        again = np.logical_or.reduceat(many[order], first) | (count > 1)
        found = np.empty(len(h), bool)
        found[order] = np.repeat(again, count)
        ends = np.cumsum([len(x) for x in his])
        bits = [np.packbits(x).tobytes() for x in np.split(found, ends[:-1])]
        yield pa.RecordBatch.from_arrays([pa.array(packs, pa.int64()), pa.array([part] * len(packs), pa.int32()), pa.array(bits, pa.binary())], ["pack", "part", "bits"])

    return asked.repartitionById(parts, "part").mapInArrow(lean(run), "pack long, part int, bits binary")


def _removed(packs: DataFrame, width: int, block: int, parts: int, keep_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts, hits, answers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                hi, _, first, row, where, n_words = _around(texts, hits, width, block)
                own = np.flatnonzero(first)
                full, cuts = slices_of(part_of(hi[own], parts))
                place = {p: i for i, p in enumerate(full.tolist())}
                again = np.zeros(len(own), bool)
                for x in answers or []:
                    a, b = cuts[place[x["part"]]], cuts[place[x["part"]] + 1]
                    again[a:b] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=int(b - a)).astype(bool)
                repeated = again[np.cumsum(first) - 1]
                row, where = row[repeated], where[repeated]
                out: list[list] = [[], [], [], [], []]
                for r, (doc, text) in enumerate(zip(ids, texts, strict=True)):
                    cover = np.zeros(n_words[r] + 1, np.int64)
                    starts = where[row == r]
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, starts + width, -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    kept = b" ".join([w for w, g in zip(text.split(), gone.tolist(), strict=True) if not g])
                    for column, x in zip(out, (doc, int(n_words[r]), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], [x.split(" ")[0] for x in _OUT.split(", ")])

    return packs.mapInArrow(lean(run), _OUT)


def remove_repeats(docs: DataFrame, width: int = 35, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept of every row of docs(doc_id, text, ...).

    Words are runs of bytes other than 0x20 and 0x09-0x0D, unchanged. A word goes if it lies in a window of `width`
    (at least 2) consecutive words of its text that also starts at another place, in the same text or another;
    windows are judged on the input. kept is what stays, joined by single spaces, and kept_sha256 its digest; without
    keep_text kept is null and only digests move. Null and empty texts have no words. Repeated rows, even with equal
    or null doc_ids, are places of their own. Other columns of docs are neither read nor returned.

    Work: all texts are read three times, and once to count their bytes, by which parts are sized; each rolling window crosses the network once as four bytes, the texts
    once, what hits are left of them twice. Every fingerprint reaches a part once from a gathering, so a passage in
    every text weighs no more there than a rare one, and hit blocks go back to their rows through a join that Spark
    can split. Parts grow in number with the input.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "substring")
    block = (width + 1) // 2
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = docs.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.xxhash64("text").alias("th"), "doc_id", "text")
    parts = max(shuffle_parts(spark), text_bytes(docs) // PART_BYTES + 1)
    met = scratch.cut(_met(_probes(docs, block, parts), parts))
    hits = _index(keyed, block).join(met, "print").groupBy("id", "th").agg(F.collect_set("block").alias("blocks"))
    marked = keyed.join(hits, ["id", "th"], "left").select("doc_id", "text", "blocks")
    packs = scratch.cut(_packs(marked, keep_text))
    left = packs.where("pack is not null")
    answers = _answered(_asked(left.select("pack", "texts", "hits"), width, block, parts), parts).groupBy("pack").agg(F.collect_list(F.struct("part", "bits")).alias("answers"))
    scratch.drop(met)
    done = _removed(left.select("pack", "ids", "texts", "hits").join(answers, "pack", "left").select("ids", "texts", "hits", "answers"), width, block, parts, keep_text)
    return packs.where("pack is null").select(done.columns).unionByName(done)
