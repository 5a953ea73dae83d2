"""Media columns: baseline JPEG written and read in numpy.

A payload is stored as a grey picture in which each 8 x 8 block is one flat sample, so the DC-only thumbnail of the
picture is the payload. The reader is for baseline JPEG in general: it parses markers, Huffman-decodes scans (all
restart intervals of many pictures side by side, one block each a step) and keeps the luminance DC values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import lean, passes, texts_of, tune, without

#: Samples in a row; also a restart interval. Rows that one picture can hold (65,535 lines of pixels).
ROW, ROWS = 192, 8191


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    """Markers up to the scan. DC codes are 10 - c bits for category c, so that a code and its c extra bits are always
    10 bits; the only AC code, end of block, has 6: each block is two bytes, neither of them 0xFF."""
    quant = _segment(0xDB, b"\0" + bytes([8] * 64))
    frame = _segment(0xC0, struct.pack(">BHHB", 8, 8 * rows, 8 * ROW, 1) + b"\x01\x11\x00")
    dc = _segment(0xC4, b"\x00" + bytes([0] + [1] * 9 + [0] * 6) + bytes(range(8, -1, -1)))
    ac = _segment(0xC4, b"\x10" + bytes([0] * 5 + [1] + [0] * 10) + b"\0")
    return b"\xff\xd8" + quant + frame + dc + ac + _segment(0xDD, struct.pack(">H", ROW)) + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")


def _block_codes() -> np.ndarray:
    """The two bytes of a block by its DC difference plus 255."""
    out = []
    for diff in range(-255, 256):
        c = abs(diff).bit_length()
        code = (1 << (9 - c)) - 2
        out.append(((code << c) | (diff if diff > 0 else diff + (1 << c) - 1)) << 6)
    return np.array(out, ">u2")


_CODES = _block_codes()


def write(samples: np.ndarray) -> bytes:
    """Baseline JPEG of a positive multiple of 192 samples; very many are several pictures, one after the other."""
    rows = samples.reshape(-1, ROW)
    diff = np.empty(rows.shape, np.int16)
    diff[:, 0] = rows[:, 0].astype(np.int16) - 128
    diff[:, 1:] = rows[:, 1:].astype(np.int16) - rows[:, :-1]
    body = np.empty((len(rows), 2 * ROW + 2), np.uint8)
    body[:, : 2 * ROW] = _CODES[diff + 255].view(np.uint8)
    body[:, 2 * ROW] = 0xFF
    out = []
    for a in range(0, len(rows), ROWS):
        part = body[a : a + ROWS]
        part[:, 2 * ROW + 1] = 0xD0 + np.arange(len(part)) % 8
        out += [_header(len(part)), part.tobytes()[:-2], b"\xff\xd9"]
    return b"".join(out)


@dataclass
class _Picture:
    width: int
    height: int
    layout: tuple
    tables: tuple
    quant: int
    grid: tuple
    data: bytes
    lanes: list
    blocks: list


def _parse(raw: bytes) -> Iterator[_Picture]:
    """The pictures in a stream, scans freed of stuffed bytes, with the first byte and the units of each interval."""
    at, tables, quants, interval, frame = 0, {}, {}, 0, None
    while at < len(raw):
        if raw[at] != 0xFF:
            raise ValueError("not a JPEG marker")
        marker = raw[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in (0xD8, 0xD9):
            if marker == 0xD8:
                tables, quants, interval, frame = {}, {}, 0, None
            at += 2
            continue
        size = struct.unpack_from(">H", raw, at + 2)[0]
        body = raw[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quants[body[0] & 15] = struct.unpack_from(">H" if wide else ">B", body, 1)[0]
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = bytes(body[1 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC0:
            precision, height, width, n = struct.unpack_from(">BHHB", body)
            if precision != 8:
                raise ValueError("only 8-bit baseline JPEG")
            frame = (width, height, {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i], i) for i in range(n)})
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("only baseline JPEG")
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            width, height, parts = frame
            scan = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            h_max, v_max = max(p[0] for p in parts.values()), max(p[1] for p in parts.values())
            if len(scan) == 1:
                h, v, q, i = parts[scan[0][0]]
                across = -(-(-(-width * h // h_max)) // 8)
                down = -(-(-(-height * v // v_max)) // 8)
                units = [(i == 0, scan[0][1], 0, 0, 1, 1)]
            else:
                across, down = -(-width // (8 * h_max)), -(-height // (8 * v_max))
                units = [(parts[c][3] == 0, t, y, x, parts[c][1], parts[c][0]) for c, t in scan for y in range(parts[c][1]) for x in range(parts[c][0])]
            ends = np.frombuffer(raw, np.uint8, offset=at)
            marks = np.flatnonzero(ends[:-1] == 0xFF)
            kinds = ends[marks + 1]
            stop = marks[(kinds != 0) & ((kinds < 0xD0) | (kinds > 0xD7)) & (kinds != 0xFF)]
            stop = int(stop[0]) if len(stop) else len(ends)
            marks, kinds = marks[marks < stop], kinds[marks < stop]
            again = marks[(kinds >= 0xD0) & (kinds <= 0xD7)]
            keep = np.ones(stop, bool)
            keep[marks[kinds == 0] + 1] = False
            keep[again] = keep[again + 1] = False
            keep[marks[kinds == 0xFF]] = False
            starts = np.concatenate([[0], again + 2])
            lanes = (starts - np.searchsorted(np.flatnonzero(~keep), starts)).tolist() if len(marks) else [0]
            total = across * down
            blocks = [min(interval, total - interval * k) for k in range(len(lanes))] if interval else [total]
            if any(u[0] for u in units):
                luma = next(p for p in parts.values() if p[3] == 0)
                yield _Picture(width, height, tuple(units), tuple(tables.get(k, b"") for k in (0, 1, 2, 3, 16, 17, 18, 19)), quants[luma[2]], (down, across), ends[:stop][keep].tobytes(), lanes, blocks)
            at += stop


def _symbols(table: bytes) -> np.ndarray:
    """For each 16 bits to come: symbol << 8 | bits of its code, -1 where no code fits."""
    out = np.full(1 << 16, -1, np.int32)
    code, values = 0, iter(table[16:])
    for length in range(1, 17):
        for _ in range(table[length - 1] if table else 0):
            out[code << (16 - length) : (code + 1) << (16 - length)] = next(values) << 8 | length
            code += 1
        code <<= 1
    return out


_LOOK: dict = {}


def _looks(dc: bytes, ac: bytes):
    """Symbol tables of a pair, and a third one for whole blocks that are a DC difference and an end of block within
    16 bits: (difference + 4096) << 8 | all bits, 0 for other blocks."""
    if (dc, ac) not in _LOOK:
        if len(_LOOK) > 16:
            _LOOK.clear()
        d, a = _symbols(dc), _symbols(ac)
        ahead = np.arange(1 << 16)
        length, c = d & 255, d >> 8
        extra = (ahead >> np.clip(16 - length - c, 0, 16)) & ((1 << np.clip(c, 0, 16)) - 1)
        diff = np.where((c > 0) & (extra < (1 << np.clip(c - 1, 0, 16))), extra - (1 << np.clip(c, 0, 16)) + 1, extra)
        rest = (ahead << np.clip(length + c, 0, 16)) & 0xFFFF
        end = a[rest]
        fits = (d >= 0) & (end >> 8 == 0) & (end >= 0) & (length + c + (end & 255) <= 16)
        _LOOK[dc, ac] = d, a, np.where(fits, (diff + 4096) << 8 | (length + c + (end & 255)), 0).astype(np.int32)
    return _LOOK[dc, ac]


def _slow(words: np.ndarray, pos: np.ndarray, dc: np.ndarray, ac: np.ndarray):
    """Difference and bits of blocks that need more than the whole-block table."""
    peek = lambda p: (words[p >> 3] >> (16 - (p & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
    start, got = pos, dc[peek(pos)]
    if (got < 0).any():
        raise ValueError("no such DC code")
    pos, c = pos + (got & 255), got >> 8
    extra = peek(pos).astype(np.int64) >> (16 - c)
    diff = np.where((c > 0) & (extra < (1 << np.maximum(c - 1, 0))), extra - (1 << c) + 1, extra)
    pos = pos + c
    k, going = np.ones(len(pos), np.int64), np.arange(len(pos))
    while len(going):
        got = ac[peek(pos[going])]
        if (got < 0).any():
            raise ValueError("no such AC code")
        symbol = got >> 8
        pos[going] += (got & 255) + (symbol & 15)
        k[going] += (symbol >> 4) + 1
        going = going[(symbol != 0) & (k[going] < 64)]
    return diff, pos - start


def thumbnails(streams: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each stream its pictures: width, height and DC-only luminance thumbnail (rows x columns of 0..255)."""
    found = [list(_parse(s)) for s in streams]
    alike: dict = {}
    for i, pictures in enumerate(found):
        for j, p in enumerate(pictures):
            alike.setdefault((p.layout, p.tables), []).append((i, j, p))
    out: list[list] = [[None] * len(p) for p in found]
    for (layout, tables), own in alike.items():
        data = np.frombuffer(b"".join([p.data for *_, p in own]) + b"\0" * 8, np.uint8).astype(np.uint32)
        words = (data[:-3] << np.uint32(24)) | (data[1:-2] << np.uint32(16)) | (data[2:-1] << np.uint32(8)) | data[3:]
        base = np.cumsum([0] + [len(p.data) for *_, p in own])
        pos = np.concatenate([(b + np.array(p.lanes, np.int64)) * 8 for b, (*_, p) in zip(base, own, strict=False)])
        units = np.concatenate([np.array(p.blocks, np.int64) for *_, p in own])
        luma = sum(u[0] for u in layout)
        order = np.argsort(-units, kind="stable")
        pos, left = pos[order], units[order]
        got = np.zeros((int(left.max()) * luma, len(pos)), np.int16)
        last = [np.zeros(len(pos), np.int32) for _ in layout]
        where = {}
        for n, u in enumerate(layout):
            where.setdefault((u[1], u[4], u[5], u[0]), n)
        step = 0
        for unit in range(int(left[0])):
            n = int(np.searchsorted(-left, -unit, "left"))
            for u in layout:
                dc, ac, whole = _looks(tables[u[1] >> 4], tables[4 + (u[1] & 15)])
                p = pos[:n]
                e = whole[(words[p >> 3] >> (16 - (p & 7)).astype(np.uint32)) & np.uint32(0xFFFF)]
                bits, diff = e & 255, (e >> 8) - 4096
                odd = np.flatnonzero(bits == 0)
                if len(odd):
                    diff[odd], bits[odd] = _slow(words, p[odd].copy(), dc, ac)
                pos[:n] += bits
                before = last[where[u[1], u[4], u[5], u[0]]]
                before[:n] += diff
                if u[0]:
                    got[step, :n] = before[:n]
                    step += 1
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        lane = 0
        for i, j, p in own:
            lanes = back[lane : lane + len(p.lanes)]
            lane += len(p.lanes)
            if len(set(p.blocks)) == 1:
                flat = got[: p.blocks[0] * luma, lanes].T.reshape(-1, luma)
            else:
                flat = np.concatenate([got[: n * luma, k].reshape(-1, luma) for n, k in zip(p.blocks, lanes, strict=True)])
            down, across = p.grid
            v, h = next((u[4], u[5]) for u in layout if u[0])
            grid = flat.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h).astype(np.int32)
            value = np.clip((grid * p.quant + 4 + 1024) >> 3, 0, 255).astype(np.uint8)
            out[i][j] = (p.width, p.height, value[: -(-p.height // 8), : -(-p.width // 8)])
    return out


def feature(thumbnail: np.ndarray) -> str:
    """Rows x columns and a 64-bit average hash: means over an 8 x 8 mesh, a bit for each that reaches their mean."""
    n, m = thumbnail.shape
    rows, columns = np.linspace(0, n, 9).astype(int), np.linspace(0, m, 9).astype(int)
    a, c = np.minimum(rows[:-1], n - 1), np.minimum(columns[:-1], m - 1)
    b, d = np.maximum(rows[1:], a + 1), np.maximum(columns[1:], c + 1)
    total = np.zeros((n + 1, m + 1), np.int64)
    np.cumsum(np.cumsum(thumbnail, axis=0, dtype=np.int64), axis=1, out=total[1:, 1:])
    means = (total[b][:, d] - total[a][:, d] - total[b][:, c] + total[a][:, c]) / ((b - a)[:, None] * (d - c)[None, :])
    return f"{n}x{m}:{np.packbits((means >= means.mean()).ravel()).tobytes().hex()}"


def stacked(pictures: list) -> np.ndarray:
    """The thumbnails of a stream's pictures, one below the other; narrower ones are filled up with zeros."""
    most = max(t.shape[1] for *_, t in pictures)
    return np.concatenate([np.pad(t, ((0, 0), (0, most - t.shape[1]))) for *_, t in pictures])


def padded(raw: np.ndarray) -> np.ndarray:
    out = np.full(max(1, -(-len(raw) // ROW)) * ROW, 32, np.uint8)
    out[: len(raw)] = raw
    return out


def store(df: DataFrame, text: str = "text", media: str = "media", size: str = "n_bytes") -> DataFrame:
    """df with the JPEG of each text's UTF-8 bytes, filled up with spaces to a positive multiple of 192, and the
    number of bytes before that. Null texts are stored as empty ones. Columns named as the new ones are replaced."""
    df = without(df, media, size)
    tune(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = texts_of(batch.column(batch.schema.get_field_index(text)))
            for a, b in passes(at):
                got = [write(padded(raw[x:y])) for x, y in zip(at[a:b], at[a + 1 : b + 1], strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(got, pa.binary()), pa.array(np.diff(at[a : b + 1]))], [*batch.schema.names, media, size])

    return df.mapInArrow(lean(run), df.select("*", F.lit(b"").alias(media), F.lit(0).cast("long").alias(size)).schema)


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """df with width, height (in pixels, of all pictures one below the other), thumbnail (binary, rows of all pictures one after the
    other) and thumbnail_hash of a column of baseline JPEG. Null stays null; what isn't baseline JPEG is an error."""
    tune(df.sparkSession)
    df = without(df, "width", "height", "thumbnail", "thumbnail_hash")
    schema = df.select("*", F.lit(0).alias("width"), F.lit(0).alias("height"), F.lit(b"").alias("thumbnail"), F.lit("").alias("thumbnail_hash")).schema
    for field in schema.fields[-4:]:
        field.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(media))
            raw, at = texts_of(column)
            for a, b in passes(at):
                streams = [raw[x:y].tobytes() for x, y in zip(at[a:b], at[a + 1 : b + 1], strict=True)]
                rows = [(max(x[0] for x in p), sum(x[1] for x in p), b"".join(t.tobytes() for *_, t in p), feature(stacked(p))) if p else (None,) * 4 for p in thumbnails(streams)]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *(pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.string())))], [*batch.schema.names, "width", "height", "thumbnail", "thumbnail_hash"])

    return df.mapInArrow(lean(run), schema)


def digests(docs: DataFrame) -> DataFrame:
    """Digests of every text's stored form and of what is read back from it, without moving either: doc_id, n_bytes,
    payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature. No shuffle."""
    tune(docs.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = texts_of(batch.column(1))
            for a, b in passes(at):
                streams = [write(padded(raw[x:y])) for x, y in zip(at[a:b], at[a + 1 : b + 1], strict=True)]
                out = []
                for doc, size, stream, pictures in zip(batch.column(0).slice(a, b - a).to_pylist(), np.diff(at[a : b + 1]).tolist(), streams, thumbnails(streams), strict=True):
                    payload = b"".join(t.tobytes() for *_, t in pictures)
                    out.append((doc, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stream), hashlib.sha256(stream).hexdigest(), feature(stacked(pictures))))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
