"""BPE encoding and decoding.

Encoding splits a text as the vocabulary's pre-tokenizer does and encodes each piece by backtracking: an Aho-Corasick
pass finds the longest token at every byte, and a token is accepted after another only if the pair is compatible,
that is, if merging in rank order leaves the border between the two standing. This gives the exact merges in time
linear in the piece. Decoding gathers bytes from one buffer through an offset table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import lean, passes, texts_of, tune, without

#: Fixed value: the public pre-tokenizer pattern of byte-level BPE, with \\s written as the White_Space property.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
_WIDE, _LONE_SPACE = re.compile(r"\s\s|\A\s|\s\Z"), re.compile(r"(?<=\S) (?=\S)")
#: Pieces kept encoded in each of a worker's two generations of memory, their characters and bytes of ids, and the longest that is kept.
KEPT_PIECES, KEPT_BYTES, LONG_PIECE = 120_000, 8 << 20, 512


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, by rule: printable bytes are
    themselves, the others take the code points from 256 on in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Pairs(dict):
    """The pair-compatibility table, filled as pairs turn up; a pair (a, b) has the key a << 20 | b."""

    def __init__(self, stands):
        super().__init__()
        self.stands = stands

    def __missing__(self, key: int) -> bool:
        if len(self) > 500_000:
            self.clear()
        self[key] = fits = self.stands(key >> 20, key & 0xFFFFF)
        return fits


class _Kept(dict):
    """Strings already encoded: a young generation, which is this dictionary, and the one before it. Each is bounded in
    number and in bytes, and long strings, which hardly come again, aren't kept."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old, self.size = encode, {}, 0

    def __missing__(self, piece: str) -> bytes:
        if (got := self.old.get(piece)) is None:
            got = self.encode(piece)
        if len(piece) > LONG_PIECE:
            return got
        if len(self) >= KEPT_PIECES or self.size >= KEPT_BYTES:
            self.old, self.size = dict(self), 0
            self.clear()
        self.size += len(piece) + len(got)
        self[piece] = got
        return got


class Vocabulary:
    """A byte-level BPE vocabulary from the text of a tokenizers JSON file.

    Inside, tokens are numbered by age: the bytes first, then merges in rank order, so a larger number was made later.
    """

    def __init__(self, text: str):
        spec = json.loads(text)
        model, letter = spec["model"], byte_letters()
        to_bytes = lambda token: bytes(letter[c] for c in token)
        ids = {to_bytes(token): i for token, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = [(to_bytes(a), to_bytes(b)) for a, b in merges]
        self.tokens = [bytes([b]) for b in range(256)] + [a + b for a, b in pairs]
        number: dict[bytes, int] = {}
        for i, token in enumerate(self.tokens):
            number.setdefault(token, i)
        self.left = [*range(256), *(number[a] for a, _ in pairs)]
        self.right = [*range(256), *(number[b] for _, b in pairs)]
        self.made = {(number[a], number[b]): 256 + i for i, (a, b) in enumerate(pairs)}
        self.size = [len(t) for t in self.tokens]
        self.packed = [np.uint32(ids[t]).astype("<u4").tobytes() for t in self.tokens]
        self.shorter = [-1] * len(self.tokens)
        for i, token in enumerate(self.tokens):
            for n in range(len(token) - 1, 0, -1):
                if (prefix := number.get(token[:n])) is not None:
                    self.shorter[i] = prefix
                    break
        self.matcher = ahocorasick.Automaton()
        for token, i in number.items():
            self.matcher.add_word(token.decode("latin-1"), i)
        self.matcher.make_automaton()
        self.compatible = _Pairs(self.stands)
        self.pieces = _Kept(lambda piece: self.encode_piece(piece.encode()))
        self.spaced = _Kept(self._words)
        self.find = regex.compile(PIECES).findall
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None

    def stands(self, a: int, b: int) -> bool:
        """Whether tokens a, b stay apart when their bytes are merged together.

        Undo the younger of the two again and again: a pair that meets at the border merges if its rank comes
        before the merge that was undone. Of equal ranks the left one merges first.
        """
        before = len(self.tokens) + 1
        left, right, made = self.left, self.right, self.made
        while True:
            if made.get((a, b), before) < before:
                return False
            if a < 256 and b < 256:
                return True
            if a > b:
                before, a = a, right[a]
            else:
                before, b = b + 1, left[b]

    def encode_piece(self, piece: bytes) -> bytes:
        size, shorter, fits, packed = self.size, self.shorter, self.compatible, self.packed
        n = len(piece)
        longest, reach = [0] * n, [0] * n
        for end, token in self.matcher.iter(piece.decode("latin-1")):
            start = end + 1 - (long := size[token])
            if reach[start] < long:
                reach[start], longest[start] = long, token
        if reach[0] == n:
            return packed[longest[0]]
        out = [longest[0]]
        dead = bytearray(n + 1)
        at = reach[0]
        token = longest[at]
        while True:
            before = out[-1] << 20 if out else -1
            while token >= 0 and (dead[at + size[token]] or (before >= 0 and not fits[before | token])):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                if at == n:
                    return b"".join([packed[t] for t in out])
                token = longest[at]
            else:
                dead[at] = 1
                token = out.pop()
                at -= size[token]
                token = shorter[token]

    def _words(self, word: str) -> bytes:
        pieces = self.pieces
        if word.isalpha():
            return self.encode_piece((" " + word).encode())
        if word[-1] in ".," and word[:-1].isalpha():
            return self.spaced[word[:-1]] + pieces[word[-1]]
        return b"".join(map(pieces.__getitem__, self.find(" " + word)))

    def _plain(self, text: str) -> list[bytes]:
        """Pieces never cross a space that has a non-space on either side, so what lies between such is kept whole."""
        if not text:
            return []
        first, *rest = _LONE_SPACE.split(text) if _WIDE.search(text) else text.split(" ")
        return [*map(self.pieces.__getitem__, self.find(first)), *map(self.spaced.__getitem__, rest)]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.split is None or not any(s in text for s in self.special):
            return b"".join(self._plain(text))
        out = []
        for part in self.split(text):
            out += [np.uint32(self.special[part]).astype("<u4").tobytes()] if part in self.special else self._plain(part)
        return b"".join(out)


class Decoder:
    """Bytes of every token in one buffer, with an offset table."""

    def __init__(self, text: str):
        spec, letter = json.loads(text), byte_letters()
        by_id = {i: bytes(letter[c] for c in token) for token, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        ordered = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.sizes = np.array([len(t) for t in ordered], np.int64)
        self.offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.sizes)])
        self.bytes = np.frombuffer(b"".join(ordered), np.uint8)

    def decode_all(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """Texts of rows of ids laid end to end, as UTF-8 with U+FFFD for bytes that are none."""
        if len(ids) and int(ids.max()) >= len(self.sizes):
            raise ValueError("an id is outside the vocabulary")
        length = self.sizes[ids]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(length)])
        got = self.bytes[np.repeat(self.offsets[ids] - ends[:-1], length) + np.arange(ends[-1])].tobytes()
        out = []
        for a, b in zip(ends[at[:-1]], ends[at[1:]], strict=True):
            row = got[a:b]
            try:
                row.decode()
            except UnicodeDecodeError:
                row = row.decode("utf-8", "replace").encode()
            out.append(row)
        return out


_OPEN: dict[type, tuple[int, object]] = {}


def opened(kind: type, text: str):
    """This worker's Vocabulary or Decoder; the last one of each stays open."""
    if kind not in _OPEN or _OPEN[kind][0] != hash(text):
        _OPEN.pop(kind, None)
        _OPEN[kind] = (hash(text), kind(text))
    return _OPEN[kind][1]


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", count: str = "n_tokens", exact: str | None = None) -> DataFrame:
    """df with `ids` (binary, little-endian unsigned 32-bit) and `count` (long) of each whole text.

    vocabulary: the text of a tokenizers JSON file (a few MB, whatever the corpus holds; it goes to the tasks as a
    broadcast). Null texts encode as empty ones: no bytes, count 0. Strings of special tokens become their ids.
    With `exact`, a column of that name (boolean) tells whether the ids decode to the text, by the offset table.
    Columns of df that are named as the new ones are replaced; all others stay. No shuffle.
    """
    more = [] if exact is None else [exact]
    df = without(df, ids, count, *more)
    spark = df.sparkSession
    tune(spark)
    sent = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = opened(Vocabulary, sent.value)
        back = opened(Decoder, sent.value) if more else None
        for whole in batches:
            for a, b in passes(texts_of(whole.column(whole.schema.get_field_index(text)))[1]):
                batch = whole.slice(a, b - a)
                column = batch.column(batch.schema.get_field_index(text))
                got = [own.encode(t.as_py()) if t.is_valid else b"" for t in column]
                new = [pa.array(got, pa.binary()), pa.array([len(x) // 4 for x in got], pa.int64())]
                if back is not None:
                    at = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) // 4 for x in got])])
                    texts = back.decode_all(np.frombuffer(b"".join(got), "<u4"), at)
                    new.append(pa.array([x == (t.as_py() or "").encode() for x, t in zip(texts, column, strict=True)]))
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, ids, count, *more])

    return df.mapInArrow(lean(run), T.StructType([*df.schema.fields, T.StructField(ids, T.BinaryType()), T.StructField(count, T.LongType()), *(T.StructField(c, T.BooleanType()) for c in more)]))


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of `ids` in place of it. Null ids decode as the empty text. No shuffle."""
    df = without(df, out)
    tune(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)
    kept = [f for f in df.schema.fields if f.name != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = opened(Decoder, sent.value)
        for batch in batches:
            raw, at = texts_of(batch.column(batch.schema.get_field_index(ids)))
            for a, b in passes(at):
                got = own.decode_all(np.frombuffer(raw[at[a] : at[b]].tobytes(), "<u4"), (at[a : b + 1] - at[a]) // 4)
                kept_columns = [batch.column(batch.schema.get_field_index(f.name)).slice(a, b - a) for f in kept]
                yield pa.RecordBatch.from_arrays([*kept_columns, pa.array(got, pa.binary()).cast(pa.string())], [*(f.name for f in kept), out])

    return df.mapInArrow(lean(run), T.StructType([*kept, T.StructField(out, T.StringType())]))


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, through encode() and decode()."""
    coded = encode(docs.select("doc_id", "text"), vocabulary).select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"))
    return decode(coded, vocabulary).select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
