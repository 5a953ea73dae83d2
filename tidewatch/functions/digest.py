"""MD5 of many short texts at once, as draws ask for it."""

from __future__ import annotations

import hashlib

import numpy as np

_SHIFTS = np.repeat(np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]), 4, axis=0).reshape(-1)
_SINES = [int(abs(np.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _first_words(block: np.ndarray) -> np.ndarray:
    """First state word after one block; block is 16 x messages. Words that all messages share are added as one number.

    That word is set by step 60, so the last three aren't taken. Arrays are used again, as memory costs more than sums here.
    """
    words = [int(w[0]) if (w == w[0]).all() else w for w in block]
    a, b, c, d = (np.full(block.shape[1], s, np.uint32) for s in _START)
    f, turned = np.empty_like(a), np.empty_like(a)
    for i in range(61):
        if i < 16:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            g = i
        elif i < 32:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            g = (3 * i + 5) % 16
        else:  # c ^ (b | ~d)
            np.invert(d, out=f)
            f |= b
            f ^= c
            g = 7 * i % 16
        f += a
        if isinstance(words[g], int):
            f += np.uint32((_SINES[i] + words[g]) & 0xFFFFFFFF)
        else:
            f += np.uint32(_SINES[i])
            f += words[g]
        s = int(_SHIFTS[i])
        np.left_shift(f, np.uint32(s), out=turned)
        f >>= np.uint32(32 - s)
        turned |= f
        turned += b
        a, b, c, d, turned = d, turned, b, c, a
    return b + np.uint32(_START[0])


def md5_heads(prefix: bytes, start: int, stop: int, at_once: int = 8192) -> np.ndarray:
    """First 32 bits of the MD5 of prefix + str(k), for k from start up to stop."""
    out = np.empty(max(stop - start, 0), np.int64)
    k = start
    while k < stop:
        digits = len(str(k))
        end = min(stop, 10**digits, k + at_once)
        size = len(prefix) + digits
        if size > 55:  # more than one block
            out[k - start : end - start] = [int.from_bytes(hashlib.md5(prefix + b"%d" % j).digest()[:4], "big") for j in range(k, end)]
        else:
            text = np.zeros((end - k, 64), np.uint8)
            text[:, : len(prefix)] = np.frombuffer(prefix, np.uint8)
            rest = np.arange(k, end)
            for place in range(size - 1, len(prefix) - 1, -1):
                text[:, place] = 48 + rest % 10
                rest //= 10
            text[:, size] = 0x80
            text[:, 56:] = np.frombuffer((8 * size).to_bytes(8, "little"), np.uint8)
            out[k - start : end - start] = _first_words(np.ascontiguousarray(text.view("<u4").T)).byteswap()
        k = end
    return out
