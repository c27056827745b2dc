"""Vectorised words and hashes over the UTF-8 bytes of Arrow string batches.

Everything here works on whole batches of texts with numpy: no Python loop runs
per word. A ``Words`` holds the byte spans of all words of some texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
MASK = (1 << 64) - 1
#: Odd multipliers for polynomial hashes modulo 2**64; any odd numbers serve.
BYTE_BASE = 0x9E3779B97F4A7C15
SECOND_BYTE_BASE = 0xC2B2AE3D27D4EB4F
WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Bytes of text that are hashed at a time (a longer single text is taken alone).
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that sums of hashes do not cancel."""
    x = (x ^ (x >> U64(31))) * U64(0x7FB5D329728EA185)
    x = (x ^ (x >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


@cache
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.ones(1 << bits, U64)
    for k in range(bits):
        n = 1 << k
        out[n : 2 * n] = out[:n] * U64(pow(base, n, 1 << 64))
    return out


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, max(12, int(n).bit_length()))[:n]


def string_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and where each text begins (and the last ends)."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(texts) else np.empty(0, np.uint8)
    return buf, off - (off[0] if len(off) else 0)


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, offsets) for runs of texts of about CHUNK bytes, so that work stays in cache."""
    buf, off = string_bytes(texts)
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + CHUNK, side="right")) - 1)
        yield a, buf[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


@dataclass
class Words:
    buf: np.ndarray  # bytes of all texts
    start: np.ndarray  # of each word
    end: np.ndarray
    first: np.ndarray  # index of each text's first word, and the number of words at the end

    @property
    def n(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), self.n)

    def hashes(self, base: int = BYTE_BASE) -> np.ndarray:
        """A 64-bit hash of each word's bytes; those of two bases are independent."""
        size = len(self.buf) + 1
        run = np.zeros(size, U64)
        np.cumsum((self.buf.astype(U64) + U64(1)) * powers(base, size)[:-1], out=run[1:])
        back = powers(pow(base, -1, 1 << 64), size)
        return mix((run[self.end] - run[self.start]) * back[self.start])


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """A-Z to lower case; all other bytes stay."""
    return np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)


def is_plain(buf: np.ndarray) -> np.ndarray:
    """Bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    return ~((buf == 32) | ((buf >= 9) & (buf <= 13)))


def is_alnum(buf: np.ndarray) -> np.ndarray:
    """Bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` in text without A-Z."""
    return ((buf >= 48) & (buf <= 57)) | ((buf >= 97) & (buf <= 122)) | (buf >= 128)


def words(buf: np.ndarray, off: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of bytes that are ``inside`` a word; no word spans two texts."""
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[:-1] = inside
    before = np.zeros(len(buf) + 1, np.int8)
    before[1:] = inside
    cut = np.zeros(len(buf) + 1, bool)
    cut[off] = True
    start = np.flatnonzero((edge == 1) & ((before == 0) | cut))
    end = np.flatnonzero((before == 1) & ((edge == 0) | cut))
    return Words(buf, start, end, np.searchsorted(start, off, side="left"))


def windows(h: np.ndarray, length: int, base: int = WORD_BASES[0]) -> np.ndarray:
    """A hash of every run of ``length`` consecutive word hashes (also across texts; mask those out)."""
    m = len(h) - length + 1
    if m <= 0:
        return np.empty(0, U64)
    # by doubling: a window of 2k words is one of k words and the next of k words
    b, have, out = U64(base), 1, h
    step, parts, done = U64(base), None, 0
    need = length
    while True:
        if need & 1:
            if parts is None:
                parts, done = out, have
            else:  # the words so far, then ``have`` more
                shift = U64(pow(int(b), have, 1 << 64))
                k = len(h) - done - have + 1
                parts = parts[:k] * shift + out[done : done + k]
                done += have
        need >>= 1
        if not need:
            return mix(parts[:m])
        k = len(out) - have
        out = out[:k] * step + out[have : have + k]
        have *= 2
        step = U64(int(step) * int(step) & MASK)
