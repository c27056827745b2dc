"""Quality rules on counts, and repetition measured on suffix arrays of words.

The suffix array of a batch of texts is refined by prefix doubling: ranks by the first
1, 2, 4, ... words, where only positions whose rank is still shared go on. The ranks of
all levels give the longest common prefix of neighbours in the array, and from these
each position's longest repeat. Those of ``min_repeat`` words or more are the occurrences
of the maximal repeated substrings (the intervals of the array); their union is the covered part.

A document is kept if it passes the base rules, at most ``max_covered`` of its words are
covered and no repeat is longer than ``max_repeat`` words.

Defined results: null and empty texts have no words and fail the base rules; repeated rows
are judged each; a null doc_id stays null; further columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicer.llm.session import bound_batches
from slicer.llm.words import Words, chunks, is_plain, words

SYMBOLS = b"#*$%&|<>"
SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, covered double, longest_repeat bigint"


def dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks from 0 in the order of ``keys``, the first the most significant; equal keys share a rank."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def rank_levels(h: np.ndarray, text: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """Ranks of every position by its first 1, 2, 4, ... words until none is shared within its text.

    ``last`` is the end of each position's text. A rank is the least place in the order that
    its group takes, so groups refine in place and single positions never move again.
    A prefix that would run past its text's end is ordered first.
    """
    n = len(h)
    first = dense(text, h)
    size = np.bincount(first) if n else np.empty(0, np.int64)
    rank = (np.cumsum(size) - size)[first] if n else first
    levels, length = [rank], 1
    shared = np.flatnonzero(size[first] > 1) if n else np.empty(0, np.int64)
    while len(shared):
        after = shared + length
        inside = after < last[shared]
        second = np.where(inside, rank[np.minimum(after, n - 1)], -1 - after)  # ends differ, so they are never equal
        group = dense(rank[shared], second)
        count = np.bincount(group)
        offset = (np.cumsum(count) - count)[group]
        start = np.zeros(len(shared), np.int64)
        order = np.argsort(rank[shared], kind="stable")
        r = rank[shared][order]
        start[order] = np.searchsorted(r, r)  # places taken by smaller groups among the shared
        rank = rank.copy()
        rank[shared] += offset - start
        levels.append(rank)
        shared = shared[count[group] > 1]
        length *= 2
    return levels


def longest_repeats(levels: list[np.ndarray], text: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For every position, how many words from there occur elsewhere in its text too."""
    n = len(text)
    if n < 2:
        return np.zeros(n, np.int64)
    array = np.argsort(levels[-1], kind="stable")
    a, b = array[:-1].copy(), array[1:].copy()
    alive, common = text[a] == text[b], np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        length = 1 << k
        ok = alive & (a + length <= last[array[:-1]]) & (b + length <= last[array[1:]])
        ok[ok] = levels[k][a[ok]] == levels[k][b[ok]]
        common[ok] += length
        a[ok] += length
        b[ok] += length
        alive &= (a < last[array[:-1]]) & (b < last[array[1:]])
    out = np.zeros(n, np.int64)
    out[array[:-1]] = common
    out[array[1:]] = np.maximum(out[array[1:]], common)
    return out


def covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a span; spans stay inside their texts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge)[:-1] > 0


def per_text(values: np.ndarray, w: Words) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[w.first[1:]] - total[w.first[:-1]]


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.split()]
    return len(lines) - len(set(lines))


def _measure(min_repeat: int, max_covered: float, max_repeat: int):
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, buf, off in chunks(batch["text"]):
                inside = is_plain(buf)
                w = words(buf, off, inside)
                n = w.n
                total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[off])  # noqa: B023, E731
                chars, symbols = total(inside & (buf & 0xC0 != 0x80)), total(symbol[buf])
                data = buf.tobytes()
                lines = [duplicate_lines(data[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                h, text = w.hashes(), w.text_of()
                last = w.first[1:][text]
                levels = rank_levels(h, text, last)
                repeat = longest_repeats(levels, text, last)
                at3 = np.flatnonzero(repeat >= 3)
                n_repeat = per_text(covered(at3, np.full(len(at3), 3), len(h)), w)
                long = np.flatnonzero(repeat >= min_repeat)
                share = per_text(covered(long, repeat[long], len(h)), w) / np.maximum(n, 1)
                longest = np.zeros(len(n), np.int64)
                np.maximum.at(longest, text, repeat)
                failed = (n < 50) | (100 * n_repeat > 50 * n)
                kept = ~failed & (share <= max_covered) & (longest <= max_repeat)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(first, len(n)), *(pa.array(np.asarray(x, np.int64)) for x in (n, chars, symbols, lines, n_repeat)), pa.array(failed), pa.array(kept), pa.array(share), pa.array(longest)],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered", "longest_repeat"],
                )

    return run


def quality(documents: DataFrame, *, min_repeat: int = 8, max_covered: float = 0.4, max_repeat: int = 120) -> DataFrame:
    """Counts and verdict for every row."""
    bound_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(_measure(min_repeat, max_covered, max_repeat), SCHEMA)
