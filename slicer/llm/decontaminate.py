"""Benchmark windows in documents, by a prefix-filtered set join.

An item's windows are runs of ``width`` words (a shorter item is one window). A
window's shingles are its word pairs; counted over all documents in one scan, they are ordered by
rarity. The counts are kept in ``BUCKETS`` by hash, so that their size does not depend on the benchmark; shingles that
share a bucket look more frequent than they are, which changes where the search begins, never what it finds. A document holds a window only if it holds all of its shingles, so the
necessary prefix is the single rarest one: only places where it occurs are
candidates. Positional and length bounds drop those where the window would begin
before or end after the document, and the rest are verified word by word.

The benchmark is sent to the executors in blocks of about ``block_words`` words,
each a pass within the same stage, so what is broadcast is bounded whatever its
size (one item longer than that is a block of its own). Documents are never shuffled, so no group of copies meets in one task.

Defined results: texts of any length are read whole; empty tables give no rows, or no hits; null texts have no words; null item texts have no windows and null
item ids are left out of the items; repeated rows are judged each; further columns
are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from slicer.llm.session import bound_batches
from slicer.llm.words import WORD_BASES, Words, chunks, is_alnum, lower_ascii, windows, words

#: Buckets of shingle counts; 32 MB where they are counted.
BUCKETS = 1 << 22
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
STATE = "doc_id bigint, text string, spans binary, items array<string>"
RESULT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def item_words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "replace").translate(bytes(lower_ascii(np.arange(256, dtype=np.uint8)))))


@dataclass
class Block:
    """Windows of some items: their words, hash, item ids and the place of the rarest shingle."""

    texts: list[bytes]
    length: np.ndarray
    hash: np.ndarray
    items: list[list[str]]
    #: by shingle size (1 for windows of one word, else 2): sorted shingle hashes, then windows and offsets in that order
    index: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _hashes(text: bytes) -> np.ndarray:
    buf = np.frombuffer(text, np.uint8)
    return words(buf, np.array([0, len(buf)]), is_alnum(buf)).hashes()


def item_windows(rows: list[tuple[str | None, str | None]], width: int) -> dict[bytes, list[str]]:
    found: dict[bytes, set[str]] = {}
    for item, text in rows:
        ws = item_words(text)
        for i in range(max(1, len(ws) - width + 1) if ws else 0):
            found.setdefault(b" ".join(ws[i : i + width]), set()).update([item] if item is not None else [])
    return {k: sorted(v) for k, v in found.items()}


def shingles_of(h: np.ndarray) -> tuple[int, np.ndarray]:
    return (1, h) if len(h) == 1 else (2, windows(h, 2))


def build(found: dict[bytes, list[str]], counts: dict[int, np.ndarray]) -> Block:
    texts = sorted(found)
    length, full, keys = [], [], {1: [], 2: []}
    for i, t in enumerate(texts):
        h = _hashes(t)
        size, s = shingles_of(h)
        rare = int(counts[size][bucket(s)].argmin())
        keys[size].append((int(s[rare]), i, rare))
        length.append(len(h))
        full.append(int(windows(h, len(h), WORD_BASES[1])[0]))
    index = {}
    for size, rows in keys.items():
        rows.sort()
        index[size] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64))
    return Block(texts, np.array(length, np.int64), np.array(full, np.uint64), [found[t] for t in texts], index)


class Lookup:
    """Which of many hashes are in a small sorted set: a bitmap first, then binary search."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.bits = np.uint64((1 << max(16, min(24, 4 + len(self.keys).bit_length()))) - 1)
        self.table = np.zeros(int(self.bits) + 1, bool)
        self.table[(self.keys & self.bits).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Positions in ``h`` of keys."""
        at = np.flatnonzero(self.table[(h & self.bits).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0]
        k = np.searchsorted(self.keys, h[at])
        return at[self.keys[np.minimum(k, len(self.keys) - 1)] == h[at]]


def document_words(buf: np.ndarray, off: np.ndarray) -> Words:
    low = lower_ascii(buf)
    return words(low, off, is_alnum(low))


def occurrences(w: Words, block: Block, lookups: dict[int, Lookup]) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence in the texts of ``w``."""
    h, text_of, starts, wins = w.hashes(), w.text_of(), [], []
    full = {}
    for size, (keys, window, offset) in block.index.items():
        s = h if size == 1 else windows(h, 2)
        at = lookups[size].find(s)
        if not len(at):
            continue
        lo, hi = np.searchsorted(keys, s[at]), np.searchsorted(keys, s[at], side="right")
        n = hi - lo
        entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(at, n)
        win, start = window[entry], at - offset[entry]
        ends = start + block.length[win]
        text = text_of[at]
        ok = (start >= w.first[text]) & (ends <= w.first[text + 1])  # positional and length bounds
        win, start = win[ok], start[ok]
        for length in np.unique(block.length[win]).tolist():
            if length not in full:
                full[length] = windows(h, length, WORD_BASES[1])
            of = block.length[win] == length
            same = full[length][start[of]] == block.hash[win[of]]
            starts.append(start[of][same])
            wins.append(win[of][same])
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start, win = np.concatenate(starts), np.concatenate(wins)
    data = w.buf.tobytes()
    exact = [b" ".join(data[a:b] for a, b in zip(w.start[s : s + n].tolist(), w.end[s : s + n].tolist(), strict=True)) == block.texts[i] for s, i, n in zip(start.tolist(), win.tolist(), block.length[win].tolist(), strict=True)]
    return start[exact], win[exact]


def bucket(s: np.ndarray) -> np.ndarray:
    return (s & np.uint64(BUCKETS - 1)).astype(np.int64)


def _shingle_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets that the shingles of some items fall into."""
    seen = {1: np.zeros(BUCKETS, bool), 2: np.zeros(BUCKETS, bool)}
    for batch in batches:
        for _, buf, off in chunks(batch["text"]):
            w = document_words(buf, off)
            h = w.hashes()
            seen[1][bucket(h[w.first[:-1][w.n == 1]])] = True  # items of one word
            seen[2][bucket(windows(h, 2))] = True
    for size, some in seen.items():
        at = np.flatnonzero(some)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size, np.int32)), pa.array(at.astype(np.int32))], ["size", "bucket"])


def _counts(wanted):
    """Occurrences of shingles in a partition of documents, by those buckets that items have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = {size: np.unpackbits(np.frombuffer(bits, np.uint8), count=BUCKETS).astype(bool) for size, bits in wanted.value.items()}
        total = {size: np.zeros(BUCKETS, np.int64) for size in chosen}
        for batch in batches:
            for _, buf, off in chunks(batch["text"]):
                h = document_words(buf, off).hashes()
                for size, some in chosen.items():
                    at = bucket(h if size == 1 else windows(h, 2))
                    np.add.at(total[size], at[some[at]], 1)
        for size, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["size", "bucket", "n"])

    return run


def shingle_counts(docs: DataFrame, items: DataFrame) -> dict[int, np.ndarray]:
    """By shingle size, how often shingles of each bucket occur in all documents, where items have some: one scan, at most 2 * BUCKETS numbers."""
    given = items.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_shingle_buckets, "size int, bucket int").distinct().toArrow()
    counts, wanted = {1: np.zeros(BUCKETS, np.int64), 2: np.zeros(BUCKETS, np.int64)}, {}
    size, at = given["size"].to_numpy(), given["bucket"].to_numpy()
    for k in np.unique(size).tolist():
        some = np.zeros(BUCKETS, bool)
        some[at[size == k]] = True
        wanted[k] = np.packbits(some).tobytes()
    if wanted:
        sent = docs.sparkSession.sparkContext.broadcast(wanted)  # a bit a bucket
        found = docs.select("text").mapInArrow(_counts(sent), "size int, bucket int, n bigint").groupBy("size", "bucket").agg(F.sum("n").alias("n")).toArrow()
        for k in wanted:
            of = found["size"].to_numpy() == k
            counts[k][found["bucket"].to_numpy()[of]] = found["n"].to_numpy()[of]
    return counts


def _mark(block, last: bool, carry: bool):
    """Add a block's occurrences to the spans and items of each document; the last pass digests them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = block.value
        lookups = {s: Lookup(k[0]) for s, k in b.index.items()}
        for batch in batches:
            n = len(batch["text"])
            old_spans, old_items = batch["spans"].to_pylist(), batch["items"].to_pylist()
            spans: list[np.ndarray] = [np.frombuffer(x or b"", "<i4").reshape(-1, 2) for x in old_spans]
            items: list[set[str]] = [set(x or ()) for x in old_items]
            n_words, n_hit = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for first, buf, off in chunks(batch["text"]):
                w = document_words(buf, off)
                start, win = occurrences(w, b, lookups)
                text = np.searchsorted(w.first, start, side="right") - 1
                order = np.argsort(text, kind="stable")
                start, win, text = start[order], win[order], text[order]
                cut = np.searchsorted(text, np.arange(len(off)))
                n_words[first : first + len(off) - 1] = w.n
                for t in np.unique(text).tolist():
                    sl = slice(cut[t], cut[t + 1])
                    local = start[sl] - w.first[t]
                    spans[first + t] = np.concatenate([spans[first + t], np.stack([local, local + b.length[win[sl]]], 1)])
                    items[first + t].update(x for i in np.unique(win[sl]).tolist() for x in b.items[i])
            row = [batch["row"]] if carry else []
            if not last:
                yield pa.RecordBatch.from_arrays([*row, batch["doc_id"], batch["text"], pa.array([s.astype("<i4").tobytes() for s in spans], pa.binary()), pa.array([sorted(i) for i in items], pa.list_(pa.string()))], [*["row"][: len(row)], "doc_id", "text", "spans", "items"])
                continue
            for t, s in enumerate(spans):
                if len(s):
                    edge = np.zeros(n_words[t] + 1, np.int64)
                    np.add.at(edge, s[:, 0], 1)
                    np.add.at(edge, s[:, 1], -1)
                    n_hit[t] = (np.cumsum(edge) > 0).sum()
            digest = [hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items]
            yield pa.RecordBatch.from_arrays([*row, batch["doc_id"], pa.array(n_words), pa.array(n_hit), pa.array([len(i) for i in items], pa.int64()), pa.array(digest), pa.array(n_hit > 0)], [*["row"][: len(row)], "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return run


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, width: int = 10, block_words: int = 200_000, carry: bool = False) -> DataFrame:
    """For every row: words, words inside an occurrence of a window, items with occurring windows.

    ``carry`` adds the whole row as a struct, ``row``.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    n_words = items.agg(F.sum(F.size(F.split("text", r"\W+")))).first()[0] or 0
    n_blocks = max(1, -(-n_words // block_words))
    state, kept = docs, []
    if carry:
        state = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        kept = [state.schema["row"]]
    state = state.withColumns({"spans": F.lit(b"").cast("binary"), "items": F.array().cast("array<string>")})
    counts = shingle_counts(docs, items)
    for i in range(n_blocks):
        rows = [(r.item, r.text) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == i).toLocalIterator()]  # about block_words words
        found = item_windows(rows, width)
        last = i == n_blocks - 1
        state = state.mapInArrow(_mark(spark.sparkContext.broadcast(build(found, counts)), last, carry), StructType([*kept, *StructType.fromDDL(RESULT if last else STATE)]))
    return state


def clean(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any occurrence of a benchmark window, with all their columns."""
    return decontaminate(documents, benchmark, carry=True, **options).where("not contaminated").select("row.*")
