"""Packing token sequences as a cutting-stock problem.

Each document is tokenised whole; its ids are cut into full sequences and one rest.
Lengths of pieces are classed by eighths of 64 tokens (``grain``); the histogram of
classes, of at most ``size / grain`` bins whatever the input, is all the driver sees.
Column generation solves the linear program over packing patterns: a revised simplex
keeps the basis, an unbounded-knapsack dynamic program prices the next pattern. The
solution is rounded down, what is left is packed by first-fit decreasing over the
classes, and pieces ranked in their class take the patterns' places.

Defined results: null and empty texts are the one end id; repeated rows are packed
each; a null doc_id stays null; further columns are dropped; an empty table gives no row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slicer.llm.session import bound_batches, checkpointed

SIZE = 2048
GRAIN = 8
END_ID = 1
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"

#: Words of these characters are one pre-token each, stable under normalisation but for lower case.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
PUNCTUATION = ".,;:!?"


def byte_letters() -> dict[int, str]:
    """The visible character that byte-level vocabularies write for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordIds(dict):
    """The ids (little-endian unsigned 32 bit) of each white-space-free word, computed once.

    The tokenizer drops white space and never joins what it separates, so a text's
    ids are those of its words in order. ``most`` bounds the memory of the cache.
    """

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole, self.most = Tokenizer.from_file(path), most
        self.model, self.letters = self.whole.model, byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        text = word.decode("utf-8", "replace")
        if LETTERS.fullmatch(text):
            low = text.lower()
            if low == text:
                got = pack(t.id for t in self.model.tokenize("".join(self.letters[b] for b in word)))
            else:
                got = self[low.encode()]
        elif text[-1] in PUNCTUATION and LETTERS.fullmatch(text, 0, len(text) - 1):
            got = self[text[:-1].lower().encode()] + self[text[-1].encode()]
        else:
            got = pack(self.whole.encode(text, add_special_tokens=False).ids)
        self[word] = got
        return got


def pack(ids) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


@cache
def word_ids(path: str) -> WordIds:
    """One cache a worker process, kept between tasks."""
    return WordIds(path)


def document_ids(text: bytes | None, ids: WordIds) -> bytes:
    return b"".join([ids[w] for w in (text or b"").split()]) + pack([END_ID])


def _pieces(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                all_ids = document_ids(text, ids)
                n = len(all_ids) // 4
                rows += [(doc, a, min(size, n - a), zlib.crc32(all_ids[4 * a : 4 * (a + size)]), n) for a in range(0, n, size)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pieces(documents: DataFrame, tokenizer_path: str, size: int = SIZE) -> DataFrame:
    """Each document's ids cut into runs of ``size`` and a rest."""
    bound_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(_pieces(tokenizer_path, size), PIECES)


# --- the cutting-stock plan over the histogram -------------------------------------


def best_pattern(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of lengths 1..capacity (value[k] for length k + 1) of most value that fits, by dynamic program."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    for c in range(1, capacity + 1):
        with_last = value[:c] + best[c - 1 :: -1][:c]
        k = int(with_last.argmax())
        best[c], took[c] = (with_last[k], k + 1) if with_last[k] > best[c - 1] + 1e-12 else (best[c - 1], 0)
    pattern, c = np.zeros(capacity), capacity
    while c > 0:
        if took[c]:
            pattern[took[c] - 1] += 1
        c -= took[c] or 1
    return best[capacity], pattern


def column_generation(demand: np.ndarray, most_steps: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one a row) and how often each is used in the linear program's optimum, for demand of lengths 1..n."""
    n = len(demand)
    patterns = np.diag([n // k for k in range(1, n + 1)]).astype(float)
    inverse = np.diag(1 / np.diag(patterns))
    used = inverse @ demand
    for _ in range(most_steps):
        value, column = best_pattern(np.clip(np.ones(n) @ inverse, 0, None), n)
        if value <= 1 + 1e-9:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        used = used - ratio[out] * step
        used[out] = ratio[out]
        patterns[out] = column
        inverse[out] /= step[out]
        others = np.arange(n) != out
        inverse[others] -= np.outer(step[others], inverse[out])
    return patterns, np.clip(used, 0, None)


def plan(demand: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(pattern, sequences) that hold each class exactly ``demand`` times; class k is k + 1 grains long."""
    demand, out, left = demand.astype(np.int64), [], demand.astype(np.int64).copy()
    present = demand > 0
    if not present.any():
        return []
    patterns, used = column_generation(demand.astype(float))
    for pattern, x in sorted(zip(patterns.astype(np.int64), used, strict=True), key=lambda p: -p[1]):
        need = pattern > 0
        times = min(int(x + 1e-6), int((left[need] // pattern[need]).min())) if need.any() else 0
        if times:
            out.append((pattern, times))
            left -= times * pattern
    while left.any():  # first-fit decreasing over what rounding has left
        pattern, room = np.zeros_like(left), len(left)
        for k in range(len(left) - 1, -1, -1):
            n = min(left[k], room // (k + 1))
            pattern[k] += n
            room -= n * (k + 1)
        need = pattern > 0
        times = int((left[need] // pattern[need]).min())
        out.append((pattern, times))
        left -= times * pattern
    return out


def packed(documents: DataFrame, tokenizer_path: str, *, size: int = SIZE, grain: int = GRAIN, bucket_rows: int = 200_000) -> DataFrame:
    """Pieces with the sequence and offset that each takes."""
    spark = documents.sparkSession
    rows = checkpointed(pieces(documents, tokenizer_path, size))
    rows = rows.withColumn("class", F.ceil(F.col("length") / grain).cast("int"))
    histogram = {r["class"]: r["n"] for r in rows.groupBy("class").agg(F.count("*").alias("n")).collect()}  # size / grain bins
    demand = np.array([histogram.get(k + 1, 0) for k in range(size // grain)])
    # places of each pattern: ranks [low, high) of a class fill ``per`` slots of each of its sequences
    places, taken, base = [], np.zeros(len(demand), np.int64), 0
    for pattern, times in plan(demand):
        slot = 0
        for k in np.flatnonzero(pattern).tolist():
            per = int(pattern[k])
            places.append((k + 1, int(taken[k]), int(taken[k]) + per * times, per, base, slot))
            taken[k] += per * times
            slot += per
        base += times
    places_df = spark.createDataFrame(places, "class int, low bigint, high bigint, per int, base bigint, slot int")
    # ranks without one task per class: ranks within buckets, after the counts of the buckets before
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(demand.sum()) // bucket_rows))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("class", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("class", "bucket", (F.sum("n").over(Window.partitionBy("class").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = rows.withColumn("own", F.row_number().over(Window.partitionBy("class", "bucket").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32")))
    ranked = ranked.join(before, ["class", "bucket"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    at = ranked.alias("r").join(F.broadcast(places_df).alias("p"), F.expr("r.class = p.class and r.rank >= p.low and r.rank < p.high"))  # at most (size / grain) ** 2 places
    at = at.select(*[f"r.{c}" for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")], F.expr("p.base + (r.rank - p.low) div p.per").alias("sequence_id"), F.expr("p.slot + (r.rank - p.low) % p.per").alias("slot"))
    line = Window.partitionBy("sequence_id").orderBy("slot")
    return at.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", (F.sum("length").over(line) - F.col("length")).alias("offset"))
