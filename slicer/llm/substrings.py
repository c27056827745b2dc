"""Removal of repeated passages by level-wise doubling of word windows.

Level one looks at windows of half the length. Only those repeated somewhere are
extended to the full length, where the first occurrence of each window is found and
every word under a later one is removed.

At half length not every position is needed: of the half windows inside a full window
the one of least hash (leftmost if tied) stands for it, its anchor. Equal windows have
equal anchors, so a window can repeat only if its anchor's hash occurs again, and
anchors are about one position in six. An anchor whose hash occurs once ends there.

Each surviving anchor carries the hashes of the windows it stands for. Windows that
repeat within a batch are settled there (only the batch's first goes on). Anchors whose hash occurs at most ``crowd``
times meet in one task. Those of crowded hashes are dealt out window by window and, so that neither copies nor a common
line gather in one task, in ``SALTS`` parts each: only a part's first occurrence goes on, and those
of all parts, at most ``SALTS`` a window, meet in a second exchange. Half and full windows are hashed from independent 64-bit word hashes, 128 bits together.

Order is by doc_id, then start. Defined results: null texts have no words; a null
doc_id counts as greater than any; repeated equal rows are the same document (neither
removes from the other); texts of any length are read whole; an empty table gives no rows; rows with one doc_id and different texts are documents of
their own, ordered by a hash of the text; further columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from slicer.llm.session import bound_batches, checkpointed
from slicer.llm.words import SECOND_BYTE_BASE, U64, WORD_BASES, Words, chunks, is_plain, mix, windows, words

LAST = (1 << 63) - 1
SALTS = 256


def sliding_argmin(values: np.ndarray, n: int) -> np.ndarray:
    """Where the leftmost least of every ``n`` consecutive values is."""
    best, at, have = values, np.arange(len(values)), 1
    while have < n:
        step = min(have, n - have)
        a, b = best[: len(best) - step], best[step:]
        right = b < a
        best = np.where(right, b, a)
        at = np.where(right, at[step:], at[: len(at) - step])
        have += step
    return at


def anchored(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every window of the texts: its first word and its anchor; then the word hashes and half-window hashes."""
    h, half = w.hashes(), window // 2
    if len(h) < window:
        return np.empty(0, np.int64), np.empty(0, np.int64), h, np.empty(0, U64)
    text = w.text_of()
    halves = windows(h, half)
    start = np.flatnonzero(text[: len(h) - window + 1] == text[window - 1 :])
    return start, sliding_argmin(halves, window - half + 1)[start], h, halves


def _level_one(window: int):
    """(key, doc, tag, pos) of every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag = batch["doc"].to_numpy(zero_copy_only=False), batch["tag"].to_numpy(zero_copy_only=False)
            for first, buf, off in chunks(batch["text"]):
                w = words(buf, off, is_plain(buf))
                _, anchor, _, halves = anchored(w, window)
                chosen = np.zeros(len(halves), bool)
                chosen[anchor] = True
                at = np.flatnonzero(chosen)
                text = np.searchsorted(w.first, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(halves[at].view(np.int64)), pa.array(doc[first + text]), pa.array(tag[first + text]), pa.array((at - w.first[text]).astype(np.int32))], ["key", "doc", "tag", "pos"])

    return run


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ..., n of each."""
    return np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _spans(doc: np.ndarray, tag: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Runs of consecutive later windows as (doc, tag, span); span = first * 65536 + windows."""
    cut = np.ones(len(start), bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(cut)
    n = np.diff(np.append(at, len(start)))
    # a run never outgrows its 16 bits: longer ones are cut
    parts = -(-n // 60_000)
    row = np.repeat(at, parts)
    k = _ranges(np.zeros(len(at), np.int64), parts)
    length = np.minimum(60_000, np.repeat(n, parts) - 60_000 * k)
    return pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(tag[row]), pa.array((start[row] + 60_000 * k) * 65536 + length), pa.nulls(len(row), pa.int64()), pa.nulls(len(row), pa.int32()), pa.nulls(len(row), pa.list_(pa.int64())), pa.nulls(len(row), pa.bool_())], ["doc", "tag", "span", "key", "start", "hashes", "alone"])


def _level_two(window: int):
    """From texts with surviving anchors: spans settled within the batch, and records (key, doc, tag, start, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag = batch["doc"].to_numpy(zero_copy_only=False), batch["tag"].to_numpy(zero_copy_only=False)
            kept = batch["anchors"]
            for first, buf, off in chunks(batch["text"]):
                n_texts = len(off) - 1
                w = words(buf, off, is_plain(buf))
                start, anchor, h, halves = anchored(w, window)
                marks = kept.slice(first, n_texts)
                values = marks.flatten().to_numpy(zero_copy_only=False)
                count = marks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                at = np.repeat(w.first[:-1], count) + (values >> 1)
                alive, crowded = np.zeros(len(halves) + 1, bool), np.zeros(len(halves) + 1, bool)
                alive[at], crowded[at] = True, (values & 1) == 1
                some = alive[anchor]
                start, anchor = start[some], anchor[some]
                if not len(start):
                    continue
                full = windows(w.hashes(SECOND_BYTE_BASE), window, WORD_BASES[1])[start]
                text = np.searchsorted(w.first, start, side="right") - 1
                d, t, local = doc[first + text], tag[first + text], start - w.first[text]
                # repeats within this batch: all but the first are later windows
                order = np.lexsort((local, t, d))
                order = order[np.lexsort((halves[anchor[order]], full[order]))]
                same = np.zeros(len(order), bool)
                same[1:] = (full[order[1:]] == full[order[:-1]]) & (halves[anchor[order[1:]]] == halves[anchor[order[:-1]]])
                head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
                later = np.zeros(len(order), bool)
                later[order] = same & ~((d[order] == d[head]) & (t[order] == t[head]) & (local[order] == local[head]))
                if later.any():
                    yield _spans(d[later], t[later], local[later])
                # the rest goes on: by anchor, or window by window where the anchor's hash is crowded
                on = ~later
                a, s, l2, f2, d2, t2 = anchor[on], start[on], local[on], full[on], d[on], t[on]
                alone = crowded[a]
                cut = np.ones(len(a), bool)
                cut[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1) | alone[1:]
                row = np.flatnonzero(cut)
                key = np.where(alone[row], mix(halves[a[row]] ^ f2[row]), halves[a[row]])
                hashes = pa.ListArray.from_arrays(pa.array(np.append(row, len(a)).astype(np.int32)), pa.array(f2.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(d2[row]), pa.array(t2[row]), pa.nulls(len(row), pa.int64()), pa.array(key.view(np.int64)), pa.array(l2[row].astype(np.int32)), hashes, pa.array(alone[row])], ["doc", "tag", "span", "key", "start", "hashes", "alone"])

    return run


LEVEL_TWO = "doc bigint, tag bigint, span bigint, key bigint, start int, hashes array<bigint>, alone boolean"
NAMES = [c.split()[0] for c in LEVEL_TWO.split(", ")]


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of later windows, and the first ones of a part of a crowded window, from records sorted by (key, doc, tag, start)."""
    last_key, seen = None, {}  # firsts of the key that the batch before ended with
    for batch in batches:
        if not batch.num_rows:
            continue
        key, doc, tag, first = (batch[c].to_numpy(zero_copy_only=False) for c in ("key", "doc", "tag", "start"))
        n = batch["hashes"].value_lengths().to_numpy(zero_copy_only=False)
        h = batch["hashes"].flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(key)), n)
        d, t, start = doc[row], tag[row], _ranges(first.astype(np.int64), n)
        group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        g = group[row]
        order = np.lexsort((h, g))
        same = np.zeros(len(order), bool)
        same[1:] = (g[order[1:]] == g[order[:-1]]) & (h[order[1:]] == h[order[:-1]])
        head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        later = np.zeros(len(order), bool)
        later[order] = same & ~((d[order] == d[head]) & (t[order] == t[head]) & (start[order] == start[head]))
        if last_key is not None and key[0] == last_key:
            for i in range(int(np.searchsorted(g, 1))):
                f = seen.get(int(h[i]))
                if f is not None and f != (d[i], t[i], start[i]):
                    later[i] = True
        if key[-1] != last_key:
            last_key, seen = key[-1], {}
        for i in range(int(np.searchsorted(g, g[-1])), len(g)):
            seen.setdefault(int(h[i]), (d[i], t[i], start[i]))
        if later.any():
            out = _spans(d[later], t[later], start[later])
            yield out.select(NAMES)
        head = batch["alone"].to_numpy(zero_copy_only=False)[row].astype(bool) & ~later
        if head.any():
            one = pa.ListArray.from_arrays(pa.array(np.arange(head.sum() + 1, dtype=np.int32)), pa.array(h[head]))
            yield pa.RecordBatch.from_arrays([pa.array(d[head]), pa.array(t[head]), pa.nulls(len(one), pa.int64()), pa.array(key[row[head]]), pa.array(start[head].astype(np.int32)), one, pa.array(np.zeros(len(one), bool))], NAMES)


def kept_words(text: bytes, spans: np.ndarray, window: int) -> tuple[int, list[bytes]]:
    """How many words a text has, and those under no later window."""
    ws = text.split()
    if not len(spans):
        return len(ws), ws
    edge = np.zeros(len(ws) + 1, np.int64)
    np.add.at(edge, spans >> 16, 1)
    np.add.at(edge, (spans >> 16) + (spans & 65535) + window - 1, -1)
    gone = np.cumsum(edge)[:-1] > 0
    return len(ws), [x for x, g in zip(ws, gone.tolist(), strict=True) if not g]


def _each(batch: pa.RecordBatch, window: int) -> Iterator[tuple[int, list[bytes]]]:
    spans = batch["spans"]
    values, at = spans.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(spans.value_lengths().to_numpy(zero_copy_only=False))])
    for i, text in enumerate(batch["text"].cast(pa.binary()).to_pylist()):
        yield kept_words(text, values[at[i] : at[i + 1]], window)


def _finish(window: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(n, n - len(k), b" ".join(k)) for n, k in _each(batch, window)]
            kept = pa.array([hashlib.sha256(f[2]).hexdigest() for f in found], pa.string()) if digest else pa.array([f[2] for f in found], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), kept], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def _rewrite(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [b" ".join(k) if len(k) < n else None for n, k in _each(batch, window)]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(kept, pa.binary()).cast(pa.string())], ["row", "kept"])

    return run


def later_spans(documents: DataFrame, *, window: int = 20, crowd: int = 5000) -> tuple[DataFrame, DataFrame, Column]:
    """Documents as (doc_id, doc, tag, text), their spans of later windows (doc, tag, spans), and the tag's expression."""
    bound_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("doc", F.coalesce("doc_id", F.lit(LAST)))
    hashed = docs.select("doc", F.xxhash64("text").alias("h"))
    clash = not hashed.groupBy("doc").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a < b").isEmpty()
    tag = F.xxhash64("text") if clash else F.expr("doc & 0L")  # not a literal, so that it stays a join key
    docs = docs.withColumn("tag", tag)
    anchors = docs.select("doc", "tag", "text").mapInArrow(_level_one(window), "key bigint, doc bigint, tag bigint, pos int")
    # a table of its own, so that adaptive execution can split a common key's rows in the join
    repeated = checkpointed(anchors.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    marks = anchors.join(repeated, "key").select("doc", "tag", F.expr(f"pos * 2L + int(n > {crowd})").alias("mark"))
    marks = marks.groupBy("doc", "tag").agg(F.collect_list("mark").alias("anchors"))  # as long as the document at most
    # with the same columns as in removed(), so that texts are exchanged once for both
    records = docs.join(marks, ["doc", "tag"]).select("doc_id", "doc", "tag", "text", "anchors").mapInArrow(_level_two(window), LEVEL_TWO)
    # both kinds of rows pass one exchange: settled spans are spread by document, crowded windows by window and part
    part = F.when(F.col("alone"), F.xxhash64("key", F.pmod(F.xxhash64("doc", "tag"), F.lit(SALTS)))).otherwise(F.coalesce("key", F.xxhash64("doc", "tag", "span")))
    dealt = records.withColumn("to", part).repartition("to").sortWithinPartitions("key", "doc", "tag", "start")
    first = dealt.mapInArrow(_pass_or_settle, LEVEL_TWO)
    # then the parts' firsts, at most SALTS a window; all in one plan, so that texts are exchanged once for both joins
    again = first.withColumn("to", F.coalesce("key", F.xxhash64("doc", "tag", "span"))).repartition("to").sortWithinPartitions("key", "doc", "tag", "start")
    spans = again.mapInArrow(_pass_or_settle, LEVEL_TWO).where("span is not null").select("doc", "tag", "span")
    return docs, spans.groupBy("doc", "tag").agg(F.collect_list("span").alias("spans")), tag


def _pass_or_settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ready = []

    def open_records() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            settled = batch["key"].is_null()
            if settled.true_count:
                ready.append(batch.filter(settled).select(NAMES))
                batch = batch.filter(batch["key"].is_valid())
            yield batch

    for out in _settle(open_records()):
        yield from ready
        ready.clear()
        yield out
    yield from ready


def removed(documents: DataFrame, *, window: int = 20, digest: bool = False, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row; kept: the kept words joined by one space, or its SHA-256."""
    docs, spans, _ = later_spans(documents, window=window, **options)
    return docs.join(spans, ["doc", "tag"], "left").select("doc_id", "text", F.coalesce("spans", F.array().cast("array<bigint>")).alias("spans")).mapInArrow(_finish(window, digest), "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def deduplicated(documents: DataFrame, *, window: int = 20, **options) -> DataFrame:
    """``documents`` with their kept words as text and n_chars to match; texts that lose nothing stay as they are."""
    _, spans, tag = later_spans(documents, window=window, **options)
    tagged = documents.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tagged = tagged.withColumn("tag", tag)
    joined = tagged.join(spans, ["doc", "tag"], "left").select("row", "text", "spans")
    schema = StructType([joined.schema["row"], StructField("kept", StringType())])
    done = joined.withColumn("spans", F.coalesce("spans", F.array().cast("array<bigint>"))).mapInArrow(_rewrite(window), schema)
    new = {"text": F.when(F.col("kept").isNotNull(), F.col("kept")).otherwise(F.col("row.text"))}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.when(F.col("kept").isNotNull(), F.length("kept")).otherwise(F.col("row.n_chars")).cast(documents.schema["n_chars"].dataType)
    return done.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in documents.columns])
