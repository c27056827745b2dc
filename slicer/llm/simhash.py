"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints of whole texts are reduced to one row a distinct fingerprint. A
binary trie over 64 bits would be traversed as pairs of nodes; to distribute it,
the bits are rotated so that each of ``distance + 1`` blocks is once on top: two
fingerprints within ``distance`` agree on at least one whole block, so in that
rotation they lie under the same top node. Each top node's subtrie is joined with
itself in one task, descending pairs of nodes together, adding up differing bits
and pruning pairs over the budget. Subtries with more than ``most`` leaves are
split once more by the blocks of their remaining bits, by the same argument.

Links are returned as stars inside each subtrie, a forest with the same connected
components as all links.

``near_duplicates`` links fingerprints within a few bits. Texts that share 0.8 of their
five-word shingles differ in about 8 of 64 bits, which such a budget misses, so
``similar_documents`` takes several tables of short fingerprints (signs of random
projections), lets the trie join propose pairs in each and accepts those whose shingle
similarity, estimated from a 256-byte min-hash signature beside the fingerprint, is high enough
(at most one standard error of the estimate below it). Fingerprints that thousands of texts share
cannot be told apart by further bits; ``_hot_stars`` deals such a key out in parts twice and then
compares what is not connected yet with every part, so no link under the key is lost.

Defined results: null texts and texts without a word have fingerprint zero and
are linked like any other; rows with a null doc_id get the component of equal
fingerprints (in ``similar_documents`` also of similar texts), else null; repeated rows are
returned each; further columns are dropped. ``keep_one`` takes texts, not ids: rows with one
doc_id and different texts are different documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicer.llm.graph import components
from slicer.llm.session import bound_batches, checkpointed, written
from slicer.llm.words import U64, Words, chunks, is_plain, lower_ascii, windows, words

BITS = 64


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The SimHash of a text's shingles, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, 42)]
    else:
        end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        start = np.concatenate([[0], end[:-1] + 1])
        hashes = [digest(joined[a:b], 42) for a, b in zip(start[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist(), strict=True)]
    h, ones = np.array(hashes, "<u8"), np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fingerprints as signed 64-bit integers."""
    bound_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(_fingerprints(shingle), "doc_id bigint, fp bigint")


# --- the trie join of one subtrie -------------------------------------------------


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


class Labels:
    """The same with every root at hand, so that a test of many indices is one array operation."""

    def __init__(self, label: np.ndarray):
        self.label = label

    def link(self, i: int, j: int) -> None:
        x, y = sorted((int(self.label[i]), int(self.label[j])))
        if x != y:
            self.label[self.label == y] = x


def trie_join(values: np.ndarray, distance: int, leaf: int = 64, similar=None, bits: int = BITS, linked: np.ndarray | None = None) -> np.ndarray:
    """Roots (indices) of the groups of sorted ``values`` linked within ``distance`` bits.

    A trie node is a run of the sorted values that share their leading bits. ``similar``
    (of two arrays of indices) decides about pairs within the distance that are not yet connected;
    ``linked`` are the roots of what is connected from the start.
    """
    forest = Forest(len(values)) if similar is None else Labels(np.arange(len(values)) if linked is None else linked.copy())
    todo = [(0, len(values), 0, len(values), bits - 1, 0)]
    while todo:
        a, b, c, d, bit, spent = todo.pop()
        if a == b or c == d:
            continue
        if similar is None and spent + bit + 1 <= distance:  # all remaining bits may differ
            for i in range(a + 1, b):
                forest.link(a, i)
            for j in range(c, d):
                forest.link(a, j)
            continue
        if bit < 0 and (b - a) * (d - c) > leaf * leaf:  # equal fingerprints: blocks of them
            mid = [(lo + hi) // 2 for lo, hi in ((a, b), (c, d))]
            halves = [[(a, mid[0]), (mid[0], b)], [(c, mid[1]), (mid[1], d)]]
            todo += [(*x, *y, bit, spent) for x in halves[0] for y in halves[1] if x[0] < y[1]]
            continue
        if (b - a) * (d - c) <= leaf * leaf:
            if similar is not None:
                left, right = forest.label[a:b].copy(), forest.label[c:d].copy()
                if (left == left[0]).all() and (right == left[0]).all():
                    continue  # all connected: nothing to learn
                near = (left[:, None] != right[None, :]) & (np.bitwise_count(values[a:b, None] ^ values[None, c:d]) <= distance)
                i, j = np.nonzero(near)
                i, j = (a + i)[a + i < c + j], (c + j)[a + i < c + j]
                if len(i):
                    ok = similar(i, j)
                    for x, y in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
                        forest.link(x, y)
                continue
            near = np.bitwise_count(values[a:b, None] ^ values[None, c:d]) <= distance
            for i, j in zip(*np.nonzero(near), strict=True):
                if a + i < c + j:
                    forest.link(a + int(i), c + int(j))
            continue
        mid = [lo + int(np.searchsorted(values[lo:hi] >> np.uint64(bit) & np.uint64(1), 1)) for lo, hi in ((a, b), (c, d))]
        todo += [(a, mid[0], c, mid[1], bit - 1, spent), (mid[0], b, mid[1], d, bit - 1, spent)]
        if spent < distance:
            todo.append((a, mid[0], mid[1], d, bit - 1, spent + 1))
            if (a, b) != (c, d):  # a node paired with itself has its mirrored pair already
                todo.append((mid[0], b, c, mid[1], bit - 1, spent + 1))
    return np.array([forest.root(i) for i in range(len(values))], np.int64) if similar is None else forest.label


def _subtries(distance: int):
    """Stars (a, b) of linked nodes in each key's subtrie; rows come sorted by key."""

    def join(fp: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(fp, kind="stable")
        fp, node = fp[order], node[order]
        root = trie_join(fp, distance)
        other = root != np.arange(len(root))
        return node[other], node[root[other]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = _keys(batches, lambda b: [b["fp"].to_numpy(zero_copy_only=False).view(U64), b["node"].to_numpy(zero_copy_only=False)])
        yield from _pairs(join(*values) for values in keys)

    return run


def _keys(batches: Iterator[pa.RecordBatch], columns) -> Iterator[list[np.ndarray]]:
    """The ``columns`` of each key's rows, which come sorted by key; keys of one row are left out."""
    parts: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, values = batch["key"].to_numpy(zero_copy_only=False), columns(batch)
        cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            if parts and parts[0][0] != key[i]:
                if sum(len(p[1]) for p in parts) > 1:
                    yield [np.concatenate([p[k] for p in parts]) for k in range(1, len(parts[0]))]
                parts = []
            parts.append([key[i], *(v[i:j] for v in values)])
    if parts and sum(len(p[1]) for p in parts) > 1:
        yield [np.concatenate([p[k] for p in parts]) for k in range(1, len(parts[0]))]


def _pairs(found: Iterator[tuple[np.ndarray, np.ndarray]], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The pairs of many keys in batches of about ``rows``."""
    some: list[tuple[np.ndarray, np.ndarray]] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in some]), pa.int64()) for k in (0, 1)], ["a", "b"])

    held = 0
    for pair in found:
        if len(pair[0]):
            some.append(pair)
            held += len(pair[0])
        if held >= rows:
            yield batch()
            some, held = [], 0
    if some:
        yield batch()


def _block(value: str, low: int, high: int) -> str:
    return f"(shiftrightunsigned({value}, {low}) & {(1 << (high - low)) - 1}L)"


def _cuts(n: int, parts: int) -> list[tuple[int, int]]:
    at = [round(i * n / parts) for i in range(parts + 1)]
    return list(zip(at[:-1], at[1:], strict=True))


def links(classes: DataFrame, distance: int = 2, most: int = 20_000) -> DataFrame:
    """Stars (a, b) between nodes of ``classes`` (node, fp distinct) whose fingerprints are within ``distance``."""
    parts = distance + 1
    tops = [F.expr(f"struct({i} as i, {_block('fp', lo, hi)} as top)") for i, (lo, hi) in enumerate(_cuts(BITS, parts))]
    rows = classes.select("node", "fp", F.explode(F.array(*tops)).alias("t")).select("node", "fp", "t.i", F.expr(f"t.top * {parts} + t.i").alias("key"))
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(counts, "key").select("key", "fp", "node", "i", "n")
    # a crowded subtrie is split by blocks of the bits below its top
    below = []
    for i, (lo, hi) in enumerate(_cuts(BITS, parts)):
        free = [b for b in range(BITS) if not lo <= b < hi]
        rest = f"(({_block('fp', hi, BITS)} << {lo}) | {_block('fp', 0, lo)})" if 0 < lo and hi < BITS else _block("fp", hi, BITS) if hi < BITS else _block("fp", 0, lo)
        below.append(f"when i = {i} then array({', '.join(f'xxhash64(key, {j}, {_block(rest, a, b)})' for j, (a, b) in enumerate(_cuts(len(free), parts)))})")
    crowded = rows.where(F.col("n") > most).select("fp", "node", F.explode(F.expr(f"case {' '.join(below)} end")).alias("key")).select("key", "fp", "node")
    split = rows.where(F.col("n") <= most).select("key", "fp", "node").unionByName(crowded)
    return split.repartition("key").sortWithinPartitions("key").mapInArrow(_subtries(distance), "a bigint, b bigint")


def near_duplicates(documents: DataFrame, *, shingle: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id reachable over links."""
    rows = checkpointed(fingerprints(documents, shingle))
    classes = checkpointed(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = components(links(classes, distance))
    named = classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return rows.join(named, "fp", "left").select("doc_id", "fp", "component_id")


# --- by similarity ------------------------------------------------------------------

SKETCH = 1024
BINS = 256
SIGNED = "doc_id bigint, exact string, digest binary, tables array<bigint>, signature binary"


@cache
def projection(columns: int, seed: int = 20) -> np.ndarray:
    """A fixed matrix of random signs."""
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (SKETCH, columns))


def signatures(buf: np.ndarray, off: np.ndarray, n_tables: int, bits: int, projected: int, compared: int) -> tuple[np.ndarray, np.ndarray, Words]:
    """For each text: its fingerprints (texts x tables) and its min-hash signature (texts x BINS bytes, 0: empty)."""
    low = lower_ascii(buf)
    w = words(low, off, is_plain(low))
    n, h, text = len(off) - 1, w.hashes(), w.text_of()

    def shingles(size: int) -> tuple[np.ndarray, np.ndarray]:
        s = windows(h, size)
        inside = text[: len(s)] == text[size - 1 : size - 1 + len(s)]
        return s[inside], text[: len(s)][inside]

    s, t = shingles(projected)
    flat = t * SKETCH + (s & U64(SKETCH - 1)).astype(np.int64)
    sign = 1.0 - 2.0 * ((s >> U64(20)) & U64(1)).astype(np.float64)
    sketch = np.bincount(flat, sign, n * SKETCH).reshape(n, SKETCH).astype(np.float32)
    ones = (sketch @ projection(n_tables * bits) > 0).reshape(n, n_tables, bits)
    tables = (ones * (U64(1) << np.arange(bits, dtype=U64))).sum(2, dtype=U64)
    s, t = shingles(compared)
    least = np.full(n * BINS, np.iinfo(np.uint64).max, U64)
    np.minimum.at(least, t * BINS + (s & U64(BINS - 1)).astype(np.int64), s >> U64(8))
    code = np.where(least == np.iinfo(np.uint64).max, 0, 1 + least % U64(255)).astype(np.uint8)
    return tables, code.reshape(n, BINS), w


def _signed(n_tables: int, bits: int, projected: int, compared: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, buf, off in chunks(batch["text"]):
                tables, code, w = signatures(buf, off, n_tables, bits, projected, compared)
                n, data = len(off) - 1, w.buf.tobytes()
                digest = [hashlib.md5(b" ".join(data[a:b].split()), usedforsecurity=False).digest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * n_tables, n_tables, dtype=np.int32)), pa.array(tables.reshape(-1).view(np.int64)))
                some = code.any(1)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, n), batch["exact"].slice(first, n), pa.array(digest, pa.binary()), lists, pa.array([c.tobytes() if x else None for c, x in zip(code, some.tolist(), strict=True)], pa.binary())], ["doc_id", "exact", "digest", "tables", "signature"])

    return run


def _similar_subtries(distance: int, least: float, bits: int):
    """Stars (a, b) of verified links in each key's subtrie; rows come sorted by key, those of one ``label`` are connected."""

    def join(fp: np.ndarray, node: np.ndarray, label: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((node, fp))
        fp, node, label, code = fp[order], node[order], label[order], code[order]
        _, first, same = np.unique(label, return_index=True, return_inverse=True)

        def similar(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            x, y = code[i], code[j]
            both, either = ((x == y) & (x > 0)).sum(1), ((x > 0) | (y > 0)).sum(1)
            return both >= least * either

        root = trie_join(fp, distance, similar=similar, bits=bits, linked=first[same])
        new = np.flatnonzero((root != first[same]) & (np.arange(len(root)) == first[same]))  # a link a label is enough
        return node[new], node[root[new]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns(b: pa.RecordBatch) -> list[np.ndarray]:
            code = np.frombuffer(b"".join(b["signature"].to_pylist()), np.uint8).reshape(-1, BINS)
            return [b["fp"].to_numpy(zero_copy_only=False).view(U64), b["node"].to_numpy(zero_copy_only=False), b["label"].to_numpy(zero_copy_only=False), code]

        yield from _pairs(join(*values) for values in _keys(batches, columns))

    return run


def _stars(rows: DataFrame, join) -> DataFrame:
    return rows.select("key", "fp", "node", "label", "signature").repartition("key").sortWithinPartitions("key").mapInArrow(join, "a bigint, b bigint")


def _hot_stars(hot: DataFrame, others: DataFrame, join, most: int) -> DataFrame:
    """Stars of the rows of ``hot`` (key, n, fp, node, signature), keys of n > ``most`` rows, given all ``others``' stars.

    The rows of a key are dealt out in parts of about ``most`` twice, by independent hashes, and joined
    part by part: a group of near copies is connected through the nodes that parts of both deals share.
    What is then outside the key's largest component is compared with every part of the key, in blocks,
    which completes the pairs of the key; it is little wherever copies make the key hot.
    """
    parts = F.expr(f"cast(ceil(n / {most}) as bigint)")
    dealt = lambda seed: F.xxhash64("key", F.lit(seed), F.pmod(F.xxhash64("node", "key", F.lit(seed)), parts))
    twice = hot.select(F.explode(F.array(dealt(1), dealt(2))).alias("key"), "fp", "node", F.col("node").alias("label"), "signature")
    stars = written(others.unionByName(_stars(twice, join)))
    found = components(stars)
    hot = hot.join(found, "node", "left").select("key", "n", "fp", "node", "signature", F.coalesce("component", "node").alias("label"))
    largest = hot.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("largest"))
    # one row a key, and a key has more than ``most`` rows; adaptive execution chooses the join
    rest = written(hot.join(largest, "key").where("label <> largest").drop("largest"))
    if rest.isEmpty():
        return stars
    base = hot.join(rest.select("key").distinct(), "key", "left_semi").withColumn("part", F.pmod(F.xxhash64("node", "key", F.lit(3)), parts))
    rest = rest.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    blocks = base.unionByName(rest).withColumn("key", F.xxhash64("key", F.lit(3), "part"))
    return stars.unionByName(_stars(blocks, join))


def _bounded(keys: DataFrame, most: int = 100_000) -> DataFrame:
    """``keys``, broadcast if they are counted to be few."""
    return F.broadcast(keys) if keys.count() <= most else keys


def _exact(text: str = "text"):
    return F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _similar(documents: DataFrame, *, similarity: float = 0.8, compared: int = 5, projected: int = 2, n_tables: int = 8, bits: int = 32, distance: int = 2, most: int = 20_000) -> DataFrame:
    """(doc_id, exact, component) of every row: its id, a hash of its text and its group; nodes are distinct texts."""
    bound_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _exact().alias("exact"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = checkpointed(rows.mapInArrow(_signed(n_tables, bits, projected, compared), SIGNED))
    # the checkpoint fixes the numbers of the nodes
    classes = checkpointed(rows.groupBy("digest").agg(F.first("tables").alias("tables"), F.first("signature").alias("signature")).withColumn("node", F.monotonically_increasing_id()))
    parts = distance + 1
    blocks = _cuts(bits, parts)
    wide = classes.where("signature is not null").select("node", "signature", F.posexplode("tables").alias("t", "fp"))
    tops = [F.expr(f"struct({i} as i, {_block('fp', lo, hi)} as top)") for i, (lo, hi) in enumerate(blocks)]
    rows_of = lambda df, *more: df.select("node", "fp", "t", *more, F.explode(F.array(*tops)).alias("x")).select("node", "fp", *more, "x.i", F.expr(f"(x.top * {parts} + x.i) * {n_tables} + t").alias("key"))
    join = _similar_subtries(distance, similarity - (similarity * (1 - similarity) / BINS) ** 0.5, bits)
    crowded = checkpointed(rows_of(wide).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key", F.lit(True).alias("crowded")))
    spread = rows_of(wide, "signature").withColumn("label", F.col("node"))
    if crowded.isEmpty():
        stars = _stars(spread, join)
    else:  # split by blocks of the bits outside the top, as in links()
        below = []
        for i, (lo, hi) in enumerate(blocks):
            rest = " + ".join(([f"({_block('fp', hi, bits)} << {lo})"] if hi < bits else []) + ([_block("fp", 0, lo)] if lo else []))
            below.append(f"when i = {i} then array({', '.join(f'xxhash64(key, {j}, {_block(chr(40) + rest + chr(41), a, b)})' for j, (a, b) in enumerate(_cuts(bits - (hi - lo), parts)))})")
        split = lambda df, *more: df.join(_bounded(crowded), "key", "left").select("node", "fp", *more, F.explode(F.when(F.col("crowded"), F.expr(f"case {' '.join(below)} end")).otherwise(F.array("key"))).alias("key"))
        hot = checkpointed(split(rows_of(wide)).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most))
        spread = split(spread, "label", "signature")
        if hot.isEmpty():
            stars = _stars(spread, join)
        else:
            few = _bounded(hot)
            stars = _hot_stars(spread.drop("label").join(few, "key"), _stars(spread.join(few, "key", "left_anti"), join), join, most)
    found = components(stars)
    named = classes.select("digest", "node").join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    return rows.select("doc_id", "exact", "digest").join(named, "digest").select("doc_id", "exact", "component")


def similar_documents(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, component_id): documents linked if they share ``similarity`` of their ``compared``-word shingles.

    ``bits`` grows with the logarithm of the number of documents, so that chance candidates stay rare.
    Texts of fewer than ``compared`` words are linked to equal ones only. component_id is the group's smallest doc_id.
    """
    rows = _similar(documents, **options)
    least = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "component").select("doc_id", "component_id")


def keep_one(documents: DataFrame, **options) -> DataFrame:
    """The document of each group of similar ones with the smallest doc_id (null last, then by hash of the text), with all columns."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "exact"))
    keep = _similar(documents, **options).groupBy("component").agg(first.alias("first")).select("first.doc_id", "first.exact")
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), _exact().alias("hash"))
    kept = rows.join(keep, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("exact")), "left_semi")
    return kept.groupBy("id", "hash").agg(F.min("row").alias("row")).select("row.*")
