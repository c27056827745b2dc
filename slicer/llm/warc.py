"""WARC archives: one gzip member a record, read back by boundary-chain verification.

Writing. Payloads of equal SHA-1 and size are one group, found by a maximum that combines
before the shuffle; the largest page_id's record is the response, the others revisit it.
Records are compressed one by one and written by Spark's text writer, which copies bytes as they
are. Its line separator is one zero byte: the last byte of a member, the top byte of its size, which
is zero below 16 MB (a larger record is followed by an empty member). Each part file is thus a plain ``.warc.gz``.

Reading. Spark cuts the files into splits, whatever their size, and into lines at each place of the gzip mark,
three bytes that also stand inside compressed payloads. Tasks try to open a member at each
place and emit (offset, successor). Only those reachable from the file's start are true. Within a split
pointer jumping gives each candidate's exit, across splits it doubles in DataFrame rounds, so the
number of rounds is the logarithm of the number of splits in a file. A member that a false mark and the end of its split
cut in two cannot be opened there; files with such a member are read again, unsplit, as a stream of lines.

Sizes and digests are computed from the payloads read. A revisit has those of the response that it refers to.
``faults`` lists what is wrong: chains that end before their file does, records whose header and
payload disagree, revisits without their response. ``read`` raises ``Damaged`` on any, unless ``strict`` is false: then
it returns the reachable records, with ``sound`` false where they disagree.

Defined results: a null html is an empty payload; a null url has no header line; a null
page_id never becomes a response while its group has another id; repeated rows that tie
for the largest page_id are each a response; payloads of any length are one record; an empty table writes and reads nothing;
further columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicer.llm.session import bound_batches, session_settings, shared_dir, written

MAGIC = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: How a gzip member begins, and ends if it holds less than 16 MB.
MARK = b"\x1f\x8b\x08"
CLOSE = b"\x00"
SEGMENT = 16 << 20
FIELDS = "payload_bytes bigint, payload_digest string, record_type string, page_id bigint, refers_to bigint, url string, sound boolean"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


class Damaged(ValueError):
    """Archives whose records are not all there and whole."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = batch["html"].cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], batch["html"], pa.array([digest(x) for x in payloads], pa.string()), pa.array([len(x) for x in payloads], pa.int64())], ["page_id", "url", "html", "digest", "size"])


def _line(url: str | None) -> str:
    return re.sub(r"[\r\n]", " ", url) if url is not None else ""


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None) -> bytes:
    """A record with its end."""
    revisit = refers_to is not None
    block = HTTP if revisit else HTTP + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}')}>",
        "WARC-Date": "2000-01-01T00:00:00Z",
        "WARC-Target-URI": None if url is None else _line(url),
        "WARC-Payload-Digest": f"sha1:{sha}",
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "X-Page-Id": None if page_id is None else str(page_id),
        "X-Refers-To-Page-Id": None if refers_to is None else str(refers_to),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    return MAGIC + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None).encode() + b"\r\n" + block + END


def member(data: bytes, large: int = 1 << 24) -> bytes:
    """``data`` as a gzip member that ends with ``CLOSE``."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = c.compress(data) + c.flush()
    return out if len(data) < large else out + member(b"")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = [batch[c].to_pylist() for c in ("page_id", "url", "digest", "refers_to")]
        made = [member(record(p, u, h, d, r))[:-1] for p, u, d, r, h in zip(*cols, batch["html"].cast(pa.binary()).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["value"])


def write(pages: DataFrame, path: str, *, min_bytes: int = 0, records_per_file: int = 20_000) -> None:
    """Archive ``pages`` (page_id, url, html) as WARC files under ``path``."""
    bound_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).mapInArrow(_digests, "page_id bigint, url string, html string, digest string, size bigint")
    # a table of its own, so that adaptive execution can split a common payload's rows in the join
    heads = written(rows.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("head")))
    marked = rows.join(heads, ["digest", "size"], "left").withColumn("refers_to", F.when(~F.col("head").eqNullSafe(F.col("page_id")), F.col("head")))
    out = marked.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(_records, "value binary")
    # a cast copies the bytes; nothing looks at them as characters
    out.select(F.col("value").cast("string").alias("value")).write.option("lineSep", CLOSE.decode()).option("maxRecordsPerFile", records_per_file).text(path)


# --- reading ----------------------------------------------------------------------


def parse(data: bytes) -> tuple | None:
    """The fields of the record that a member holds."""
    head_end = data.find(b"\r\n\r\n")
    if not data.startswith(MAGIC) or head_end < 0:
        return None
    head = {}
    for line in data[len(MAGIC) : head_end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        head[name.decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    number = lambda key: int(v) if (v := head.get(key, "")).removeprefix("-").isdecimal() else None
    body, kind, sha = data[head_end + 4 : -len(END)], head.get("warc-type", ""), head.get("warc-payload-digest", "").removeprefix("sha1:")
    whole = data.endswith(END) and number("content-length") == len(body) and b"\r\n\r\n" in body
    if kind == "revisit":  # only the response has the payload
        return None, sha, kind, number("x-page-id"), number("x-refers-to-page-id"), head.get("warc-target-uri"), whole
    payload = body[body.find(b"\r\n\r\n") + 4 :]
    found = digest(payload)
    return len(payload), found, kind, number("x-page-id"), number("x-refers-to-page-id"), head.get("warc-target-uri"), whole and found == sha


def opened(pieces: list[bytes], i: int, last: bool) -> tuple[int, bytes] | None | str:
    """(pieces, data) of the member that begins with piece ``i``; None if none does, "open" if it may go on after the pieces."""
    z, parts = zlib.decompressobj(31), []
    for j in range(i, len(pieces)):
        try:
            parts.append(z.decompress(MARK + pieces[j]))
        except zlib.error:
            return None
        if z.eof:
            return None if z.unused_data else (j - i + 1, b"".join(parts))
    return None if last else "open"


def exits(offset: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Where the chain from each candidate leaves the candidates, by pointer jumping."""
    to = successor.copy()
    while len(offset):
        k = np.minimum(np.searchsorted(offset, to), len(offset) - 1)
        inner = offset[k] == to
        if not inner.any():
            break
        to = np.where(inner, to[k], to)
    return to


CANDIDATES = f"file string, split bigint, at bigint, after bigint, leaves bigint, bytes bigint, open boolean, {FIELDS}"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of each split, with offsets from its first mark; the split's own row (at -1) has its bytes and whether a member stays open."""
    columns = [f.split() for f in CANDIDATES.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
    # pieces that wait for a later one to close their member: only the last few are held
    state: dict = {"key": None}

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(columns)], [n for n, _ in columns])

    def settle(final: bool) -> None:
        """Candidates of the pieces in hand; all but those that may still go on are let go."""
        pieces, at, i = state["pieces"], state["base"], 0
        while i < len(pieces):
            found = opened(pieces, i, False)
            if found == "open" and not final:
                break
            if found == "open":
                state["open"] = True
            elif found is not None:
                n, data = found
                size = sum(map(len, pieces[i : i + n])) + n * len(MARK)
                fields = parse(data) if data else (None, None, "", None, None, None, True)
                state["rows"].append((at, at + size, *(fields or (None, None, None, None, None, None, False))))
            at += len(pieces[i]) + len(MARK)
            i += 1
        state["base"], state["pieces"] = at, pieces[i:]

    def done() -> pa.RecordBatch:
        settle(True)
        file, split = state["key"]
        rows = state["rows"]
        out = exits(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)).tolist()
        made = [(file, split, r[0], r[1], x, None, None, *r[2:]) for r, x in zip(rows, out, strict=True)]
        return flush([(file, split, -1, state["lead"], None, state["base"], state["open"], *[None] * len(NAMES)), *made])

    for batch in batches:
        for file, split, value in zip(batch["file"].to_pylist(), batch["split"].to_pylist(), batch["value"].to_pylist(), strict=True):
            if state["key"] != (file, split):
                if state["key"] is not None:
                    yield done()
                # what stands before a file's first mark belongs to no record
                state = {"key": (file, split), "pieces": [], "base": 0, "rows": [], "open": False, "lead": len(value) if split == 0 else 0}
                if split == 0:
                    continue
            state["pieces"].append(value)
            if len(state["pieces"]) > 1:
                settle(False)
    if state["key"] is not None:
        yield done()


def candidates(spark: SparkSession, paths: str | list[str], segment: int) -> DataFrame:
    """``CANDIDATES`` of all files, from splits of ``segment`` bytes."""
    with session_settings(spark, {"spark.sql.files.maxPartitionBytes": str(segment), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}):
        lines = spark.read.option("lineSep", MARK.decode("latin-1")).option("encoding", "ISO-8859-1").text(paths)
        pieces = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))
        return written(pieces.mapInArrow(_candidates, CANDIDATES))


def placed(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates with offsets from the file's start, and splits (file, split, start, bytes, size of the file, lead, open)."""
    splits = found.where("at = -1").select("file", "split", F.col("after").alias("lead"), "bytes", "open")
    # a file has few splits, so its sums are one task's
    splits = splits.selectExpr("*", "sum(bytes) OVER (PARTITION BY file ORDER BY split) - bytes AS start", "sum(bytes) OVER (PARTITION BY file) AS file_bytes")
    splits = written(splits)
    rows = found.where("at >= 0").drop("bytes", "open").join(splits.select("file", "split", "start"), ["file", "split"])
    for c in ("at", "after", "leaves"):
        rows = rows.withColumn(c, F.col(c) + F.col("start"))
    return written(rows), splits


def reachable_entries(found: DataFrame) -> DataFrame:
    """(file, at): the candidates at which the chain from each file's start enters a split."""
    jump = found.select("file", "at", F.col("leaves").alias("to"))
    reached = written(found.where("at = 0").select("file", "at"))
    n = -1
    while (grown := reached.count()) != n:  # the reach doubles, so this ends after the logarithm of a file's splits
        n = grown
        further = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at")).join(found.select("file", "at"), ["file", "at"], "left_semi")
        reached = written(reached.unionByName(further).distinct())
        ahead = jump.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
        jump = written(jump.join(ahead, ["file", "to"], "left").select("file", "at", F.coalesce("beyond", "to").alias("to")))
    return reached


def _follow(group: pa.Table) -> pa.Table:
    """The rows of one split that its entry's chain goes through."""
    at, after, entry = (group[c].to_pylist() for c in ("at", "after", "entry"))
    place, keep = {a: i for i, a in enumerate(at)}, []
    here = next((e for e in entry if e is not None), None)
    while here in place:
        keep.append(place[here])
        here = after[place[here]]
    return group.take(keep).select(NAMES)


def chained(spark: SparkSession, path: str, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """The records on the chains from the files' starts, and (file, reached, file_bytes, lead) of every file whose chain ends early."""
    bound_batches(spark)
    found = candidates(spark, path, segment)
    cut = found.where("open").select("file").distinct()
    cut_files = [r.file for r in cut.collect()]  # names of files with a member cut at a false mark: a chance of 2 ** -24 a byte
    if cut_files:
        found = written(found.join(cut, "file", "left_anti").unionByName(candidates(spark, cut_files, 1 << 62)))
    rows, splits = placed(found)
    entries = reachable_entries(rows)
    ends = rows.join(entries, ["file", "at"], "left_semi").groupBy("file").agg(F.max("leaves").alias("reached"))
    files = splits.groupBy("file").agg(F.max("file_bytes").alias("file_bytes"), F.max("lead").alias("lead"))
    broken = files.join(ends, "file", "left").where("lead > 0 or coalesce(reached, 0) <> file_bytes")
    heads = entries.join(rows.select("file", "at", "split"), ["file", "at"]).select("file", "split", F.col("at").alias("entry"))
    on_chain = rows.join(heads, ["file", "split"]).select("file", "split", "at", "after", "entry", *NAMES).groupBy("file", "split").applyInArrow(_follow, FIELDS)
    return written(on_chain.where("record_type is null or record_type <> ''")), broken  # '': the empty member after a large record


def read(spark: SparkSession, path: str, *, segment: int = SEGMENT, strict: bool = True) -> DataFrame:
    """Every true record under ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to, url, sound."""
    records, broken = chained(spark, path, segment)
    responses = records.where("record_type = 'response' and sound").groupBy(F.col("payload_digest").alias("sha"), F.col("page_id").alias("of")).agg(F.max("payload_bytes").alias("full"))
    joined = written(records.join(responses, (F.col("payload_digest") == F.col("sha")) & (F.col("refers_to") == F.col("of")), "left"))
    out = joined.select(F.coalesce("payload_bytes", "full").alias("payload_bytes"), "payload_digest", "record_type", "page_id", "refers_to", "url", (F.col("sound") & ((F.col("record_type") == "response") | F.col("full").isNotNull())).alias("sound"))
    if strict:
        early, unsound = broken.limit(5).collect(), out.where("not sound or record_type is null").limit(5).collect()
        if early or unsound:
            raise Damaged(f"{path}: chains that end early {[(r.file, r.reached, r.file_bytes) for r in early]}, unsound records {[(r.page_id, r.payload_digest) for r in unsound]}")
    return out


def round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``pages`` and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, url, sound."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, **options)
    return read(spark, path)
