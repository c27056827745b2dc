import base64
import gzip
import hashlib
from pathlib import Path

import pytest

from slicer.llm import warc


def pages(spark):
    fake = warc.record(99, "http://x/", b"inner", warc.digest(b"inner"), None).decode()
    rows = [(i, f"http://h{i % 3}.example.com/{i}", f"<p>page {i % 7}</p>") for i in range(40)]
    rows += [(100, "u", None), (101, None, ""), (102, "u\r\nv", "<html>" + fake * 3 + "</html>"), (103, "u", fake), (104, "u", "WARC/1.1\r\nWARC/1.1\r\n\r\n\r\n"), (105, "u", "é" * 50_000), (106, "u", fake), (None, "u", "no id"), (None, "u", "<p>page 1</p>"), (39, "again", "<p>page 4</p>"), (107, "u", "\r\n\r\n")]
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, size int"), rows


def brute(rows):
    heads = {}
    for p, _, h in rows:
        if p is not None:
            heads[h or ""] = max(heads.get(h or "", p), p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        head = heads.get(h or "")
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if head == p else "revisit", None if head == p else head))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r))


def rows_of(got):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=lambda r: (r[0] is None, r[0] or 0, r))


def parts(where):
    return sorted(p for p in Path(where).iterdir() if p.name.startswith("part-"))


def test_round_trip(spark, tmp_path):
    df, rows = pages(spark)
    where = str(tmp_path / "w")
    warc.write(df, where, records_per_file=17)
    for p in parts(where):  # plain gzip members of whole records
        data = gzip.decompress(p.read_bytes()) if p.stat().st_size else b""
        assert not data or data.startswith(warc.MAGIC) and data.endswith(warc.END)
    for segment in (16 << 20, 700):
        got = warc.read(spark, where, segment=segment).collect()
        assert rows_of(got) == brute(rows)
        assert all(r.sound for r in got)
    empty = warc.round_trip(df.limit(0), str(tmp_path / "none")).collect()
    assert empty == []


def archive(path, members):
    path.mkdir()
    (path / "part-0.txt").write_bytes(b"".join(members))
    return str(path)


def test_marks_inside_members(spark, tmp_path):
    """Stored members show the payload's bytes, marks and whole members among them, at every split."""
    import zlib

    def stored(data):
        c = zlib.compressobj(0, zlib.DEFLATED, 31)
        return c.compress(data) + c.flush()

    rec = lambda i, payload: warc.record(i, f"u{i}", payload, warc.digest(payload), None)
    inner = stored(rec(99, b"inner"))
    payloads = [b"plain", b"x" + inner * 3 + b"y" * 300, warc.MARK * 50, inner, b"", b"z" * 2000 + warc.MARK + b"z" * 900]
    where = archive(tmp_path / "a", [stored(rec(i, p)) for i, p in enumerate(payloads)])
    for segment in (1 << 20, 400, 97):
        got = {r.page_id: r for r in warc.read(spark, where, segment=segment).collect()}
        assert {i: r.payload_digest for i, r in got.items()} == {i: warc.digest(p) for i, p in enumerate(payloads)}
        assert all(got[i].payload_bytes == len(p) for i, p in enumerate(payloads))


def test_damage_is_reported(spark, tmp_path):
    rec = lambda i, payload, of=None: warc.record(i, f"u{i}", payload, warc.digest(payload), of)
    good = [warc.member(rec(i, b"payload %d" % i)) for i in range(6)]
    tampered = warc.member(rec(1, b"payload 1").replace(b"payload 1", b"Payload 1"))
    got = {r.page_id: r for r in warc.read(spark, archive(tmp_path / "t", [good[0], tampered, *good[2:]]), strict=False).collect()}
    assert got[1].payload_digest == warc.digest(b"Payload 1") and not got[1].sound and all(got[i].sound for i in (0, 2, 3, 4, 5))
    shorter = warc.member(rec(1, b"payload 1").replace(b"payload 1", b"payload"))
    lone = warc.member(rec(7, b"payload 9", 9))
    cases = {"tampered": [good[0], tampered], "shorter": [good[0], shorter], "boundary": [good[0], good[1][:-9] + good[2], *good[3:]], "lead": [b"??", *good], "tail": [*good, b"junk"], "cut": [*good, good[0][:-20]], "no response": [*good, lone], "no record": [warc.member(b"hello"), *good]}
    for name, members in cases.items():
        with pytest.raises(warc.Damaged):
            warc.read(spark, archive(tmp_path / name.replace(" ", "-"), members))
    assert warc.member(b"a" * 100, large=50)[-1:] == warc.CLOSE
    large = archive(tmp_path / "large", [warc.member(rec(0, b"p" * 500), large=100), good[1]])
    assert sorted(r.page_id for r in warc.read(spark, large).collect()) == [0, 1]
