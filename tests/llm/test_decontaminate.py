import hashlib
import re

from slicer.llm import decontaminate
from tests.llm import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, found = set(), set()
        for s in range(len(w)):
            for n in range(1, 11):
                if s + n <= len(w) and tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])] - {None}
        out.append((d is None, d or 0, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_against_brute_force(spark):
    docs = cases.documents(spark)
    t = [x for x in cases.texts() if x]
    items = [(1, t[0] + " zz"), (2, " ".join(t[3].split()[:12])), (30, "word WORD"), (4, "中文"), (5, None), (6, "... ---"), (None, t[7]), (8, t[10][:200]), (8, t[11][:90]), (9, "never to be found in any of these documents at all")]
    bench = spark.createDataFrame([(i, x, "extra") for i, x in items], "item_id bigint, text string, doc_id string")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(None if i is None else str(i), x) for i, x in items])
    for block in (200_000, 40):
        got = decontaminate.decontaminate(docs, bench, block_words=block).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    bad = {(w[0], w[1]) for w in want if w[-1]}
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((w[0], w[1]) for w in want if (w[0], w[1]) not in bad)
    assert decontaminate.decontaminate(cases.empty(spark), bench).collect() == []
    none = decontaminate.decontaminate(docs, bench.limit(0)).collect()
    assert len(none) == len(want) and not any(r.contaminated for r in none)
