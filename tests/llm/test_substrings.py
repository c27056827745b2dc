import random

from slicer.llm import substrings
from tests.llm import cases


def brute(rows, window):
    """rows: (doc_id, text), distinct doc ids."""
    firsts, words = {}, {d: (t or "").encode().split() for d, t in rows}
    for d in sorted(words):
        w = words[d]
        for i in range(len(w) - window + 1):
            firsts.setdefault(tuple(w[i : i + window]), (d, i))
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if firsts[tuple(w[i : i + window])] < (d, i):
                gone.update(range(i, i + window))
        out[d] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    return out


def rows():
    r = random.Random(5)
    t = [x for x in cases.texts()]
    line = " ".join(f"common{i}" for i in range(30))
    t += [" ".join(f"u{r.randrange(10**6)}" for _ in range(r.randrange(40))) + "\n" + line + "\t" + " ".join(f"v{r.randrange(10**6)}" for _ in range(r.randrange(40))) for _ in range(40)]
    t += ["ab " * 70, "b a " * 35, " ".join(f"common{i}" for i in range(25))]
    ids = list(range(len(t)))
    r.shuffle(ids)
    return list(zip(ids, t))


def test_against_brute_force(spark):
    given = rows()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in given], "doc_id bigint, text string, spans string, tag int").repartition(5)
    for window in (20, 6):
        want = brute(given, window)
        for crowd in (5000, 3):
            got = substrings.removed(df, window=window, crowd=crowd).collect()
            assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == want


def test_awkward_rows(spark):
    docs = cases.documents(spark)
    got = substrings.removed(docs).collect()
    assert len(got) == docs.count()
    a = substrings.removed(spark.createDataFrame([(1, "w " * 30), (1, "w " * 30), (None, "q " * 30), (None, "q " * 30), (None, "z")], "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id is None, r.n_words, r.n_removed) for r in a) == [(False, 30, 29), (False, 30, 29), (True, 1, 0), (True, 30, 29), (True, 30, 29)]
    done = substrings.deduplicated(docs)
    assert done.columns == docs.columns and done.dtypes == docs.dtypes and done.count() == docs.count()
    by = {(r.doc_id, r.text) for r in done.collect()}
    want = {r.doc_id: r for r in got}
    for r in docs.collect():
        if r.doc_id is not None and r.doc_id != 7 and want[r.doc_id].n_removed:
            assert (r.doc_id, want[r.doc_id].kept) in by
    assert substrings.removed(cases.empty(spark)).collect() == []
