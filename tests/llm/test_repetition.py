import numpy as np
import pyarrow as pa

from slicer.llm import repetition
from slicer.llm.words import chunks, is_plain, words
from tests.llm import cases


def brute_repeat(w):
    """Longest repeat from each position."""
    out = []
    for i in range(len(w)):
        best = 0
        for j in range(len(w)):
            k = 0
            while i != j and i + k < len(w) and j + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


def brute(text, min_repeat=8, max_covered=0.4, max_repeat=120):
    raw = (text or "").encode()
    w, n = raw.split(), len(raw.split())
    rep = brute_repeat(w)
    tri = {}
    for i in range(n - 2):
        tri.setdefault(tuple(w[i : i + 3]), []).append(i)
    hit = {i + k for v in tri.values() if len(v) > 1 for i in v for k in range(3)}
    cov = {i + k for i in range(n) if rep[i] >= min_repeat for k in range(rep[i])}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    failed = n < 50 or 100 * len(hit) > 50 * n
    kept = not failed and len(cov) <= max_covered * n and max(rep, default=0) <= max_repeat
    return (n, sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), failed, kept)


def test_longest_repeats():
    r = np.random.default_rng(2)
    texts = [" ".join(r.choice(list("abc"), n)) for n in (1, 2, 3, 5, 30, 60, 90)] + ["a " * 40, "", "x y z x y z x y"]
    for _, buf, off in chunks(pa.array(texts)):
        w = words(buf, off, is_plain(buf))
        text = w.text_of()
        last = w.first[1:][text]
        got = repetition.longest_repeats(repetition.rank_levels(w.hashes(), text, last), text, last)
        assert got.tolist() == [x for t in texts for x in brute_repeat(t.split())]


def test_against_brute_force(spark):
    r = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(400)]
    more = [" ".join(r.choice(vocabulary, n)) for n in (49, 50, 80, 200)]
    more += [more[3] + "\n" + " ".join(more[3].split()[:40]) + "\n# * $ <b>", "\n".join([more[1]] * 3), " ".join(more[3].split()[:130] * 2 + [f"z{i}" for i in range(300)])]
    docs = cases.documents(spark).limit(90).unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id bigint, text string"), allowMissingColumns=True)
    rows = docs.collect()
    got = repetition.quality(docs).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(((g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed, g.kept) for g in got), key=key) == sorted(((x.doc_id, *brute(x.text)) for x in rows), key=key)
    assert repetition.quality(cases.empty(spark)).collect() == []
