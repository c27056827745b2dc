import numpy as np
import xxhash

from slicer.llm import simhash
from slicer.llm.graph import components
from tests.llm import cases


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    ids = {d: brute_fingerprint(t) for d, t in rows if d is not None}
    comp = {d: d for d in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (ids[a] ^ ids[b]).bit_count() <= 2 and comp[b] < comp[a]:
                    comp[a], changed = comp[b], True
    return comp


def test_whole_operator(spark):
    docs = cases.documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    first = {}
    for d, t in rows:
        if d == 7:
            continue
        first[d] = t
    comp = brute_components([*rows])
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = sorted(((d is None, d or 0), brute_fingerprint(t)) for d, t in rows)
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.fp % 2**64) for r in got) == want
    for r in got:
        if r.doc_id not in (None,):
            assert r.component_id == comp[r.doc_id] or r.doc_id == 7
    assert simhash.near_duplicates(cases.empty(spark)).collect() == []


def brute_roots(v, distance):
    root = list(range(len(v)))
    for _ in v:
        for i in range(len(v)):
            for j in range(len(v)):
                if (int(v[i]) ^ int(v[j])).bit_count() <= distance:
                    root[i] = root[j] = min(root[i], root[j])
    return root


def test_trie_join_and_splitting(spark):
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 12, dtype=np.uint64)
    v = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << r.integers(0, 64, 12).astype(np.uint64)) for _ in range(12)]))
    for leaf in (1, 3, 64):
        assert simhash.trie_join(v, 2, leaf).tolist() == brute_roots(v, 2)
    classes = spark.createDataFrame([(i, int(x.astype(np.int64))) for i, x in enumerate(v)], "node bigint, fp bigint")
    for most in (20_000, 2):  # with 2, almost all subtries are split again
        got = {c.node: c.component for c in components(simhash.links(classes, 2, most)).collect()}
        assert [got.get(i, i) for i in range(len(v))] == brute_roots(v, 2)


def jaccard(a, b):
    def of(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    x, y = of(a), of(b)
    return len(x & y) / max(1, len(x | y))


def test_similar_documents(spark):
    import random

    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = [[r.choice(vocabulary) for _ in range(r.randrange(80, 400))] for _ in range(60)]
    texts = [" ".join(w) for w in base]
    for w in base:
        for changes in (1, 3, 40):
            v = list(w)
            for _ in range(changes):
                v[r.randrange(len(v))] = r.choice(vocabulary)
            texts.append(" ".join(v))
    texts += [texts[0], texts[0].upper(), None, "", "a b", "A  b", "a c"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[1], "x"), (3, texts[3], "x")], "doc_id bigint, text string, digest string")
    for most in (20_000, 5):
        comp = {x.doc_id: x.component_id for x in simhash.similar_documents(docs, most=most).collect() if x.doc_id is not None}
        n = len(base)
        for i in range(n):
            for k in range(3):
                j = jaccard(texts[i], texts[n + 3 * i + k])
                if j >= 0.88:
                    assert comp[n + 3 * i + k] == comp[i]
                elif j < 0.6:
                    assert comp[n + 3 * i + k] != comp[i]
        assert len({comp[i] for i in range(n)}) == n
        m = len(texts)
        assert comp[m - 7] == comp[m - 6] == comp[0] and comp[m - 5] == comp[m - 4] == m - 5 and comp[m - 2] == comp[m - 3] == m - 3 and comp[m - 1] == m - 1
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted({c for c in comp.values()})
    assert simhash.similar_documents(docs.limit(0)).collect() == []


def test_hot_keys(spark):
    """A group of texts of one fingerprint, far larger than ``most``, and strangers beside it under the same keys."""
    import random

    r = random.Random(4)
    rows, want = [], {}
    for group, size in enumerate((120, 3, 2, 1, 1)):
        code = bytes(r.randrange(1, 256) for _ in range(simhash.BINS))
        for _ in range(size):
            v = bytearray(code)
            for k in r.sample(range(simhash.BINS), 4):
                v[k] = r.randrange(1, 256)
            want[len(rows)] = group
            rows.append((r.randrange(2), 0, len(rows), bytes(v)))
    hot = spark.createDataFrame([(k, len(rows), f, n, c) for k in (0, 1) for _, f, n, c in rows], "key bigint, n bigint, fp bigint, node bigint, signature binary")
    none = spark.createDataFrame([], "a bigint, b bigint")
    stars = simhash._hot_stars(hot, none, simhash._similar_subtries(2, 0.78, 32), 10)
    comp = {c.node: c.component for c in components(stars).collect()}
    for i in want:
        for j in want:
            assert (comp.get(i, i) == comp.get(j, j)) == (want[i] == want[j])


def test_near_copies_of_one_text_in_small_parts(spark):
    import random

    r = random.Random(5)
    base = [f"w{r.randrange(900)}" for _ in range(400)]
    texts = [" ".join([*base[:k], "x" + str(k), *base[k + 1 :]]) for k in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "quite another text of some words that stands alone"])], "doc_id bigint, text string")
    comp = {x.doc_id: x.component_id for x in simhash.similar_documents(docs, most=7).collect()}
    assert set(comp.values()) == {0, 60} and [i for i, c in comp.items() if c] == [60]
