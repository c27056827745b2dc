import zlib

import numpy as np
import pytest

from slicer.llm import packing
from tests.llm import cases

tokenizers = pytest.importorskip("public_tokenizers")


def test_round_trip(spark):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    docs = cases.documents(spark).union(cases.documents(spark, 1))
    rows = packing.packed(docs, path, bucket_rows=40).collect()
    want = sorted((r.doc_id is None, r.doc_id or 0, len(i := whole.encode(r.text or "", add_special_tokens=False).ids + [1]), a, zlib.crc32(np.array(i[a : a + 2048], "<u4").tobytes())) for r in docs.collect() for a in range(0, len(whole.encode(r.text or "", add_special_tokens=False).ids) + 1, 2048))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.doc_tokens, r.start, r.ids_crc32) for r in rows) == want
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(seqs) <= total / 2048 * 1.1 + 3
    assert packing.packed(cases.empty(spark), path).collect() == []


def test_plan_covers_demand_with_little_waste():
    r = np.random.default_rng(0)
    demand = r.integers(0, 300, 64)
    got = packing.plan(demand)
    assert (sum(p * t for p, t in got) == demand).all()
    assert all((p * np.arange(1, 65)).sum() <= 64 for p, _ in got)
    bound = packing.column_generation(demand.astype(float))[1].sum()  # no packing without cuts uses fewer
    assert bound - 1e-6 <= sum(t for _, t in got) <= bound + 5


def test_best_pattern_is_optimal():
    value = np.array([0.1, 0.25, 0.3, 0.56, 0.0, 0.9])
    best, pattern = packing.best_pattern(value, 6)
    from itertools import product

    brute = max(sum(v * n for v, n in zip(value, c)) for c in product(range(7), repeat=6) if sum(n * (i + 1) for i, n in enumerate(c)) <= 6)
    assert abs(best - brute) < 1e-9 and abs((pattern * value).sum() - brute) < 1e-9
