import re

import numpy as np
import pyarrow as pa

from slicer.llm import words as W
from tests.llm.cases import texts


def test_words_match_the_patterns():
    plain, alnum = re.compile(rb"[^\x20\x09-\x0D]+"), re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    given = texts()
    for first, buf, off in W.chunks(pa.array(given)):
        low = W.lower_ascii(buf)
        for data, mask, pattern in ((buf, W.is_plain(buf), plain), (low, W.is_alnum(low), alnum)):
            w = W.words(data, off, mask)
            h = w.hashes()
            for k in range(len(off) - 1):
                raw = (given[first + k] or "").encode()
                raw = raw if data is buf else raw.lower()
                got = [data[a:b].tobytes() for a, b in zip(w.start[w.first[k] : w.first[k + 1]], w.end[w.first[k] : w.first[k + 1]])]
                assert got == pattern.findall(raw)
            spelled = [data[a:b].tobytes() for a, b in zip(w.start, w.end)]
            by_hash = {}
            for s, x in zip(spelled, h.tolist()):
                assert by_hash.setdefault(x, s) == s
            assert len(by_hash) == len(set(spelled))


def test_windows_are_equal_for_equal_runs_only():
    h = np.random.default_rng(1).integers(0, 3, 400).astype(np.uint64)
    for n in (1, 2, 3, 5, 7, 10, 16, 20):
        got = W.windows(h, n)
        assert len(got) == 401 - n
        runs = {}
        for i, x in enumerate(got.tolist()):
            assert runs.setdefault(x, tuple(h[i : i + n])) == tuple(h[i : i + n])
        assert len(runs) == len({tuple(h[i : i + n]) for i in range(401 - n)})
    assert len(W.windows(h[:3], 5)) == 0
