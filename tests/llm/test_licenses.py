from slicer.llm import licenses
from tests.llm import cases


def brute(text, least=0.8):
    """Every window that stands over a mark, with plain sets."""
    w, found = licenses.normalised(text or ""), []
    best = lambda all: [m for m in all if not any(o[3] < m[4] and m[3] < o[4] and o < m for o in all)]
    for name, template in licenses.TEMPLATES:
        t = licenses.normalised(template)
        b = set(licenses.bigrams(t))
        starts = {i - at for g, at in licenses.marks(t, least) for i in range(len(w)) if " ".join(w[i : i + 2]) == g}
        own = []
        for s in starts:
            lo, hi = max(0, s), min(s + len(t), len(w))
            a = set(licenses.bigrams(w[lo:hi]))
            dice = 2 * len(a & b) / (len(a) + len(b))
            if dice >= least:
                own.append((-len(a & b), -dice, name, lo, hi))
        found += best(own)
    own = best(found)
    best = min(own, default=(0, 0.0, None))
    return best[2], round(-best[1], 9) + 0.0, sorted({m[2] for m in own}), len(own)


def same(spark, docs):
    got = licenses.scan(docs).collect()
    key = lambda r: (r[0] is None, r[0] or 0, str(r))
    assert sorted(((r.doc_id, r.license, round(r.dice, 9), r.licenses, r.n_matches) for r in got), key=key) == sorted(((r.doc_id, *brute(r.text)) for r in docs.collect()), key=key)
    return got


def test_against_brute_force(spark):
    texts = dict((n, t) for n, t in licenses.TEMPLATES)
    mit, gpl3, gpl2 = [t for n, t in licenses.TEMPLATES if n == "MIT"][-1], licenses._gnu("GNU General Public License"), licenses._GNU_OLD
    more = [
        ("Released under the MIT License.", ["MIT"]),
        ("x y\nLicensed under CC BY-NC 4.0.\nfoo", ["CC-BY-NC-4.0"]),
        ("The photographs are licensed under CC BY-NC 4.0. See the notes.", ["CC-BY-NC-4.0"]),
        (f"intro words\n\n{mit[:200]}\n{mit[200:]}\n\nend", ["MIT"]),
        ("all of this is released under the mit license and more words than fit here", ["MIT"]),
        (f"// {gpl2}", ["GPL-2.0"]),
        (f"# {gpl3} # more", ["GPL-3.0"]),
        (licenses._gnu("GNU Lesser General Public License"), ["LGPL-3.0"]),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
        ("This work is licensed under the GNU General Public License, version 3.\nReleased under the BSD 3-Clause License.", ["BSD-3-Clause", "GPL-3.0"]),
        (f"{licenses._BSD_CLAUSES} {licenses._BSD_THIRD} {licenses._BSD_DISCLAIMER}".replace("copyright holder", "University", 1), ["BSD-3-Clause"]),
        ("mit", []),
        ("a license under the terms of the public", []),
        ("word " * 5000 + texts["Unlicense"] + " word" * 5000 + " Released under the MIT License.", ["MIT", "Unlicense"]),
    ]
    docs = cases.documents(spark).select("doc_id", "text", "lang").union(spark.createDataFrame([(5000 + i, t, "license") for i, (t, _) in enumerate(more)], "doc_id bigint, text string, license string"))
    got = {r.doc_id: r for r in same(spark, docs) if (r.doc_id or 0) >= 5000}
    assert {i: r.licenses for i, r in got.items()} == {5000 + i: want for i, (_, want) in enumerate(more)}
    assert all(r.license is not None or not r.licenses for r in got.values())
    assert licenses.scan(cases.empty(spark)).collect() == []


def test_every_template_finds_itself_and_small_changes(spark):
    import random

    r, rows = random.Random(5), []
    for name, text in licenses.TEMPLATES:
        w = text.split()
        rows.append((name, f"before it {text} after it"))
        if len(w) > 20:
            for k in r.sample(range(len(w)), len(w) // 25):
                w[k] = "changed"
            rows.append((name, " ".join(w)))
    got = {x.doc_id: x for x in same(spark, spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id bigint, text string"))}
    assert all(name in got[i].licenses for i, (name, _) in enumerate(rows))


def test_pattern_finds_what_the_marks_say():
    import re

    p = re.compile(licenses.pattern(["a b", "a cd", "xy z", "solo"]))
    assert all(p.search(f" {t} ") for t in ("a b", "q a cd", "xy z q", "solo", "q solo q"))
    assert not any(p.search(f" {t} ") for t in ("a", "a bc", "xy", "ba b", "a c"))
