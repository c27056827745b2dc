import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from slicer.llm import toxicity
from tests.llm.test_decontaminate import brute as brute_leaks
from tests.llm.test_simhash import jaccard
from tests.llm.test_substrings import brute as brute_repeats

RUDE = ["gruk", "blarg", "snotz"]


def documents(n=260, seed=11):
    r = random.Random(seed)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    passage = " ".join(f"shared{i}" for i in range(60))
    for i in range(n):
        w = [r.choice(plain) for _ in range(r.randrange(30, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(RUDE))
        text = " ".join(w)
        if i % 7 == 3:
            text += "\n" + passage
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(n + i, rows[i * 5][1], "en", "copy", rows[i * 5][4]) for i in range(12)]
    rows += [(n + 20, None, None, None, None), (n + 21, "", "en", "s", 0), (n + 22, " ".join(rows[1][1].split()[:20] + rows[2][1].split()[:25]), "en", "leak", 1)]
    return rows, labels, [(1, " ".join(rows[6][1].split()[5:30])), (2, "never seen words in this text at all here and there")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    rows, labels, bench = documents()
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def test_stages_against_brute_force(spark, folder):
    docs, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            assert set(before) - set(after) == {i for i, t in before.items() if set((t or "").split()) & set(RUDE)}
        elif name == "simhash":
            words = {d: (t or "").lower().split() for d, t in before.items()}
            ids = sorted(before)
            gone = {b for i, a in enumerate(ids) for b in ids[i + 1 :] if words[a] == words[b] or jaccard(before[a] or "", before[b] or "") >= 0.8}
            assert gone and set(after) == set(before) - gone
        elif name == "substring_dedup":
            assert after == {d: k if gone else before[d] for d, (_, gone, k) in brute_repeats(list(before.items()), 20).items()}
        else:
            bad = {b[1] for b in brute_leaks(list(before.items()), [(str(r.item_id), r.text) for r in bench]) if b[-1]}
            assert bad and set(after) == set(before) - bad
        if name != "substring_dedup":
            assert all(after[d] == before[d] for d in after)
    kept = set(after)
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == kept and sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())


def test_toxicity_operator(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.toxicity(docs, labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(got) == docs.count()
    assert all(r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert len(none) == len(got) and all(r.predicted == 0 for r in none)
    odd = docs.selectExpr("cast(null as bigint) doc_id", "text", "1 as score").limit(3)
    assert [r.held_out for r in toxicity.toxicity(odd, labels.selectExpr("doc_id", "toxic", "'x' text")).collect()] == [False] * 3
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


def brute_segments(s):
    """The definition: the best segment, then those left and right of it."""

    def best(a, b):
        top = max(((sum(s[i:j]), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if top is None or top[0] <= 0:
            return []
        _, i, j = top
        return best(a, i) + [(i, j)] + best(j, b)

    return best(0, len(s))


def test_maximal_segments_and_evidence_against_brute_force():
    import math

    r = random.Random(1)
    for _ in range(400):
        s = [r.choice([-1.0, -1.0, r.uniform(-3, 0), r.uniform(0, 4)]) for _ in range(r.randrange(1, 14))]  # no ties but of the background
        at = [i for i, v in enumerate(s) if v != -1]
        found = toxicity.maximal_segments(at, [s[i] for i in at], -1.0)
        want = brute_segments(s)
        assert [(a, b) for a, b, _ in found] == want
        assert all(abs(v - sum(s[a:b])) < 1e-9 for a, b, v in found)
        model = toxicity.Model(background=-1.0, scale=0.7, chance=0.02)
        total, strong = toxicity.passages(len(s), at, [s[i] for i in at], model)
        worth = [0.7 * sum(s[a:b]) - math.log(0.02 * len(s)) for a, b in want]
        assert abs(total - sum(w for w in worth if w > -math.log(toxicity.LEVEL))) < 1e-9
        assert [x[:2] for x in strong] == [x for x, w in zip(want, worth) if w > -math.log(toxicity.LEVEL)]


def test_lambda_and_background_are_solved():
    import math

    model = toxicity.Model(words={"bad": 2.0, "good": -1.5})
    clean = [(10, [0], [-1.5]), (10, [1], [2.0]), (80, [], [])] * 10
    toxicity._calibrate(model, clean, [(20, [0, 1, 2], [2.0, 2.0, 2.0])] * 10)
    assert abs(model.background - math.log((17 / 20) / (98 / 100))) < 1e-9
    mean = (10 * math.exp(model.scale * 2) + 10 * math.exp(model.scale * -1.5) + 980 * math.exp(model.scale * model.background)) / 1000
    assert abs(mean - 1) < 1e-6


def test_fit_is_the_same_for_any_partitioning_and_odd_rows(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    models = [toxicity.fit(docs.repartition(n), labels.repartition(n)) for n in (1, 5)]
    assert models[0] == models[1] and any(v < 0 for v in models[0].words.values()) is not None
    long = " ".join(["w1 w2 w3"] * 20_000)
    rows = [(1, long), (1, long), (2, None), (3, ""), (4, f"{long} gruk blarg snotz gruk blarg {long}"), (None, "gruk blarg snotz gruk")]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id bigint, text string"), models[0]).collect()
    of = lambda i: [x for x in got if x.doc_id == i]
    assert len(of(1)) == 2 and of(1)[0].score == of(1)[1].score and of(1)[0].predicted == 0
    assert of(2)[0].score == of(3)[0].score < 0.5 and of(2)[0].passages == []
    assert of(4)[0].predicted == 1 and [(p.start, p.end) for p in of(4)[0].passages] == [(60_000, 60_005)]
    assert of(None)[0].predicted == 1 and of(None)[0].held_out is False


def test_long_clean_texts_are_not_toxic(spark):
    """Chance words add up with length: joined clean texts stay clean, and one toxic passage in them is found."""
    r = random.Random(4)
    odd = [f"odd{chr(97 + i)}x" for i in range(12)]  # somewhat likelier in toxic texts
    plain = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 4 == 0
        w = [r.choice(plain) for _ in range(r.randrange(100, 300))]
        for _ in range((r.random() < (0.5 if toxic else 0.1)) * 1 + toxic * (r.random() < 0.3)):
            w.insert(r.randrange(len(w)), r.choice(odd))
        if toxic:
            at = r.randrange(len(w))
            w[at:at] = [r.choice(RUDE) for _ in range(4)]
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    clean = [t for (_, t), (_, y) in zip(rows, labels) if not y]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert {"gruk", "blarg", "snotz"} <= set(model.words) and set(odd) & set(model.words)
    scores = toxicity.Scores(model)
    predicted = lambda t: model.offset + model.slope * toxicity.evidence(t, scores)[0] >= 0
    assert not any(predicted(t) for t in clean)
    for n in (10_000, 30_000, 100_000):
        words = []
        while len(words) < n:
            words += r.choice(clean).split()
        assert not predicted(" ".join(words))
        whole = " ".join(words[: n // 2] + [*RUDE, *RUDE] + words[n // 2 :])
        assert predicted(whole)
        length, at, values = toxicity.hits(whole, scores)
        assert sum(values) + model.background * (length - len(at)) < 0  # without the search for segments it would be lost


def test_near_copies_with_null_and_clashing_ids(spark):
    r = random.Random(6)
    text = lambda: " ".join(r.choice("abcdefgh") + str(r.randrange(500)) for _ in range(120))
    a, b, c, d, e, f = (text() for _ in range(6))
    near = lambda t: t + " one more"
    rows = [(None, a), (1, b), (1, c), (1, b), (None, near(b)), (2, near(c)), (None, d), (None, near(d)), (3, e), (None, e), (4, "short"), (None, "lone"), (5, near(f)), (5, f)]
    docs = spark.createDataFrame([(*x, f"s{i}") for i, x in enumerate(rows)], "doc_id bigint, text string, source string")
    got = [{(x.doc_id, x.text, x.source) for x in corpus_pipeline.drop_near_copies(spark, docs.repartition(n), "").collect()} for n in (1, 3)]
    assert got[0] == got[1]
    pairs = sorted(((i, t) for i, t, _ in got[0]), key=str)
    one_d, one_f = [t for i, t in pairs if t in (d, near(d))], [t for i, t in pairs if t in (f, near(f))]
    assert len(one_d) == len(one_f) == 1
    assert pairs == sorted([(None, a), (1, b), (1, c), (None, one_d[0]), (3, e), (4, "short"), (None, "lone"), (5, one_f[0])], key=str)


def test_stages_with_odd_rows_and_columns(spark, folder):
    """Null and repeated ids, null texts, columns whose names clash or need quotes: columns stay, clean rows stay, rows are whole."""
    from pyspark.sql import functions as F

    r = random.Random(5)
    text = lambda n: " ".join(f"w{r.randrange(300)}" for _ in range(n))
    rows = [(None, text(40)), (None, text(40)), (2, text(40)), (2, text(41)), (3, None), (None, None), (4, ""), (5, text(45)), (6, "three words only"), (7, text(3000))]
    docs = spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    names = ["row", "kept", "spans", "component", "doc", "tag", "label", "node", "id", "hash", "contaminated", "a b", "x.y", "q`q"]
    for i, n in enumerate(names):
        docs = docs.withColumn(n, F.lit(i))
    docs = docs.withColumn("pair", F.struct(F.lit(1).alias("s t"))).withColumn("list", F.array(F.lit("x")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns
        docs = spark.createDataFrame(after.collect(), docs.schema)
    got = docs.collect()
    # so few labelled rows tell no word toxic; null and empty texts are equal copies, of which the least id stays
    assert sorted((x.doc_id or 0, x.text or "") for x in got) == sorted((i or 0, t or "") for i, t in rows if (i, t) not in ((None, None), (4, "")))
    assert all([x[n] for n in names] == [*range(len(names))] and x["pair"]["s t"] == 1 and x["list"] == ["x"] for x in got)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert sorted(p.doc_id or 0 for p in pieces if p.start == 0) == sorted(x.doc_id or 0 for x in got)


def test_stages_of_empty_tables(spark, tmp_path):
    rows, _, _ = documents(60)
    empty = {"documents": "doc_id bigint, text string, lang string, source string, n_chars bigint", "labels": "doc_id bigint, quality int, toxic int", "benchmark": "item_id bigint, text string"}
    for name, schema in empty.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/{name}.parquet")
        spark.createDataFrame(rows if name == "documents" else [], schema).write.parquet(f"{tmp_path}/some/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    docs = spark.read.parquet(f"{tmp_path}/some/documents.parquet")  # nothing is known to be toxic, no item can leak
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name in ("toxicity", "decontamination"):
            assert stage(spark, docs, f"{tmp_path}/some").count() == len(rows)
