"""Small documents with everything awkward: nulls, empties, ties, repeats, long texts, odd spaces."""

import random

WORDS = "der the of and Éa über naïve x1 a,b --- ... 中文 word Word WORD foo bar baz qux idiot".split()


def texts(seed=0, n=60):
    r = random.Random(seed)
    base = [" ".join(r.choice(WORDS) + (str(r.randrange(40)) if r.random() < 0.6 else "") for _ in range(r.choice([1, 2, 3, 9, 10, 25, 60, 200]))) for _ in range(n)]
    out = list(base)
    out += base[: n // 3]  # exact copies
    out += [t + "  \n tail\t" + base[3] for t in base[: n // 4]]
    out += [t.replace("the", "die", 1) for t in base[: n // 4]]
    out += [None, "", " \t\n", "\x0b\x0c", "one", "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a", "   x   y  ", "A" * 300, "n\xa0b c d", "x\x00y\x1cz", ("very long " + base[1] + " ") * 150, base[2] + " " + base[2]]
    return out


def documents(spark, seed=0):
    rows = [(i * 3, t, "en", f"s{i % 3}", None if t is None else len(t), "clash", i) for i, t in enumerate(texts(seed))]
    rows += [rows[5], rows[5], (None, "the of and the of and 12 no id", "en", None, 1, None, None), (7, None, None, None, None, None, None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, component_id string, n_words int"
    return spark.createDataFrame(rows, schema)


def empty(spark):
    return documents(spark).limit(0)
