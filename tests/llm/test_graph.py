import random

import numpy as np

from slicer.llm import simhash
from slicer.llm.graph import components


def roots(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def check(spark, pairs):
    got = components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
    want = roots([(a, b) for a, b in pairs if a is not None and b is not None and a != b])
    assert len(got) == len(want) and {r.node: r.component for r in got} == want


def test_small_shapes(spark):
    r = random.Random(2)
    chain = [5, *range(1000, 1000 + 61), 1]  # the least label is at the far end
    shapes = [
        [(1, 2), (2, 1), (3, 3), (None, 4), (5, None), (9, 7), (7, 8), (2, 1)],
        [(0, i) for i in range(1, 400)] + [(-5, 0)],  # a hub
        [(i, (i + 1) % 50) for i in range(50)],  # a cycle
        list(zip(chain, chain[1:])),
        [(r.randrange(300), r.randrange(300)) for _ in range(200)],
    ]
    check(spark, [tuple(x if x is None else x + 10_000 * k for x in pair) for k, pairs in enumerate(shapes) for pair in pairs])
    assert components(spark.createDataFrame([(3, 3)], "a bigint, b bigint")).collect() == []


def test_shuffled_path_of_100000(spark):
    order = np.random.default_rng(1).permutation(100_000)
    pairs = spark.createDataFrame([(int(a), int(b)) for a, b in zip(order, order[1:])], "a bigint, b bigint")
    got = components(pairs).agg({"component": "max", "node": "count"}).first()
    assert (got["max(component)"], got["count(node)"]) == (0, 100_000)


def test_drifting_chain_of_fingerprints(spark):
    """150 fingerprints, each two bits from the next, in shuffled node order, are one group."""
    r, value, values = random.Random(4), 0, []
    bits = r.sample(range(64), 64)
    for i in range(150):
        values.append(value)
        for b in (bits[2 * i % 64], bits[(2 * i + 1) % 64]):
            value ^= 1 << b
    nodes = r.sample(range(1000), 150)
    seen = dict(zip(values, nodes))
    df = spark.createDataFrame([(n, v - (1 << 64) if v >> 63 else v) for v, n in seen.items()], "node bigint, fp bigint")
    got = components(simhash.links(df)).collect()
    assert len(got) == len(seen) and {x.component for x in got} == {min(seen.values())}
