"""Chains over blocks against a walk."""

import random

import pytest

from cuelane.operators import chains


@pytest.mark.parametrize("block", [1, 3, 50, 5000])
def test_chain_equals_a_walk(spark, block):
    r = random.Random(block)
    rows, want = [], set()
    for key in range(12):
        n = r.choice([1, 2, 30, 200])
        nxt = [None if r.random() < 0.05 or k + 1 >= n else r.randint(k + 1, min(n - 1, k + 9)) for k in range(n)]
        rows += [(key, None if key == 3 else "x", k // block, k, to, None if to is None else to // block) for k, to in enumerate(nxt)]
        at = 0
        while at is not None:
            want.add((key, at))
            at = nxt[at]
    points = spark.createDataFrame(rows, "m long, t string, b long, k long, nxt long, nxt_b long").where("m <> 3").drop("t").repartition(3)
    want = {w for w in want if w[0] != 3}
    got = [(x.m, x.k) for x in chains.chain(points, ["m"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert chains.chain(points.limit(0), ["m"]).count() == 0
