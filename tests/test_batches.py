"""Batches by next cuts and rounds of bisection, against literal models."""

import random

import pytest
from pyspark.sql import functions as F

from cuelane.operators import batching, chains

RNG = random.Random(4)


def cut_model(starts, ends, least=50, most=100, gap=5000):
    n, lo, batch, out = len(starts), 0, 0, []
    while n - lo > least:
        hi = min(n, lo + most)
        spots = range(lo + least, hi)
        at = next((i for i in spots if starts[i] - ends[i - 1] >= gap), None)
        if at is None:
            at = max(spots, key=lambda i: (starts[i] - ends[i - 1], -i)) if hi < n and len(spots) else hi
        out += [batch] * (at - lo)
        lo, batch = at, batch + 1
    return out + [batch] * (n - lo)


def test_batches(spark, monkeypatch):
    rows, want = [], {}
    for m in range(40):
        n = RNG.choice([1, 49, 50, 51, 99, 100, 101, 150, 400])
        t, ends = 0, []
        starts = []
        for _ in range(n):
            t += RNG.choice([100, 100, 200, 4999, 6000]) if RNG.random() < 0.05 else 150
            starts.append(t)
            ends.append(t + 100)
        want |= {(f"m{m}", i): b for i, b in enumerate(cut_model(starts, ends))}
        rows += [(f"m{m}", i, s, e, "x") for i, (s, e) in enumerate(zip(starts, ends, strict=True))]
    segments = spark.createDataFrame(rows, "media_id string, seg_idx int, start_ms long, end_ms long, text string").repartition(3)
    monkeypatch.setattr(chains, "BLOCK", 64)
    got = batching.smart_batches(segments).collect()
    assert {(r.media_id, r.seg_idx): r.batch_id for r in got} == want
    first = {}
    for m, i in sorted(want, key=lambda x: (x[0], x[1])):
        first.setdefault((m, want[m, i]), i)
    assert all(r.item == r.seg_idx - first[r.media_id, r.batch_id] + 1 for r in got)
    assert batching.smart_batches(segments.limit(0)).count() == 0


def test_one_recording_with_half_of_all_rows(spark):
    n = 20_000
    rows = spark.range(n).selectExpr("CASE WHEN id % 2 = 0 THEN 'big' ELSE concat('m', id % 301) END AS media_id", "cast(id AS int) AS seg_idx", "id * 1000 AS start_ms", "id * 1000 + 400 + pmod(hash(id), 500) AS end_ms", "'x' AS text")
    got = batching.smart_batches(rows)
    sizes = got.groupBy("media_id", "batch_id").count().where("media_id = 'big'").orderBy("batch_id").collect()
    own = sorted((r.start_ms, r.end_ms) for r in rows.where("media_id = 'big'").collect())
    model = cut_model([a for a, _ in own], [b for _, b in own])
    assert [r["count"] for r in sizes] == [model.count(b) for b in range(model[-1] + 1)]


def bisect_model(items, bad, label, depth=0):
    """Label, depth and failure of each item of a part."""
    if not any(bad[i] for i in items):
        return {i: (label, depth, False) for i in items}
    if len(items) == 1:
        return {items[0]: (label, depth, True)}
    half = len(items) // 2
    return bisect_model(items[:half], bad, label + "-A", depth + 1) | bisect_model(items[half:], bad, label + "-B", depth + 1)


@pytest.mark.parametrize("share", [0.0, 0.05, 1.0])
def test_bisection_until_done(spark, share):
    rows, want = [], {}
    for m in ("a", "b"):
        for b in range(3):
            n = RNG.choice([1, 2, 7, 100])
            bad = {i: RNG.random() < share for i in range(1, n + 1)}
            rows += [(m, b, i, bad[i]) for i in bad]
            want |= {(m, b, i): x for i, x in bisect_model(list(bad), bad, str(b)).items()}
    items = spark.createDataFrame(rows, "media_id string, batch_id int, item int, bad boolean")
    asked = []

    def ask(part):
        asked.append(part.count())
        refused = part.groupBy("media_id", "label").agg(F.max("bad").alias("refused")).where("refused").select("media_id", "label")
        return part.join(refused, ["media_id", "label"], "left_anti").select("media_id", "label", "item", F.lit("said").alias("line"))

    got = batching.bisect_until_done(items, ask).collect()
    assert {(r.media_id, r.batch_id, r.item): (r.label, r.depth, r.failed) for r in got} == want and len(got) == len(want)
    assert all((r.line is None) == r.failed for r in got) and len(asked) <= 8
    assert max(d for _, d, _ in want.values()) <= 7
    assert batching.bisect_until_done(items.limit(0), ask).count() == 0


def test_a_part_without_a_line_is_not_answered(spark):
    items = spark.createDataFrame([("a", 0, 1), ("a", 0, 2)], "media_id string, batch_id int, item int")
    ask = lambda p: p.where("NOT (n = 2 AND item = 2)").select("media_id", "label", "item", F.lit("x").alias("line"))
    assert sorted((r.item, r.label, r.failed) for r in batching.bisect_until_done(items, ask).collect()) == [(1, "0-A", False), (2, "0-B", False)]
