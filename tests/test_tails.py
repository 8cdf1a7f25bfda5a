"""Tails of clips: chunks measured in workers give what a table of chunks gives."""

import random

import numpy as np

from cuelane.operators import timeline as tl
from cuelane.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_measured_chunks_are_those_of_a_table(spark, monkeypatch):
    rng = random.Random(5)
    measured = {f"s{i}": [rng.choice([-20.0, -49.9, -50.0, -52.5, -60.0, -74.0, -80.0, -80.1, -96.0]) if rng.random() < 0.4 else -90.0 for _ in range(rng.randrange(40))] for i in range(200)} | {"quiet": [-90.0] * 30, "none": []}
    clips = spark.createDataFrame([("m", s, 5 * len(v) + 3, 160) for s, v in measured.items()], "media_id string, stem string, actual_ms long, window_ms long")
    chunks = spark.createDataFrame([("m", s, i, x) for s, v in measured.items() for i, x in enumerate(v)], "media_id string, stem string, idx long, db double")

    def levels(batch):
        lists = [measured[s] for s in batch.column(1).to_pylist()]
        return np.array(sum(lists, []), float), np.array([len(v) for v in lists], np.int64)

    monkeypatch.setattr(tl, "STEP_CHUNKS", 64)  # goes to the workers with the function
    assert sorted(map(tuple, tl.tail_trim_measured(clips, levels).collect())) == sorted(map(tuple, tl.tail_trim(chunks, clips).collect()))


def test_no_chunk_is_a_row(spark):
    for name in ("q11_tail_trim", "q11_guard_outcome"):
        plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and plan.count("FileScan") == 1
