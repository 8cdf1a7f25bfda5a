"""What queries store and read: cuts are walked where rows lie, rounds store ranges, segments are made once."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cuelane.operators import batching, chains, segment
from cuelane.plans import catalog, fixtures as fx

DATA = "/root/testdata/sf0.001"


def scans(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


@pytest.fixture
def kept(monkeypatch):
    rows = []
    monkeypatch.setattr(chains, "stored", lambda df, store=chains.stored: rows.append(store(df)) or rows[-1])
    return rows


def test_cuts_are_walked_without_storing(spark, kept):
    segment.punct_comma_segments(fx.words(spark, DATA)).count()
    assert batching.smart_batches(fx.segments(spark, DATA)).count() and not kept


def test_rounds_store_each_item_twice_at_most(spark, kept):
    n = 2048
    items = spark.range(n).selectExpr("'m' AS media_id", "cast(id div 128 AS int) AS batch_id", "cast(id % 128 + 1 AS int) AS item", "concat('t', id) AS text", "id % 37 = 5 AS bad", "id AS other")
    ask = lambda o: o.withColumn("refused", F.max("bad").over(W.partitionBy("media_id", "label"))).where("NOT refused").selectExpr("media_id", "label", "item", "text AS line")
    got = batching.bisect_until_done(items, ask).collect()
    assert sorted(r.other for r in got) == list(range(n)) and all(r.failed == r.bad and r.line == (None if r.bad else r.text) for r in got)
    parts = sum(df.where("open").count() for df in kept if "open" in df.columns)
    assert sum(df.count() for df in kept) == 2 * n + parts and parts < n


@pytest.mark.parametrize("name, most", [("w16_gap_segments", 0), ("j16_segment_has_clip", 0), ("b10_invalidate_clips", 0), ("j15_parse_alignment_answer", 1), ("b6_block_translation_join", 2)])
def test_segments_are_made_once(spark, name, most):
    assert scans(catalog.queries()[name](spark, DATA)) <= most


def test_alignment_answers_of_one_batch(spark):
    rows = [("m", 0, 2, '[{"index":1,"text":"a"},{"index":2,"text":"b"}]'), ("m", 1, 2, '[{"index":1,"text":"a"},{"index":1,"text":"b"}]'), ("m", 2, 1, '[{"id":1,"translation":" c "}]'), ("m", 3, 1, '[{"index":1,"text":" "}]'), (None, 4, 1, '[{"index":1,"text":"x"}]')]
    got = batching.parse_alignment_answer(spark.createDataFrame(rows, "media_id string, batch_id int, n int, answer string")).collect()
    assert sorted(tuple(r) for r in got) == [("m", 0, 1, "a"), ("m", 0, 2, "b"), ("m", 2, 1, "c")]
