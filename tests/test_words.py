"""Words in normal form and rows of segments: odd numbers, ties, and what the JVM can compile."""

import math
import re

from pyspark.sql import functions as F

from cuelane.operators import segment, words as wd
from cuelane.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_normal_form_is_short_enough_to_be_compiled(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan has no code before it runs
    try:
        df = catalog.queries()["p1_normalise_words"](spark, DATA)
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", df._jdf.queryExecution().explainString(mode))]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) < 8000  # the JVM only interprets longer methods


def test_milliseconds_are_rounded_as_round_does(spark):
    xs = [0.0005, 0.0015, -0.0005, -0.0025, 0.49999999999999994e-3, 1.0005, 2.675, 1e9 + 0.0005, 0.1 + 0.2, -7.3, 0.0, 123456.7895, None]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", wd.to_ms(F.col("x")).alias("a"), F.round(F.col("x") * 1000).cast("long").alias("b")).collect():
        assert r.a == r.b, r


def test_spellings_that_are_no_numbers_fall_through(spark):
    raw = spark.createDataFrame([("m", 0, "a", math.nan, 1.0, 0.5), ("m", 1, "b", math.inf, None, 0.5), ("m", 2, "c", 0.0, 2.0, -math.inf), ("m", 3, '""', 1.0, 1.0, 1.0)], "media_id string, input_pos int, word string, start double, start_time double, duration double")
    got = lambda z: [tuple(r)[1:5] for r in wd.normalise_words(raw, z).orderBy("input_pos").collect()]
    assert got(True) == [(0, "a", 1000, 1500), (2, "c", 0, 0)]
    assert got(False) == [(0, "a", 1000, 1500), (2, "c", 2000, 2000)]


def test_speaker_of_a_segment(spark):
    said = {0: ["B", "A", "A", "B"], 1: [None, "A", "B", "B"], 2: [None, None], 3: ["C", None, "C"], 4: ["C", "A", "B", "A", "C", "C"]}
    rows = [("m", s, 10 * s + i, 10 * s + i, 10 * s + i + 1, f"w{i}", 0.5, who) for s, whos in said.items() for i, who in enumerate(whos)]
    w = spark.createDataFrame(rows, "media_id string, seg_idx int, input_pos int, start_ms long, end_ms long, word string, score double, speaker string")
    got = {r.seg_idx: (r.speaker, r.mixed_speakers, r.text, r.end_ms, len(r.words)) for r in segment.segment_rows(w).collect()}
    assert got == {0: ("B", True, "w0 w1 w2 w3", 4, 4), 1: ("B", True, "w0 w1 w2 w3", 14, 4), 2: (None, False, "w0 w1", 22, 2), 3: ("C", False, "w0 w1 w2", 33, 3), 4: ("C", True, "w0 w1 w2 w3 w4 w5", 46, 6)}
