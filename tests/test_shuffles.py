"""What crosses between tasks: texts are dealt once, words stay where they are."""

import re

from cuelane.operators import segment, words as wd
from cuelane.plans import catalog, fixtures as fx

DATA = "/root/testdata/sf0.001"


def shuffles(df) -> list[str]:
    """Of a plan that broadcasts nothing."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return planned(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def planned(df) -> list[str]:
    df = df.select("*")
    return re.findall(r"Exchange (.*)", df._jdf.queryExecution().executedPlan().toString())


def test_words_are_not_shuffled(spark):
    for df in (fx.words(spark, DATA), segment.pause_segments(fx.words(spark, DATA)), fx.segments(spark, DATA), fx.edits(spark, DATA)):
        assert len(shuffles(df)) == 1 and "REPARTITION_BY_NUM" in shuffles(df)[0]


def test_forced_breaks_and_positions_move_no_words(spark):
    w = fx.words(spark, DATA)
    forced = segment.forced_segments(w, segment.snap_change_points(w, fx.change_points(spark, DATA)))
    aligned = wd.align_by_position(w, w)
    for df in (forced, aligned):
        assert not [x for x in shuffles(df) if "input_pos" in x or "idx" in x]


def test_positions_that_are_there_twice_or_missing(spark):
    words = spark.createDataFrame([("a", 0, "x", 0, 1), ("a", 1, "y", 1, 2), ("a", 1, "z", 2, 3), ("b", None, "x", 0, 1), (None, 0, "x", 0, 1)], "media_id string, input_pos int, word string, start_ms long, end_ms long")
    aligned = spark.createDataFrame([("a", 1, "Y", 11, 12), ("a", 1, "q", 21, 22), ("a", 2, "r", 31, 32), ("b", None, "x", 7, 8), (None, 0, "x", 7, 8)], words.schema)
    got = sorted(map(repr, map(tuple, wd.align_by_position(words, aligned).collect())))
    assert got == sorted(map(repr, [
        ("a", 0, "x", None, None, None), ("a", 1, "y", 11, 12, False), ("a", 1, "y", 21, 22, True), ("a", 1, "z", 11, 12, True), ("a", 1, "z", 21, 22, True),
        ("b", None, "x", None, None, None), (None, 0, "x", 0, 1, False),
    ]))


def test_cuts_of_short_stretches_store_and_move_no_words(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(segment.chains, "stored", lambda df, store=segment.chains.stored: kept.append(store(df)) or kept[-1])
    out = segment.split_words(segment.pause_segments(fx.words(spark, DATA), 100000), "recursive", local=10**6)
    assert sum(df.count() for df in kept) == 0
    assert not [x for x in shuffles(out) if "REPARTITION_BY_NUM" not in x]


def test_joins_of_a_recording_move_no_words(spark):
    for name in ("j3_speaker_runs", "j4_assign_words_to_runs", "a2_retry_gate", "j17_failed_resolved", "j20_promote_failed_clip"):
        assert not [x for x in shuffles(catalog.queries()[name](spark, DATA)) if "REPARTITION_BY_NUM" not in x], name
    for name in ("j11_align_by_time", "j13_split_by_durations", "p5_tokens_to_words"):  # no more than by recording
        assert not [x for x in shuffles(catalog.queries()[name](spark, DATA)) if "REPARTITION_BY_NUM" not in x], name


def test_partitions_of_words_follow_the_size_of_texts(spark, monkeypatch):
    rows = sorted(map(tuple, segment.word_segments(fx.words(spark, DATA)).collect()))
    monkeypatch.setattr(fx, "TEXT_BYTES", 20_000)
    fx.parts.cache_clear()
    try:
        n = fx.parts(spark, DATA)
        assert n > 4 and [x for x in shuffles(fx.words(spark, DATA)) if f", {n})" in x]
        assert sorted(map(tuple, segment.word_segments(fx.words(spark, DATA)).collect())) == rows
    finally:
        fx.parts.cache_clear()


def test_split_by_speaker_makes_words_once_per_input(spark):
    for name in ("j5_split_by_speaker", "j5_split_counters"):
        got = shuffles(catalog.queries()[name](spark, DATA))
        assert len(got) <= 6 and not [x for x in got if "REPARTITION_BY_NUM" not in x], got
