"""Streams into a table: late rows, repeated rows, bounded state and restarts, against the same counts by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cuelane.streaming import streams

DAY0 = dt.datetime(2024, 1, 1)
SCHEMA = "media_id string, stem string, attempt int, ok boolean, ts timestamp"


def at(day, minute=0):
    return DAY0 + dt.timedelta(days=day, minutes=minute)


def put(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def source(spark, folder, schema=SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def counted(df):
    return sorted((r.media_id, (r["from"] - DAY0).days, r.total, r.successful, r.failed) for r in df.collect())


def test_late_and_repeated_rows(spark, tmp_path):
    put(spark, tmp_path / "in", [("a", "s", 1, True, at(0, 5)), ("a", "s", 2, False, at(0, 6)), ("b", "s", 1, True, at(0, 7))])
    job = lambda x: streams.qc_counters(x, "1 day")
    first = counted(streams.run_once(source(spark, tmp_path / "in"), job, str(tmp_path / "out")))
    assert first == []  # the day is still open
    put(spark, tmp_path / "in", [("a", "s", 3, True, at(3)), ("a", "s", 3, True, at(3, 1))])  # one attempt told twice
    assert counted(streams.run_once(source(spark, tmp_path / "in"), job, str(tmp_path / "out"))) == [("a", 0, 2, 1, 1), ("b", 0, 1, 1, 0)]
    put(spark, tmp_path / "in", [("b", "s", 9, True, at(0, 9)), ("b", "s", 4, False, at(2, 30))])  # the first is later than a day, the second is not
    got = counted(streams.run_once(source(spark, tmp_path / "in"), job, str(tmp_path / "out"), close=True))
    assert got == [("a", 0, 2, 1, 1), ("a", 3, 1, 1, 0), ("b", 0, 1, 1, 0), ("b", 2, 1, 0, 1)]
    assert counted(streams.run_once(source(spark, tmp_path / "in"), job, str(tmp_path / "out"))) == got  # nothing new, nothing twice


def test_restart_in_the_middle_gives_the_same_rows(spark, tmp_path, monkeypatch):
    rows = [[(f"m{k % 3}", "s", day * 10 + k, k % 2 == 0, at(day, k)) for k in range(9)] for day in range(6)]
    for part in rows:
        put(spark, tmp_path / "in", part)
    job = lambda x: streams.qc_counters(x, "1 day")
    whole = counted(streams.run_once(source(spark, tmp_path / "in"), job, str(tmp_path / "whole"), close=True))
    assert whole == sorted((f"m{m}", day, 3, sum(k % 2 == 0 for k in range(m, 9, 3)), sum(k % 2 for k in range(m, 9, 3))) for day in range(6) for m in range(3))
    from pyspark.sql.readwriter import DataFrameWriter

    write, left = DataFrameWriter.parquet, [4]

    def failing(self, path, *a, **k):
        write(self, path, *a, **k)
        if "/rows/" in path:
            left[0] -= 1
            if left[0] == 0:
                raise RuntimeError("lost after the rows were written")  # the batch is not committed and runs again

    monkeypatch.setattr(DataFrameWriter, "parquet", failing)
    with pytest.raises(Exception, match="lost after"):
        streams.run_once(source(spark, tmp_path / "in"), job, str(tmp_path / "cut"), close=True)
    monkeypatch.undo()
    assert counted(streams.run_once(source(spark, tmp_path / "in"), job, str(tmp_path / "cut"), close=True)) == whole


def test_state_is_bounded(spark, tmp_path):
    for day in range(8):
        put(spark, tmp_path / "in", [(f"m{k}", "s", day, True, at(day, k)) for k in range(20)])
    marks = tmp_path / "out"
    sizes = []
    job = lambda x: streams.qc_counters(x, "1 day")
    from pyspark.sql.streaming import StreamingQuery

    done = StreamingQuery.awaitTermination

    def watch(self, *a):
        out = done(self, *a)
        sizes.extend(sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in self.recentProgress)
        return out

    StreamingQuery.awaitTermination = watch
    try:
        n = streams.run_once(source(spark, tmp_path / "in"), job, str(marks), close=True).count()
    finally:
        StreamingQuery.awaitTermination = done
    assert n == 160 and max(sizes) <= 160 < 8 * 20 * 2  # 40 entries a day (attempts and windows), of at most four days


def test_sessions_equal_a_pass_over_the_sorted_words(spark, tmp_path):
    words = [(m, DAY0 + dt.timedelta(milliseconds=t), d) for m, t, d in [("a", 0, 200), ("a", 500, 100), ("a", 901, 50), ("b", 0, 100), ("b", 400, 100), ("a", 90_000_000, 10), ("b", 200_000_000, 10)]]
    schema = "media_id string, ts timestamp, duration_ms int"
    for part in (words[:5], words[5:]):
        put(spark, tmp_path / "in", part, schema)
    got = streams.run_once(source(spark, tmp_path / "in", schema), lambda x: streams.pause_sessions(x, "1 hour"), str(tmp_path / "out"), close=True)
    base = int(DAY0.replace(tzinfo=dt.UTC).timestamp() * 1000)
    assert sorted((r.media_id, r.start_ms - base, r.end_ms - base, r.n_words) for r in got.collect()) == [("a", 0, 600, 2), ("a", 901, 951, 1), ("a", 90_000_000, 90_000_010, 1), ("b", 0, 500, 2), ("b", 200_000_000, 200_000_010, 1)]


def test_empty_streams(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))
    assert streams.run_once(source(spark, tmp_path / "in"), streams.qc_counters, str(tmp_path / "out"), close=True).where(F.col("media_id").isNotNull()).count() == 0
