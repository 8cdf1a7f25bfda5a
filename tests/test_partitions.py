"""How many tasks share a large table: as many as its texts want, whatever its files hold."""

import re

from cuelane.operators import intervals as iv
from cuelane.plans import catalog, fixtures as fx

DATA = "/root/testdata/sf0.001"


def dealt(df) -> list[str]:
    return re.findall(r"Exchange (.*)", df.select("*")._jdf.queryExecution().executedPlan().toString())


def test_repeated_texts_count_each_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fx, "TEXT_BYTES", 20_000)
    spark.range(500).selectExpr("id AS doc_id", "repeat('some words ', 100) AS text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert fx.parts(spark, str(tmp_path)) == 28  # 550,000 bytes; a file of a few thousand


def test_short_regions_are_given_away_where_they_lie(spark):
    got = dealt(catalog.queries()["j7_filter_short_regions"](spark, DATA))
    assert len(got) == 1 and "REPARTITION_BY_NUM" in got[0]


def test_cells_are_dealt_as_told(spark):
    turns = spark.createDataFrame([("m", "r", "a", 0, 61_000), ("m", "h", "a", 0, 60_000)], "media_id string, side string, speaker string, start_ms long, end_ms long")
    assert [x for x in dealt(iv._swept(turns, 250, 37)) if ", 37)" in x]
