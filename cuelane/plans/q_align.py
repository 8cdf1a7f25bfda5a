"""Queries that lay subtitle text over segments. SQL cannot express them; tests check them against invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelane.operators import align, batching, chains
from cuelane.plans import fixtures as fx
from cuelane.plans.q_review import _items

SQL: dict[str, str] = {}


def _context(spark, d):
    i = _items(spark, d)
    b = chains.stored_as_dealt(i.groupBy("media_id", "batch_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")))
    s = fx.srt(spark, d).drop("lang", "ord")
    times = chains.stored_as_dealt(s.drop("text"))  # of entries; both are read several times
    return i, batching.context_entries(b, times).join(s, ["media_id", "entry_id"])


def j11(spark, d):
    return align.align_by_time(*_context(spark, d))


def j13(spark, d):
    return align.split_by_durations(*_context(spark, d))


def j12(spark, d):
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("taken string, rest string")
    def cut(text, ratio):
        import pandas as pd

        return pd.DataFrame([align.cut_text_at_ratio(t, r) for t, r in zip(text, ratio, strict=True)], columns=["taken", "rest"])

    s = fx.srt(spark, d).withColumn("c", cut("text", (F.col("ord") % 10) / 10.0))
    return s.select("media_id", "ord", "c.taken", "c.rest")


Q = {"j11_align_by_time": j11, "j12_cut_text_at_ratio": j12, "j13_split_by_durations": j13}
