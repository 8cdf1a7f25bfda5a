"""Queries of Hungarian spoken forms. Their rules need look-ahead and word tables, so tests check them instead of SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelane.functions import hungarian as hu
from cuelane.plans import fixtures as fx

SQL: dict[str, str] = {}


def _stamp():
    """The order date in one of the nine shapes of date, by order key."""
    y, m, n = F.date_format("o_orderdate", "yyyy"), F.month("o_orderdate"), F.dayofmonth("o_orderdate").cast("string")
    name, short, roman = (F.element_at(F.array(*map(F.lit, x)), m) for x in (hu.MONTHS, list({i: k for k, i in hu.SHORT_MONTHS.items()}.values()), list(hu.ROMAN_MONTHS)))
    say = lambda *x: F.concat(*[F.lit(c) if isinstance(c, str) else c for c in x])
    shapes = [say(y, ". ", name, " ", n, "."), F.date_format("o_orderdate", "yyyy. MM. dd."), F.date_format("o_orderdate", "yyyy.MM.dd."), say(y, ". ", short, " ", n, "."), say(y, ".", short, n, "."), say(y, ". ", roman, ". ", n, "."), say(y, ".", roman, ".", n, "."), F.date_format("o_orderdate", "yyyy-MM-dd"), say(y, ". ", short, " ", n, "-én")]
    return F.element_at(F.array(*shapes), (F.col("o_orderkey") % 9 + 1).cast("int"))


def _orders(spark, d, stamp=None):
    o = fx.table(spark, d, "orders")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd") if stamp is None else stamp
    clock = F.concat((F.col("o_custkey") % 24).cast("string"), F.lit(":"), F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0"), F.when(F.col("o_orderkey") % 3 == 0, "-kor").otherwise(""))
    return o.select("o_orderkey", F.concat_ws(" ", F.concat((F.col("o_custkey") % 900).cast("string"), F.lit(".")), F.lit("rendelés"), stamp, clock, F.concat(F.lit("A"), F.col("o_custkey") % 100, F.lit("B-vel")), F.lit("ára"), F.floor("o_totalprice").cast("string")).alias("text"))


def _query(rule, name, dated=False):
    return lambda spark, d: hu.over_texts(_orders(spark, d, _stamp() if dated else None), rule, name).drop("text")


Q = {
    "t3_times_hu": _query(hu.times_hu, "spoken"),
    "t6_alphanumeric_hu": _query(hu.alphanumeric_hu, "spoken"),
    "t7_dates_hu": _query(hu.dates_hu, "spoken", dated=True),
    "t8_ordinals_hu": _query(hu.ordinals_hu, "spoken"),
    "t10_normalise_hu": _query(lambda t: hu.normalise_text(t, [("ára", "értéke")]), "spoken", dated=True),
}
