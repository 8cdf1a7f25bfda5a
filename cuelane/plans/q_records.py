"""Queries of small projections, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelane.operators import records as rc
from cuelane.plans import fixtures as fx

_FAIL = """WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority || '   x' END AS a, CASE WHEN o_orderkey % 3 = 1 THEN '  ' WHEN o_orderkey % 3 = 2 THEN o_orderstatus END AS b FROM orders)
SELECT o_orderkey, trim(regexp_replace(CASE WHEN o_orderkey % 3 = 0 THEN a WHEN o_orderkey % 3 = 2 THEN b ELSE 'inner ' || o_orderkey END, '\\s+', ' ', 'g')) AS first_text FROM x"""
_TRACKS = """WITH t AS (SELECT 's' || (p_partkey % 30) AS stem, p_partkey AS pos, CASE p_partkey % 3 WHEN 0 THEN 'HUN' WHEN 1 THEN 'xyz' END AS lang, CASE p_partkey % 4 WHEN 0 THEN 'subrip' WHEN 1 THEN 'ASS' ELSE 'odd' END AS codec FROM part),
n AS (SELECT pos, stem || '_' || CASE lower(lang) WHEN 'hun' THEN 'hu' ELSE coalesce(lower(lang), 'und') END AS n, CASE lower(codec) WHEN 'subrip' THEN 'srt' WHEN 'ass' THEN 'ass' ELSE 'txt' END AS e FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY n, e ORDER BY pos) - 1 AS k FROM n) SELECT pos, n || CASE WHEN k > 0 THEN '_' || k ELSE '' END || '.' || e AS file_name FROM r"""


def p16(spark, d):
    o = fx.table(spark, d, "orders")
    k = F.col("o_orderkey") % 3
    f = F.array(F.struct(F.lit(None).cast("string").alias("original_text"), F.lit(" ").alias("gen_text")), F.struct(F.concat(F.lit("inner  "), "o_orderkey").alias("original_text"), F.lit("z").alias("gen_text")))
    return rc.first_failure_text(o.select("o_orderkey", F.when(k == 0, F.concat("o_orderpriority", F.lit("   x"))).alias("original_text"), F.when(k == 1, "  ").when(k == 2, F.col("o_orderstatus")).alias("gen_text"), f.alias("failures"))).select("o_orderkey", "first_text")


def p17(spark, d):
    p = fx.table(spark, d, "part")
    t = p.select(F.concat(F.lit("s"), F.col("p_partkey") % 30).alias("stem"), F.col("p_partkey").alias("pos"), F.expr("CASE p_partkey % 3 WHEN 0 THEN 'HUN' WHEN 1 THEN 'xyz' END").alias("lang"), F.expr("CASE p_partkey % 4 WHEN 0 THEN 'subrip' WHEN 1 THEN 'ASS' ELSE 'odd' END").alias("codec"))
    return rc.subtitle_track_names(t).select("pos", "file_name")


def p18(spark, d):
    return fx.table(spark, d, "pages").select("page_id", rc.unescape_text(F.replace(F.col("html"), F.lit('"'), F.lit('\\"'))).alias("text"))


Q = {"p16_first_failure_text": p16, "p17_subtitle_track_names": p17, "p18_unescape_text": p18}
SQL = {"p16_first_failure_text": _FAIL, "p17_subtitle_track_names": _TRACKS, "p18_unescape_text": "SELECT page_id, replace(html, chr(92) || '\"', '\"') AS text FROM pages"}
