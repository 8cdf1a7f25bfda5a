"""Recordings simulated from the given tables, by integer arithmetic only, once as DataFrames and once as SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cuelane.operators import chains, segment, words as ops
from cuelane.plans.session import join_in_place

#: Bytes of texts that go to a partition; as words these are some fifty times as large in memory.
TEXT_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.lru_cache(maxsize=64)
def parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions that texts are dealt to: those of the session, and more where these would be too large. Texts are measured
    by a scan, as files do not tell: repeated texts are stored once in them."""
    size = table(spark, sf_dir, "documents").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TEXT_BYTES))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are dealt by recording before they are cut into words, so that words lie where windows, groups and joins of a
    recording want them: no job shuffles words to make them, and equal texts dealt once serve all inputs of a query. The
    number of partitions is given, as a partition of texts grows some hundred times as words."""
    join_in_place(spark)
    t = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("media_id"), "doc_id", "text")
    t = t.repartition(parts(spark, sf_dir), "media_id")
    t = t.select("media_id", "doc_id", F.posexplode_outer(F.split(F.trim("text"), "\\s+")).alias("pos", "word")).where("word <> ''")
    gap = F.when((F.col("pos") * 7 + F.col("doc_id") * 13) % 11 == 0, 900).when((F.col("pos") * 7 + F.col("doc_id") * 13) % 11 < 3, 250).otherwise(40)
    t = t.withColumn("dur", F.length("word") * 60).withColumn("end_ms", F.sum(F.col("dur") + gap).over(W.partitionBy("media_id").orderBy("pos")))
    return t.select(
        "media_id", F.col("pos").alias("input_pos"), "word", (F.col("end_ms") - F.col("dur")).alias("start_ms"), "end_ms",
        (((F.col("pos") * 37 + F.col("doc_id")) % 1000) / 1000.0).alias("score"),
        F.when((F.col("pos") + F.col("doc_id")) % 17 != 0, F.concat(F.lit("S"), (F.floor(F.col("pos") / 9) + F.col("doc_id")) % 3)).alias("speaker"),
        F.lit(None).cast("string").alias("channel"), "doc_id",
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir).withColumn("g", F.expr("input_pos div 9"))
    return w.groupBy("media_id", "doc_id", "g").agg(F.greatest(F.lit(0), F.min("start_ms") - 30).alias("start_ms"), (F.max("end_ms") + 20).alias("end_ms")).select("media_id", "start_ms", "end_ms", F.concat(F.lit("T"), (F.col("g") + F.col("doc_id")) % 3).alias("speaker"))


def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).where("input_pos % 23 = 0").select("media_id", (F.col("start_ms") + (F.col("doc_id") % 5) * 60 - 120).alias("t_ms"))


def srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir).withColumn("ord", F.expr("input_pos div 12").cast("int"))
    g = w.groupBy("media_id", "ord").agg(F.min("start_ms").alias("start_ms"), (F.max("end_ms") + 100).alias("end_ms"), segment.joined("word", "input_pos").alias("text"))
    return g.select("media_id", F.lit("hu").alias("lang"), (F.col("ord") + 1).alias("entry_id"), "ord", "start_ms", "end_ms", "text")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segment.segment_rows(segment.pause_segments(words(spark, sf_dir))).drop("words")
    return s.withColumn("translated_text", F.when(F.col("seg_idx") % 11 == 5, None).when(F.col("seg_idx") % 7 == 3, "").otherwise(F.upper("text")))


def segment_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, seg_idx, start_ms, end_ms) of segments, stored as they are dealt, for queries that read them several times
    and need no texts."""
    return chains.stored_as_dealt(segments(spark, sf_dir).select("media_id", "seg_idx", "start_ms", "end_ms"))


def edits(spark: SparkSession, sf_dir: str, times: DataFrame | None = None) -> DataFrame:
    s = (segments(spark, sf_dir) if times is None else times).withColumn("m", F.col("seg_idx") % 29).withColumn("nxt", F.lead("start_ms").over(W.partitionBy("media_id").orderBy("seg_idx"))).where("m <= 4")
    return s.where("nxt IS NOT NULL OR m IN (0, 2)").select(
        "media_id", "seg_idx", F.expr("CASE m WHEN 0 THEN 'update' WHEN 1 THEN 'update' WHEN 2 THEN 'delete' ELSE 'insert' END").alias("op"),
        F.expr("CASE m WHEN 0 THEN start_ms + 20 WHEN 1 THEN start_ms WHEN 3 THEN end_ms + 5 WHEN 4 THEN end_ms - 5 END").alias("start_ms"),
        F.expr("CASE m WHEN 0 THEN end_ms WHEN 1 THEN nxt + 10 WHEN 3 THEN end_ms + 15 WHEN 4 THEN end_ms + 15 END").alias("end_ms"), F.concat(F.lit("edit "), "seg_idx").alias("text"),
    )


_ATTEMPT_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("attempt", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*_ATTEMPT_ORDER))).withColumn("q", F.col("l_quantity").cast("long"))
    li = li.join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return li.select(
        F.concat(F.lit("m"), F.col("l_orderkey") % 50).alias("media_id"), F.concat(F.lit("o"), "l_orderkey").alias("stem"), "attempt", F.col("p_name").alias("gen_text"),
        F.expr("CASE WHEN q % 3 = 0 THEN p_name ELSE left(p_name, greatest(0, length(p_name) - CAST(q % 7 AS INT))) END").alias("transcribed"),
        (F.lit(100) + F.col("l_partkey") % 80).cast("double").alias("ref_hz"), F.lit(0.7).alias("ref_voiced"),
        (F.lit(100) + F.col("l_partkey") % 80 + F.col("l_suppkey") % 61 - 30).cast("double").alias("gen_hz"), F.expr("CASE WHEN l_partkey % 19 = 0 THEN 0.0D ELSE 0.6D END").alias("gen_voiced"), "l_shipdate",
    )


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("attempt", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*_ATTEMPT_ORDER))).withColumn("win", F.lit(800) + F.col("l_quantity").cast("long") * 40)
    li = li.withColumn("end_ms", F.sum("win").over(W.partitionBy("l_orderkey").orderBy("attempt")))
    return li.select(F.concat(F.lit("o"), "l_orderkey").alias("media_id"), "attempt", (F.col("end_ms") - F.col("win")).alias("start_ms"), "end_ms", (F.col("win") + F.col("l_suppkey") % 700 - 250).alias("actual_ms"), "l_partkey", "l_suppkey")


def pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode_outer("embedding").alias("pos", "x")).where("x IS NOT NULL")
    return e.select("vec_id", F.concat(F.lit("v"), "vec_id").alias("media_id"), "pos", F.floor(F.col("x").cast("double") * 32767).cast("int").alias("sample"))


#: The same in SQL. Each may use those before it.
SQL = {
    "words": r"""words AS (
 SELECT 'd' || doc_id AS media_id, pos::INT AS input_pos, word, (end_ms - dur)::BIGINT AS start_ms, end_ms::BIGINT AS end_ms, ((pos * 37 + doc_id) % 1000) / 1000.0 AS score,
   CASE WHEN (pos + doc_id) % 17 <> 0 THEN 'S' || ((pos // 9 + doc_id) % 3) END AS speaker, doc_id
 FROM (SELECT *, sum(dur + gap) OVER (PARTITION BY doc_id ORDER BY pos) AS end_ms
  FROM (SELECT doc_id, pos, word, length(word) * 60 AS dur, CASE WHEN (pos * 7 + doc_id * 13) % 11 = 0 THEN 900 WHEN (pos * 7 + doc_id * 13) % 11 < 3 THEN 250 ELSE 40 END AS gap
   FROM (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM (SELECT doc_id, regexp_split_to_array(trim(text), '\s+') AS ws FROM documents)) WHERE word <> '')))""",
    "turns": """turns AS (
 SELECT media_id, greatest(0, min(start_ms) - 30) AS start_ms, max(end_ms) + 20 AS end_ms, 'T' || ((input_pos // 9 + doc_id) % 3) AS speaker FROM words GROUP BY media_id, doc_id, input_pos // 9)""",
    "change_points": """change_points AS (SELECT media_id, start_ms + (doc_id % 5) * 60 - 120 AS t_ms FROM words WHERE input_pos % 23 = 0)""",
    "srt": """srt AS (SELECT media_id, 'hu' AS lang, (input_pos // 12 + 1)::INT AS entry_id, (input_pos // 12)::INT AS ord, min(start_ms) AS start_ms, max(end_ms) + 100 AS end_ms, string_agg(word, ' ' ORDER BY input_pos) AS text
 FROM words GROUP BY media_id, input_pos // 12)""",
    "marked": """marked AS (SELECT *, (sum(brk) OVER (PARTITION BY media_id ORDER BY start_ms, input_pos) - 1)::INT AS seg_idx FROM (
 SELECT *, CASE WHEN coalesce(start_ms - lag(end_ms) OVER w > 300, true) THEN 1 ELSE 0 END AS brk FROM words WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, input_pos)))""",
    "seg0": """seg0 AS (SELECT media_id, seg_idx, min(start_ms) AS start_ms, arg_max(end_ms, input_pos) AS end_ms, trim(replace(string_agg(word, ' ' ORDER BY input_pos), '"', '')) AS text, count(DISTINCT speaker) > 1 AS mixed_speakers FROM marked GROUP BY media_id, seg_idx)""",
    "spk": """spk AS (SELECT media_id, seg_idx, speaker FROM (
 SELECT media_id, seg_idx, speaker, row_number() OVER (PARTITION BY media_id, seg_idx ORDER BY count(*) DESC, min(input_pos)) AS rn FROM marked WHERE speaker IS NOT NULL GROUP BY media_id, seg_idx, speaker) WHERE rn = 1)""",
    "segments": """segments AS (SELECT media_id, seg_idx, start_ms, end_ms, text, speaker, mixed_speakers,
  CASE WHEN seg_idx % 11 = 5 THEN NULL WHEN seg_idx % 7 = 3 THEN '' ELSE upper(text) END AS translated_text FROM seg0 LEFT JOIN spk USING (media_id, seg_idx))""",
    "edits": """edits AS (SELECT media_id, seg_idx, CASE m WHEN 0 THEN 'update' WHEN 1 THEN 'update' WHEN 2 THEN 'delete' ELSE 'insert' END AS op,
  CASE m WHEN 0 THEN start_ms + 20 WHEN 1 THEN start_ms WHEN 3 THEN end_ms + 5 WHEN 4 THEN end_ms - 5 END AS start_ms,
  CASE m WHEN 0 THEN end_ms WHEN 1 THEN nxt + 10 WHEN 3 THEN end_ms + 15 WHEN 4 THEN end_ms + 15 END AS end_ms, 'edit ' || seg_idx AS text
 FROM (SELECT *, seg_idx % 29 AS m, lead(start_ms) OVER (PARTITION BY media_id ORDER BY seg_idx) AS nxt FROM segments) WHERE m <= 4 AND (nxt IS NOT NULL OR m IN (0, 2)))""",
    "li": """li AS (SELECT *, l_quantity::BIGINT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)::INT AS attempt FROM lineitem)""",
    "attempts": """attempts AS (SELECT 'm' || (l_orderkey % 50) AS media_id, 'o' || l_orderkey AS stem, attempt, p_name AS gen_text,
  CASE WHEN q % 3 = 0 THEN p_name ELSE left(p_name, greatest(0, length(p_name) - q % 7)) END AS transcribed, (100 + l_partkey % 80)::DOUBLE AS ref_hz, 0.7 AS ref_voiced,
  (100 + l_partkey % 80 + l_suppkey % 61 - 30)::DOUBLE AS gen_hz, CASE WHEN l_partkey % 19 = 0 THEN 0.0 ELSE 0.6 END AS gen_voiced, l_shipdate FROM li JOIN part ON l_partkey = p_partkey)""",
    "clips": """clips AS (SELECT 'o' || l_orderkey AS media_id, attempt, (end_ms - win)::BIGINT AS start_ms, end_ms::BIGINT AS end_ms, win + l_suppkey % 700 - 250 AS actual_ms, l_partkey, l_suppkey
 FROM (SELECT *, 800 + q * 40 AS win, sum(800 + q * 40) OVER (PARTITION BY l_orderkey ORDER BY attempt) AS end_ms FROM li))""",
    "pcm": """pcm AS (SELECT vec_id, 'v' || vec_id AS media_id, pos, floor(x::DOUBLE * 32767)::INT AS sample FROM (SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding) AS x FROM embeddings))""",
}
_NEEDS = {
    "turns": ["words"], "change_points": ["words"], "srt": ["words"], "marked": ["words"], "seg0": ["marked"], "spk": ["marked"], "segments": ["seg0", "spk"], "edits": ["segments"], "attempts": ["li"], "clips": ["li"],
}


def oracle(needs: str, body: str) -> str:
    """SQL with the fixtures named in needs, and those that they need, in front. body may start with further 'name AS (...),' parts ended by a line 'SELECT'."""
    want: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in want:
            want.append(name)

    for name in needs.split():
        add(name)
    return "WITH " + ",\n".join(SQL[n].replace(" AS (", " AS MATERIALIZED (", 1) for n in want) + ("\n" if body.lstrip().upper().startswith("SELECT") else ",\n") + body.strip()
