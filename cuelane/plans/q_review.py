"""Queries over batches, edits and progress, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cuelane.operators import batching as bt
from cuelane.operators import review as rv
from cuelane.operators.timeline import clip_name
from cuelane.plans import fixtures as fx
from cuelane.plans.fixtures import oracle
from cuelane.plans.q_qc import _STAMP

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_NAME = _STAMP.format("start_ms", "-", "-") + " || '_' || " + _STAMP.format("end_ms", "-", "-")
_CLIPS = f"ck AS (SELECT media_id, {_NAME} AS stem, seg_idx FROM segments WHERE seg_idx % 3 <> 2)"


def _clips(spark, d, times=None):
    return (fx.segments(spark, d) if times is None else times).where("seg_idx % 3 <> 2").select("media_id", clip_name(F.col("start_ms"), F.col("end_ms")).alias("stem"), "seg_idx")


def _done(spark, d):
    return fx.segments(spark, d).where("seg_idx % 4 = 1").select("media_id", "seg_idx", F.concat(F.lit("t:"), "text").alias("translated_text"))


@query("p7_pending_segments", oracle("segments", "SELECT media_id, seg_idx, text, seg_idx AS original_index FROM segments WHERE trim(text) <> '' AND seg_idx % 4 <> 1"))
def p7(spark, d):
    return bt.pending_segments(fx.segments(spark, d), _done(spark, d)).select("media_id", "seg_idx", "text", "original_index")


@query("p8_untranslated_segments", oracle("segments", "SELECT media_id, seg_idx, text FROM segments WHERE trim(text) <> '' AND trim(coalesce(translated_text, '')) = ''"))
def p8(spark, d):
    return bt.untranslated_segments(fx.segments(spark, d)).select("media_id", "seg_idx", "text")


@query("p9_synthesis_ready", oracle("segments", "SELECT media_id, seg_idx, rank FROM (SELECT media_id, seg_idx, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, seg_idx) AS rank FROM segments WHERE trim(coalesce(translated_text, '')) <> '') WHERE rank <= 20"))
def p9(spark, d):
    return bt.synthesis_ready(fx.segments(spark, d), 20).select("media_id", "seg_idx", "rank")


@query("p9_translates_fallback", oracle("segments", "x AS (SELECT *, CASE WHEN seg_idx % 3 = 0 THEN 'old ' || seg_idx END AS other FROM segments), y AS (SELECT *, CASE WHEN trim(coalesce(translated_text, '')) = '' THEN other ELSE translated_text END AS t FROM x) SELECT media_id, seg_idx, trim(coalesce(translated_text, '')) = '' AS fell_back, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, seg_idx) AS rank FROM y WHERE trim(coalesce(t, '')) <> ''"))
def p9_fallback(spark, d):
    s = fx.segments(spark, d).withColumn("translates_text", F.when(F.col("seg_idx") % 3 == 0, F.concat(F.lit("old "), "seg_idx")))
    return bt.synthesis_ready(s).select("media_id", "seg_idx", F.col("translated_text").startswith("old ").alias("fell_back"), "rank")


@query("p12_merge_translations", oracle("segments", "SELECT media_id, seg_idx, CASE WHEN seg_idx % 4 = 1 THEN 't:' || text ELSE '' END AS translated_text, 'm1' AS model, 'en-hu' AS pair FROM segments"))
def p12(spark, d):
    return bt.merge_translations(fx.segments(spark, d), _done(spark, d), "m1", "en-hu").select("media_id", "seg_idx", "translated_text", "model", "pair")


@query("b1_smart_batches", oracle("segments", """k AS MATERIALIZED (SELECT media_id, seg_idx, start_ms, end_ms, text, row_number() OVER w - 1 AS k, start_ms - lag(end_ms) OVER w AS gap, count(*) OVER (PARTITION BY media_id) AS n FROM segments WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, seg_idx)),
x AS MATERIALIZED (SELECT media_id, k, CASE WHEN n - k > 50 THEN coalesce(min(CASE WHEN gap >= 5000 THEN k END) OVER f, CASE WHEN k + 100 < n THEN arg_max(k, gap * 10000000 - k) OVER f END) END AS nxt FROM k WINDOW f AS (PARTITION BY media_id ORDER BY k ROWS BETWEEN 50 FOLLOWING AND 99 FOLLOWING)),
walk AS (SELECT DISTINCT media_id, 0::BIGINT AS k FROM k UNION ALL SELECT x.media_id, x.nxt FROM walk JOIN x USING (media_id, k) WHERE x.nxt IS NOT NULL),
m AS (SELECT k.*, (count(walk.k) OVER (PARTITION BY k.media_id ORDER BY k.k) - 1)::INT AS batch_id FROM k LEFT JOIN walk ON k.media_id = walk.media_id AND k.k = walk.k)
SELECT media_id, seg_idx, start_ms, end_ms, text, batch_id, row_number() OVER (PARTITION BY media_id, batch_id ORDER BY k)::INT AS item FROM m""").replace("WITH ", "WITH RECURSIVE ", 1))
def b1(spark, d):
    return bt.smart_batches(fx.segments(spark, d).select("media_id", "seg_idx", "start_ms", "end_ms", "text"))


_IT = "it AS (SELECT media_id, seg_idx // 40 AS batch_id, seg_idx % 40 + 1 AS item, text, start_ms, end_ms, seg_idx FROM segments)"


def _items(spark, d):
    return fx.segments(spark, d).select("media_id", F.expr("seg_idx div 40").cast("int").alias("batch_id"), (F.col("seg_idx") % 40 + 1).alias("item"), "text", "start_ms", "end_ms", "seg_idx")


@query("b2_numbered_prompt", oracle("segments", _IT + " SELECT media_id, batch_id, count(*) AS n, string_agg(item || '. ' || text, chr(10) ORDER BY item) AS prompt FROM it GROUP BY ALL"))
def b2(spark, d):
    return bt.numbered_prompt(_items(spark, d))


_TS = lambda c: _STAMP.format(c, ":", ".")


@query("b2_timed_prompt", oracle("segments", "x AS (SELECT *, (seg_idx // 40)::INT AS batch_id, row_number() OVER (PARTITION BY media_id, seg_idx // 40 ORDER BY seg_idx) AS item FROM segments) SELECT media_id, batch_id, count(*) AS n, string_agg(item || '. [' || " + _TS("start_ms") + " || ' – ' || " + _TS("end_ms") + " || '] ' || replace(trim(text), chr(10), ' '), chr(10) ORDER BY item) AS prompt FROM x GROUP BY ALL"))
def b2_timed(spark, d):
    s = fx.segments(spark, d).withColumn("batch_id", F.expr("seg_idx div 40").cast("int"))
    return bt.timed_prompt(s.withColumn("item", F.row_number().over(W.partitionBy("media_id", "batch_id").orderBy("seg_idx"))))


@query("b2_subtitle_prompt", oracle("srt", "SELECT media_id, ord // 15 AS batch_id, string_agg(entry_id || '# [' || " + _TS("start_ms") + " || ' – ' || " + _TS("end_ms") + " || '] ' || text, chr(10) ORDER BY ord) AS prompt FROM srt GROUP BY ALL"))
def b2_subtitles(spark, d):
    return bt.subtitle_prompt(fx.srt(spark, d).withColumn("batch_id", F.expr("ord div 15").cast("int")))


def _answers(spark, d):
    i = _items(spark, d)
    p = bt.numbered_prompt(i.where("NOT (batch_id % 5 = 2 AND item = 3)").withColumn("text", F.concat(F.lit("u "), "text"))).withColumnRenamed("prompt", "answer").drop("n")
    return i.groupBy("media_id", "batch_id").agg(F.count("*").alias("n")).join(p, ["media_id", "batch_id"])


@query("b3_parse_numbered_answer", oracle("segments", _IT + """, n AS (SELECT media_id, batch_id, count(*) FILTER (batch_id % 5 = 2 AND item = 3) AS lost FROM it GROUP BY ALL) SELECT media_id, batch_id, item, 'u ' || text AS line FROM it JOIN n USING (media_id, batch_id) WHERE lost = 0 AND media_id IN (SELECT media_id FROM it GROUP BY media_id) AND doc_ok(text)""").replace(" AND doc_ok(text)", "").replace(" AND media_id IN (SELECT media_id FROM it GROUP BY media_id)", ""))
def b3(spark, d):
    return bt.parse_numbered_answer(_answers(spark, d))


@query("b4_bisect_rejected", oracle("segments", _IT + """, n AS (SELECT *, count(*) OVER (PARTITION BY media_id, batch_id) AS n FROM it WHERE batch_id % 5 IN (0, 2))
SELECT media_id, item, n = 1 AS failed, CASE WHEN n = 1 THEN batch_id::VARCHAR WHEN item <= n // 2 THEN batch_id || '-A' ELSE batch_id || '-B' END AS next_label, CASE WHEN n = 1 OR item <= n // 2 THEN item ELSE item - n // 2 END AS next_item FROM n"""))
def b4(spark, d):
    i = _items(spark, d).where("batch_id % 5 IN (0, 2)")
    n = i.groupBy("media_id", "batch_id").agg(F.count("*").alias("n"))
    return bt.bisect_rejected(i.join(n, ["media_id", "batch_id"]).withColumn("label", F.col("batch_id").cast("string"))).select("media_id", "item", "failed", "next_label", "next_item")


@query("b4_bisect_rounds", oracle("segments", """it AS MATERIALIZED (SELECT media_id, (seg_idx // 100)::INT AS batch_id, row_number() OVER (PARTITION BY media_id, seg_idx // 100 ORDER BY seg_idx) AS item, text, (seg_idx * 7 + length(text)) % 23 = 0 AS bad FROM segments),
node(media_id, batch_id, label, lo, hi, depth, refused) AS (SELECT media_id, batch_id, batch_id::VARCHAR, 1::BIGINT, max(item), 0, bool_or(bad) FROM it GROUP BY media_id, batch_id
 UNION ALL SELECT media_id, batch_id, label, min(item), max(item), depth, bool_or(bad) FROM (SELECT i.media_id, i.batch_id, i.item, i.bad, n.depth + 1 AS depth, n.label || CASE WHEN i.item < n.lo + (n.hi - n.lo + 1) // 2 THEN '-A' ELSE '-B' END AS label
  FROM node n JOIN it i ON i.media_id = n.media_id AND i.batch_id = n.batch_id AND i.item BETWEEN n.lo AND n.hi WHERE n.refused AND n.hi > n.lo) GROUP BY media_id, batch_id, label, depth)
SELECT i.media_id, i.batch_id, i.item::INT AS item, n.label, n.depth, CASE WHEN NOT n.refused THEN upper(i.text) END AS line, n.refused AS failed FROM node n JOIN it i ON i.media_id = n.media_id AND i.batch_id = n.batch_id AND i.item BETWEEN n.lo AND n.hi WHERE NOT (n.refused AND n.hi > n.lo)""").replace("WITH ", "WITH RECURSIVE ", 1).replace("upper(i.text)", "'t ' || i.text"))
def b4_rounds(spark, d):
    """Batches of up to 100 segments; a part with an item that is refused gets no answer."""
    s = fx.segments(spark, d).select("media_id", F.expr("seg_idx div 100").cast("int").alias("batch_id"), "seg_idx", "text")
    i = s.withColumn("item", F.row_number().over(W.partitionBy("media_id", "batch_id").orderBy("seg_idx"))).withColumn("bad", (F.col("seg_idx") * 7 + F.length("text")) % 23 == 0)
    ask = lambda open_: open_.withColumn("refused", F.max("bad").over(W.partitionBy("media_id", "label"))).where("NOT refused").select("media_id", "label", "item", F.concat(F.lit("t "), "text").alias("line"))
    return bt.bisect_until_done(i.drop("seg_idx"), ask, keep=["media_id", "batch_id", "item"]).select("media_id", "batch_id", "item", "label", "depth", "line", "failed")


@query("b5_glossary_hint", """WITH g AS (SELECT p_size AS glossary_id, p_partkey AS pos, CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE p_name END AS term, p_type AS translation FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY glossary_id ORDER BY pos) AS rn FROM g WHERE trim(term) <> '' AND trim(translation) <> '')
SELECT glossary_id, string_agg(trim(term) || ' -> ' || trim(translation), '; ' ORDER BY rn) AS hint FROM r WHERE rn <= 20 GROUP BY 1""")
def b5(spark, d):
    p = fx.table(spark, d, "part").select(F.col("p_size").alias("glossary_id"), F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 7 == 0, " ").otherwise(F.col("p_name")).alias("term"), F.col("p_type").alias("translation"))
    return bt.glossary_hint(p)


@query("b6_block_translation_join", oracle("segments", "SELECT media_id, seg_idx + 1 AS item, 'u ' || text AS line FROM segments s WHERE (SELECT count(*) FROM segments x WHERE x.media_id = s.media_id) % 3 <> 1 AND text <> ''"))
def b6(spark, d):
    s = fx.segments(spark, d).select("media_id", (F.col("seg_idx") + 1).alias("item"), "text")
    a = s.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("item", "text"))).alias("x")).select("media_id", F.array_join(F.transform("x", lambda t: F.concat(F.lit("u "), t["text"])), "\n").alias("answer"), F.size("x").alias("n"))
    a = a.withColumn("answer", F.when(F.col("n") % 3 == 1, F.concat("answer", F.lit("\nmore"))).otherwise(F.col("answer")))
    return bt.block_translation_join(s, a).select("media_id", "item", "line")


@query("j10_context_entries", oracle("segments srt", _IT + """, bw AS (SELECT media_id, batch_id, min(start_ms) AS b0, max(end_ms) AS b1 FROM it GROUP BY ALL), sr AS (SELECT media_id, entry_id, start_ms, end_ms FROM srt),
c AS (SELECT bw.media_id, batch_id, entry_id, greatest(b0 - end_ms, start_ms - b1) AS need FROM bw JOIN sr USING (media_id)),
r AS (SELECT *, CASE WHEN need < 6000 THEN 1 WHEN need < 10800 THEN 2 WHEN need < 19440 THEN 3 WHEN need < 34992 THEN 4 ELSE 5 END AS rung FROM c),
l AS (SELECT *, min(rung) OVER (PARTITION BY media_id, batch_id) AS low FROM r) SELECT media_id, batch_id, entry_id FROM l WHERE rung = low"""))
def j10(spark, d):
    b = _items(spark, d).groupBy("media_id", "batch_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return bt.context_entries(b, fx.srt(spark, d))


@query("j10_context_classes", oracle("segments srt", _IT + """, bw AS (SELECT media_id, batch_id, min(start_ms) AS b0, max(end_ms) AS b1 FROM it GROUP BY ALL), sr AS (SELECT media_id, entry_id, start_ms, end_ms FROM srt WHERE ord % 40 = 0),
c AS (SELECT bw.media_id, batch_id, entry_id, greatest(b0 - end_ms, start_ms - b1) AS need FROM bw JOIN sr USING (media_id)),
r AS (SELECT *, CASE WHEN need < 6000 THEN 1 WHEN need < 10800 THEN 2 WHEN need < 19440 THEN 3 WHEN need < 34992 THEN 4 ELSE 5 END AS rung FROM c),
l AS MATERIALIZED (SELECT *, min(rung) OVER (PARTITION BY media_id, batch_id) AS low FROM r)
SELECT media_id, batch_id, entry_id, false AS whole FROM l WHERE rung = low AND low < 5 UNION ALL SELECT media_id, batch_id, NULL, true FROM bw WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.media_id = bw.media_id AND l.batch_id = bw.batch_id AND low < 5)"""))
def j10_classes(spark, d):
    b = _items(spark, d).groupBy("media_id", "batch_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return bt.context_classes(b, fx.srt(spark, d).where("ord % 40 = 0"))


@query("j14_choose_alignment", oracle("segments", _IT + """, x AS (SELECT *, CASE WHEN (batch_id + item) % (2 + length(media_id) % 4) = 0 THEN text ELSE '' END AS by_time, 'm:' || text AS by_model, 's:' || text AS by_share, length(media_id) % 5 = 0 AS model_ok FROM it),
c AS (SELECT *, avg(CASE WHEN trim(by_time) = '' THEN 0.0 ELSE 1.0 END) OVER (PARTITION BY media_id, batch_id) AS cov FROM x), t AS (SELECT *, CASE WHEN model_ok THEN by_model WHEN cov >= 0.4 THEN by_time ELSE by_share END AS t FROM c)
SELECT media_id, batch_id, item, CASE WHEN trim(t) = '' AND cov < 0.6 THEN by_share ELSE t END AS text FROM t"""))
def j14(spark, d):
    i = _items(spark, d)
    x = i.withColumn("by_time", F.expr("CASE WHEN (batch_id + item) % (2 + length(media_id) % 4) = 0 THEN text ELSE '' END")).withColumn("by_model", F.concat(F.lit("m:"), "text")).withColumn("by_share", F.concat(F.lit("s:"), "text")).withColumn("model_ok", F.length("media_id") % 5 == 0)
    return bt.choose_alignment(x).select("media_id", "batch_id", "item", "text")


@query("j15_parse_alignment_answer", oracle("segments", _IT + " SELECT media_id, batch_id, item, trim(text) AS text FROM it WHERE (batch_id + length(media_id)) % 7 <> 3 QUALIFY NOT bool_or(trim(text) = '') OVER (PARTITION BY media_id, batch_id)"))
def j15(spark, d):
    i = _items(spark, d).withColumn("k", F.when(((F.col("batch_id") + F.length("media_id")) % 7 == 3) & (F.col("item") == 1), 99).otherwise(F.col("item")))
    a = i.groupBy("media_id", "batch_id").agg(F.count("*").alias("n"), F.concat(F.lit("Here it is: "), F.to_json(F.array_sort(F.collect_list(F.struct(F.col("k").alias("index"), "text")))), F.lit(" done")).alias("answer"))
    return bt.parse_alignment_answer(a)


@query("b7_apply_updates", oracle("edits", """s AS MATERIALIZED (SELECT media_id, seg_idx, start_ms AS s0, end_ms AS s1, lag(end_ms) OVER w AS pe, lead(start_ms) OVER w AS ns FROM segments WINDOW w AS (PARTITION BY media_id ORDER BY seg_idx)),
r AS MATERIALIZED (SELECT e.media_id, e.seg_idx, e.start_ms, e.end_ms, s0, s1, e.text AS x1, CASE WHEN seg_idx % 2 = 0 THEN 'edit: ' || seg_idx END AS y1, CASE WHEN e.start_ms < 0 THEN 'negative' WHEN e.start_ms >= e.end_ms THEN 'empty' WHEN e.start_ms < pe THEN 'overlaps previous' WHEN e.end_ms > ns THEN 'overlaps next' END AS reason FROM edits e JOIN s USING (media_id, seg_idx) WHERE op = 'update'),
tr AS (SELECT * REPLACE (CASE WHEN translated_text IS NOT NULL THEN 't: ' || text END AS translated_text) FROM segments) SELECT s.media_id, s.seg_idx, CASE WHEN ok THEN r.start_ms ELSE s.start_ms END AS start_ms, CASE WHEN ok THEN r.end_ms ELSE s.end_ms END AS end_ms, CASE WHEN ok THEN coalesce(x1, s.text) ELSE s.text END AS text, CASE WHEN ok THEN coalesce(y1, s.translated_text) ELSE s.translated_text END AS translated_text, reason,
 coalesce(ok AND (r.start_ms <> s.start_ms OR r.end_ms <> s.end_ms OR coalesce(x1 <> s.text, x1 IS NOT NULL) OR coalesce(y1 <> s.translated_text, y1 IS NOT NULL)), false) AS changed
FROM tr s LEFT JOIN (SELECT *, reason IS NULL AS ok FROM r) r USING (media_id, seg_idx)"""))
def b7(spark, d):
    s = fx.segments(spark, d).select("media_id", "seg_idx", "start_ms", "end_ms", "text", F.when(F.col("translated_text").isNotNull(), F.concat(F.lit("t: "), "text")).alias("translated_text"))
    checked = rv.apply_updates(s, fx.edits(spark, d).withColumn("translated_text", F.when(F.col("seg_idx") % 2 == 0, F.concat(F.lit("edit: "), "seg_idx"))))
    out = rv.updated_segments(s, checked).join(checked.select("media_id", "seg_idx", "reason", "changed"), ["media_id", "seg_idx"], "left")
    return out.withColumn("changed", F.coalesce("changed", F.lit(False)))


_INS = """ins AS (SELECT e.media_id, e.seg_idx, e.start_ms, e.end_ms, e.text, min(CASE WHEN e.start_ms >= s.start_ms AND e.end_ms <= s.end_ms THEN 1 WHEN e.start_ms <= s.start_ms AND e.end_ms >= s.end_ms THEN 2 WHEN e.start_ms >= s.start_ms THEN 3 ELSE 4 END) FILTER (s.media_id IS NOT NULL) AS rule
 FROM edits e LEFT JOIN segments s ON s.media_id = e.media_id AND s.start_ms < e.end_ms AND s.end_ms > e.start_ms WHERE op = 'insert' GROUP BY ALL)"""


@query("b8_apply_inserts", oracle("edits", _INS + """, al AS (SELECT media_id, start_ms, end_ms, text FROM segments UNION ALL SELECT media_id, start_ms, end_ms, text FROM ins WHERE rule IS NULL AND end_ms > start_ms)
SELECT *, (row_number() OVER (PARTITION BY media_id ORDER BY start_ms, end_ms) - 1)::INT AS seg_idx FROM al"""))
def b8(spark, d):
    s, e = fx.segments(spark, d), fx.edits(spark, d)
    return rv.inserted_segments(s, rv.apply_inserts(s, e), e)


@query("b9_apply_deletes", oracle("edits", """k AS (SELECT media_id, seg_idx AS old_idx, text FROM segments s WHERE NOT EXISTS (SELECT 1 FROM edits e WHERE e.op = 'delete' AND e.media_id = s.media_id AND e.seg_idx = s.seg_idx))
SELECT media_id, old_idx, text, (row_number() OVER (PARTITION BY media_id ORDER BY old_idx) - 1)::INT AS seg_idx, NULL::VARCHAR AS reason FROM k
UNION ALL SELECT media_id, -seg_idx - 1, NULL, NULL, 'no such segment' FROM edits WHERE op = 'delete'"""))
def b9(spark, d):
    s, e = fx.segments(spark, d), fx.edits(spark, d)
    e = e.unionByName(e.where("op = 'delete'").withColumn("seg_idx", -F.col("seg_idx") - 1))
    rejected = rv.check_deletes(s, e).where("reason IS NOT NULL").select("media_id", F.col("seg_idx").alias("old_idx"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("seg_idx"), "reason")
    return rv.apply_deletes(s, e).select("media_id", "old_idx", "text", "seg_idx", F.lit(None).cast("string").alias("reason")).unionByName(rejected)


@query("b10_invalidate_clips", oracle("edits", _CLIPS + f", gone AS (SELECT DISTINCT media_id, seg_idx FROM edits WHERE op = 'delete'), w AS (SELECT DISTINCT media_id, {_NAME} AS stem FROM segments JOIN gone USING (media_id, seg_idx)) SELECT media_id, stem, seg_idx FROM ck JOIN w USING (media_id, stem)"))
def b10(spark, d):
    s = fx.segment_times(spark, d)
    e = fx.edits(spark, d, s)
    return rv.invalidate_clips(s.join(e.where("op = 'delete'").select("media_id", "seg_idx"), ["media_id", "seg_idx"], "left_semi"), _clips(spark, d, s))


@query("j16_segment_has_clip", oracle("segments", "SELECT media_id, seg_idx, seg_idx % 3 <> 2 AS has_clip FROM segments"))
def j16(spark, d):
    s = fx.segment_times(spark, d)
    return rv.segment_has_clip(s, _clips(spark, d, s)).select("media_id", "seg_idx", "has_clip")


@query("j17_failed_resolved", oracle("segments", f"x AS (SELECT media_id, {_NAME} AS stem, seg_idx FROM segments WHERE seg_idx % 2 = 0) SELECT media_id, stem, CASE WHEN seg_idx % 3 <> 2 THEN 'resolved' ELSE 'movable' END AS state FROM x WHERE seg_idx % 3 <> 2 OR seg_idx % 4 = 0"))
def j17(spark, d):
    f = fx.segments(spark, d).where("seg_idx % 2 = 0").select("media_id", clip_name(F.col("start_ms"), F.col("end_ms")).alias("stem"), F.when(F.col("seg_idx") % 4 == 0, "x.WAV").otherwise("x.txt").alias("file_name"))
    a, b = rv.failed_resolved(f, _clips(spark, d))
    return a.select("media_id", "stem", F.lit("resolved").alias("state")).unionByName(b.select("media_id", "stem", F.lit("movable").alias("state")))


@query("j18_prefer_translated", "SELECT 'd' || doc_id AS file_name, n_chars AS size, CASE WHEN doc_id % 3 = 0 THEN 'translated' ELSE 'speech' END AS origin FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0")
def j18(spark, d):
    f = fx.table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("file_name"), F.col("n_chars").alias("size"), "doc_id")
    return rv.prefer_translated(f.where("doc_id % 3 = 0").drop("doc_id"), f.where("doc_id % 2 = 0").drop("doc_id"))


@query("j19_match_audio", "SELECT 'd' || doc_id AS stem, CASE WHEN doc_id % 4 = 0 THEN 'd' || doc_id || '.wav' WHEN doc_id % 4 = 1 THEN 'd' || doc_id || '.MP3' END AS file_name FROM documents")
def j19(spark, d):
    t = fx.table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("stem"), (F.col("doc_id") % 4).alias("k"))
    ext = F.when(F.col("k") == 0, F.array(F.lit("flac"), F.lit("wav"), F.lit("mp3"))).when(F.col("k") == 1, F.array(F.lit("ogg"), F.lit("MP3"))).otherwise(F.array(F.lit("txt")))
    return rv.match_audio(t, t.select("stem", F.explode(ext).alias("e")).select(F.concat("stem", F.lit("."), "e").alias("file_name")))


@query("j20_promote_failed_clip", oracle("segments", f"SELECT media_id, {_NAME} AS target, seg_idx % 3 <> 2 AS conflict FROM segments WHERE seg_idx % 5 = 0"))
def j20(spark, d):
    f = fx.segments(spark, d).where("seg_idx % 5 = 0").select("media_id", F.concat(clip_name(F.col("start_ms"), F.col("end_ms")), F.lit("_attempt_"), "seg_idx").alias("stem"))
    return rv.promote_failed_clip(f, _clips(spark, d)).select("media_id", "target", "conflict")


_PROG = """pr AS (SELECT media_id, count(*) AS total, count(*) FILTER (trim(text) <> '') AS expected, count(*) FILTER (trim(text) <> '' AND trim(coalesce(translated_text, '')) <> '') AS ready, count(*) FILTER (seg_idx % 3 <> 2) AS completed, count(*) FILTER (seg_idx % 3 <> 2) AS n_clips,
 greatest(0, count(*) FILTER (trim(text) <> '') - count(*) FILTER (seg_idx % 3 <> 2)) AS missing FROM segments GROUP BY 1)"""


@query("a1_split_progress", oracle("segments", _PROG + " SELECT * FROM pr"))
def a1(spark, d):
    return rv.split_progress(fx.segments(spark, d), _clips(spark, d))


@query("a2_retry_gate", oracle("segments", _PROG + " SELECT media_id, missing, CASE WHEN missing > 3 THEN 'retry' ELSE 'continue' END AS gate FROM pr"))
def a2(spark, d):
    return rv.retry_gate(rv.split_progress(fx.segments(spark, d), _clips(spark, d)), 3).select("media_id", "missing", "gate")
