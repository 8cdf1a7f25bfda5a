"""Queries over payloads, subtitles, normalisation and streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cuelane.functions import hungarian as hu
from cuelane.functions import normalise as nm
from cuelane.functions import phonemes as ph
from cuelane.functions import rules as rl
from cuelane.operators import segment as sg
from cuelane.operators.timeline import stamp
from cuelane.plans import fixtures as fx
from cuelane.plans.fixtures import oracle
from cuelane.plans.q_qc import _STAMP
from cuelane.sources import transcripts as tr
from cuelane.streaming import streams as st

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query("s1_read_transcripts", oracle("words", "SELECT media_id, input_pos, word, start_ms / 1000.0 AS start, speaker FROM words"))
def s1(spark, d):
    w = fx.words(spark, d)
    words = F.transform(F.array_sort(F.collect_list(F.struct("input_pos", "word", (F.col("start_ms") / 1000).alias("start"), "speaker"))), lambda x: F.struct(x["word"].alias("word"), x["start"].alias("start"), x["speaker"].alias("speaker")))
    g = w.groupBy("media_id", "doc_id").agg(words.alias("ws"))
    k = F.col("doc_id") % 3
    payload = F.when(k == 0, F.to_json(F.struct(F.col("ws").alias("words")))).when(k == 1, F.to_json(F.struct(F.col("ws").alias("word_segments")))).otherwise(F.to_json(F.struct(F.array(F.struct(F.slice("ws", 1, 3).alias("words")), F.struct(F.slice("ws", 4, 1_000_000).alias("words"))).alias("segments"))))
    return tr.payload_words(g.select("media_id", payload.alias("payload"))).select("media_id", "input_pos", "word", "start", "speaker")


def _srt_files(spark, d):
    s = fx.srt(spark, d)
    t = lambda c: stamp(F.col(c), ":", ",")
    block = F.concat(F.col("entry_id").cast("string"), F.lit("\n"), t("start_ms"), F.when(F.col("ord") % 10 == 7, " -> ").otherwise(" --> "), t("end_ms"), F.lit("\n<i>"), "text", F.lit("</i>"))
    return s.withColumn("block", block).groupBy("media_id").agg(sg.joined("block", "ord", "\n\n").alias("content"))


@query("s2_read_srt", oracle("srt", "SELECT media_id, ord, entry_id, start_ms, end_ms, trim(regexp_replace(text, '<[^>]*>', '', 'g')) AS text FROM srt WHERE ord % 10 <> 7"))
def s2(spark, d):
    return tr.parse_srt(_srt_files(spark, d))


@query("s3_clean_subtitles", "SELECT page_id, trim(replace(regexp_replace(regexp_replace(regexp_replace(html, '\\{[^}]*\\}', '', 'g'), '<[^>]*>', '', 'g'), '\\[[^\\]]*\\]', '', 'g'), chr(10), ' ')) AS text FROM pages")
def s3(spark, d):
    return fx.table(spark, d, "pages").select("page_id", tr.clean_subtitles(F.col("html")).alias("text"))


@query("s4_pick_context_srt", "WITH f AS (SELECT source AS media_id, 'x' || doc_id || '_' || CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END || '.srt' AS path, n_chars AS length FROM documents WHERE lang = 'de') SELECT media_id, arg_max(path, (length, path)) AS path FROM f GROUP BY 1")
def s4(spark, d):
    f = fx.table(spark, d, "documents").select(F.col("source").alias("media_id"), F.concat(F.lit("x"), "doc_id", F.lit("_"), F.when(F.col("doc_id") % 2 == 0, F.upper("lang")).otherwise(F.col("lang")), F.lit(".srt")).alias("path"), F.col("n_chars").alias("length"))
    return tr.pick_context_srt(f, "DE")


@query("s5_write_words_srt", oracle("words", "x AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, input_pos) AS n FROM words WHERE input_pos % 9 <> 4) SELECT media_id, string_agg(n || chr(10) || " + _STAMP.format("start_ms", ":", ",") + " || ' --> ' || " + _STAMP.format("end_ms", ":", ",") + " || chr(10) || word || chr(10), chr(10) ORDER BY n) AS content FROM x GROUP BY 1"))
def s5(spark, d):
    return tr.words_srt(fx.words(spark, d).withColumn("end_ms", F.when(F.col("input_pos") % 9 != 4, F.col("end_ms"))))


@query("s6_srt_to_segments", oracle("srt", "SELECT media_id, ord AS seg_idx, start_ms, end_ms, ' ' || text AS text, 'SPEAKER_1' AS speaker FROM srt"))
def s6(spark, d):
    return tr.srt_to_segments(fx.srt(spark, d)).drop("words")


@query("s7_segments_to_text", oracle("segments", "SELECT media_id, string_agg(trim(text), chr(10) ORDER BY seg_idx) AS content FROM segments GROUP BY 1"))
def s7(spark, d):
    return tr.segments_to_text(fx.segments(spark, d))


@query("s8_validate_json", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false ELSE true END AS valid, CASE doc_id % 4 WHEN 1 THEN 'malformed' WHEN 2 THEN 'empty' END AS problem FROM documents")
def s8(spark, d):
    t = F.to_json(F.struct("text"))
    k = F.col("doc_id") % 4
    rows = fx.table(spark, d, "documents").select("doc_id", F.when(k == 0, t).when(k == 1, F.expr("substr(to_json(struct(text)), 1, length(to_json(struct(text))) - 2)")).when(k == 2, F.lit("  ")).otherwise(F.concat(F.lit("["), t, F.lit("]"))).alias("value"))
    return tr.validate_json(rows).select("doc_id", "valid", "problem")


@query("s9_sanitize_fields", "SELECT page_id, replace(replace(replace(html, chr(92), ''), '/', ''), '\"', '') AS text FROM pages")
def s9(spark, d):
    return tr.sanitize_fields(fx.table(spark, d, "pages").select("page_id", F.col("html").alias("text")), ("text",))


@query("s10_write_segments", oracle("segments", "SELECT media_id, seg_idx, start_ms, end_ms, text, speaker FROM segments"))
def s10(spark, d):
    at = f"{_place(spark)}/segments"
    tr.write_segments(fx.segments(spark, d), at)
    shape = "struct<segments: array<struct<seg_idx: int, start: double, end: double, text: string, speaker: string>>>"
    told = tr.segments_json(spark.read.parquet(at)).select("media_id", F.inline(F.from_json("payload", shape)["segments"]))
    return told.select("media_id", "seg_idx", F.round(F.col("start") * 1000).cast("long").alias("start_ms"), F.round(F.col("end") * 1000).cast("long").alias("end_ms"), "text", "speaker")


@query("s1_payload_files", oracle("words", "SELECT media_id, input_pos, word, start_ms / 1000.0 AS start, end_ms / 1000.0 AS \"end\", speaker, CAST(NULL AS VARCHAR) AS problem FROM words WHERE doc_id % 10 <> 3 UNION ALL SELECT DISTINCT media_id, NULL, NULL, NULL, NULL, NULL, 'malformed' FROM words WHERE doc_id % 10 = 3"))
def s1_files(spark, d):
    """One payload file per recording, every tenth cut off, written and read again."""
    at = f"{_place(spark)}/payloads"
    w = fx.words(spark, d)
    files = tr.words_json(w).join(w.select("media_id", "doc_id").distinct(), "media_id")
    tr.write_files(files.select("media_id", F.when(F.col("doc_id") % 10 == 3, F.expr("left(content, length(content) - 2)")).otherwise(F.col("content")).alias("content")), at, "gzip")
    words, bad = tr.read_payloads(spark, at)
    return words.select("media_id", "input_pos", "word", "start", "end", "speaker").unionByName(bad, allowMissingColumns=True)


@query("s5_subtitle_files", oracle("words", "x AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, input_pos) AS n, count(*) OVER (PARTITION BY media_id) AS m FROM words) SELECT media_id, n::INT AS entry_id, start_ms, end_ms, word AS text FROM x WHERE m % 2 = 0"))
def s5_files(spark, d):
    """One subtitle file per recording; those of recordings with an even number of words are picked from the listing and read again."""
    at = f"{_place(spark)}/subtitles"
    w = fx.words(spark, d)
    tr.write_files(tr.words_srt(w), at, "gzip")
    picked = tr.list_files(spark, at).where("length > 0").select("media_id")
    even = w.groupBy("media_id").count().where("count % 2 = 0").select("media_id")
    return tr.parse_srt(tr.read_files(spark, at).join(picked.join(even, "media_id").hint("shuffle_hash"), "media_id")).select("media_id", "entry_id", "start_ms", "end_ms", "text")


_EN = "'... ' || lower(trim(regexp_replace(regexp_replace(replace({0}, '&', ' and '), '(?i)\\bthe\\b', 'le', 'g'), '\\s+', ' ', 'g')))"


def _en(c):
    return nm.normalise_en(c, [("&", "and")], [("the", "le")])


@query("s11_normalisation_report", oracle("segments", "SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY seg_idx) AS \"index\", text AS original, " + _EN.format("text") + " AS normalised FROM segments WHERE trim(text) <> '' AND media_id IN (SELECT 'd' || doc_id FROM documents WHERE lang = 'en')"))
def s11(spark, d):
    en = fx.table(spark, d, "documents").where("lang = 'en'").select(F.concat(F.lit("d"), "doc_id").alias("media_id")).distinct()
    return tr.normalisation_report(fx.segments(spark, d).join(en, "media_id", "left_semi"), _en)


@query("t1_normalise_en", "SELECT doc_id, " + _EN.format("text") + " AS text FROM documents WHERE lang = 'en'")
def t1(spark, d):
    return fx.table(spark, d, "documents").where("lang = 'en'").select("doc_id", _en(F.col("text")).alias("text"))


#: Rules of the t4 query, as many as a real rule file has.
RULES = 717


@query("t4_apply_word_rules", r"""WITH RECURSIVE toks AS MATERIALIZED (SELECT r, doc_id, unnest(x) AS t, unnest(range(len(x))) AS i FROM (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS x FROM documents)),
f AS (SELECT w, row_number() OVER (ORDER BY n DESC, w) - 1 AS k FROM (SELECT lower(t) AS w, count(*) AS n FROM toks WHERE regexp_matches(t, '^[\p{L}\p{N}_]') GROUP BY 1)),
top AS MATERIALIZED (SELECT * FROM f WHERE k < 717), rules AS MATERIALIZED (SELECT a.k, a.w, b.k AS v, b.w AS value FROM top a JOIN top b ON b.k = (a.k * 7 + 3) % (SELECT count(*) FROM top)),
chain(k, step, fired, target, said) AS (SELECT k, 0, k, v, value FROM rules UNION ALL SELECT c.k, c.step + 1, r.k, r.v, r.value FROM chain c JOIN rules r ON r.k = c.target WHERE c.target > c.fired),
final AS MATERIALIZED (SELECT w, arg_max(said, step) AS said FROM chain JOIN rules USING (k) GROUP BY w)
SELECT any_value(doc_id) AS doc_id, string_agg(coalesce(said, t), '' ORDER BY i) AS text FROM toks LEFT JOIN final ON lower(t) = w GROUP BY r UNION ALL SELECT doc_id, text FROM documents WHERE text IS NULL OR text = ''""")
def t4(spark, d):
    """Every rule's value is another rule's key, so that rules chain."""
    docs = fx.table(spark, d, "documents")
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([\\p{L}\\p{N}_]+)"), 1)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    top = [r.w for r in words.orderBy(F.desc("n"), "w").limit(RULES).collect()]
    rules = [(w, top[(k * 7 + 3) % len(top)]) for k, w in enumerate(top)]
    return docs.select("doc_id", rl.rule_table(rules)(F.col("text")).alias("text"))


@query("t5_apply_force_rules", "SELECT doc_id, replace(replace(text, 'th', ' TH  '), 'er', 'R ') AS text FROM documents")
def t5(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", nm.apply_force_rules(F.col("text"), [("th", "TH", 1, 2), ("er", "R", 0, 1)]).alias("text"))


_T9 = "replace(regexp_replace('egy-egy x-y ' || html || ' két-két', '[*\"'':()/#@\\[\\]{}]', ' ', 'g'), '\t', ' ')"
for _pair, _apart in nm.DOUBLED.items():
    _T9 = f"regexp_replace({_T9}, '\\b{_pair}\\b', '{_apart}', 'g')"


@query("t9_clean_chars", f"SELECT page_id, replace(trim(regexp_replace(regexp_replace({_T9}, '-', '', 'g'), '\\s+', ' ', 'g')), 'the', 'THE') AS text FROM pages")
def t9(spark, d):
    html = F.concat(F.lit("egy-egy x-y "), "html", F.lit(" két-két"))
    return fx.table(spark, d, "pages").select("page_id", nm.clean_chars(html, [("the", "THE")]).alias("text"))


_T11 = " ".join(f"WHEN length(word) > {len(s)} AND ends_with(lower(word), '{s}') THEN left(word, length(word) - {len(s)})" for s in sorted(nm.SUFFIXES, key=len, reverse=True))


@query("t11_strip_suffix", oracle("words", f"d AS (SELECT DISTINCT word FROM words UNION SELECT DISTINCT word || '-BAN' FROM words), h AS (SELECT word, regexp_extract(trim(word), '(?i)^(.+)-({'|'.join(nm.SUFFIXES)})$', 1) AS hy FROM d) SELECT word, CASE WHEN hy <> '' THEN hy {_T11} ELSE word END AS stem FROM h"))
def t11(spark, d):
    w = fx.words(spark, d).select("word")
    w = w.unionByName(w.select(F.concat("word", F.lit("-BAN")).alias("word"))).distinct()
    return w.select("word", nm.strip_suffix(F.col("word")).alias("stem"))


# The names of letters are written out here, not taken from the code.
_NAMES = "a:a b:bé c:cé d:dé e:e f:ef g:gé h:há i:í j:jé k:ká l:el m:em n:en o:ó p:pé q:kú r:er s:ess t:té u:ú v:vé w:dupla_vé x:iksz y:ipszilon z:zé".split(" ")
_NAMED = "CASE lower({0}) " + " ".join("WHEN '{}' THEN '{}'".format(*x.replace("_", " ").split(":")) for x in _NAMES) + " ELSE {0} END"


@query("t13_spell_letters", "WITH l AS (SELECT DISTINCT p_brand FROM part), c AS (SELECT p_brand, unnest(string_split(p_brand, '')) AS c, unnest(range(length(p_brand))) AS i FROM l) SELECT p_brand, string_agg(" + _NAMED.format("c") + ", ' ' ORDER BY i) AS spelt FROM c GROUP BY 1")
def t13(spark, d):
    return fx.table(spark, d, "part").select("p_brand").distinct().select("p_brand", nm.spell_letters(F.col("p_brand")).alias("spelt"))


@query("t13_spell_acronyms", "WITH d AS (SELECT c_custkey, upper(c_mktsegment) AS a, c_name FROM customer), c AS (SELECT c_custkey, unnest(string_split(a, '')) AS c, unnest(range(length(a))) AS i FROM d), s AS (SELECT c_custkey, string_agg(" + _NAMED.format("c") + ", ' ' ORDER BY i) AS said FROM c GROUP BY 1) SELECT c_custkey, 'Az ' || said || '-nak XIV DC ' || c_name || ' Ab' AS text FROM d JOIN s USING (c_custkey)")
def t13_acronyms(spark, d):
    c = fx.table(spark, d, "customer")
    return c.select("c_custkey", nm.spell_acronyms(F.concat(F.lit("Az "), F.upper("c_mktsegment"), F.lit("-nak XIV DC "), "c_name", F.lit(" Ab"))).alias("text"))


def _values(table: dict[str, str]) -> str:
    return "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in table.items()) + ")"


_T12 = "said"
for _old, _new in ph.SEQUENCES.items():
    _T12 = f"regexp_replace({_T12}, '{_old}', '{_new}', 'g')"
_T12 = f"lower({_T12})"
for _old, _new in ph.LEFT_OVER.items():
    _T12 = f"replace({_T12}, '{_old}', '{_new}')"


@query("t12_phonemes_to_hu", oracle("words", f"""d AS (SELECT DISTINCT word, translate(word, 'ehr', 'əʃɹ') AS w FROM words),
c AS (SELECT word, w, i, substring(w, i::INT, 1) AS c FROM (SELECT word, w, unnest(range(1, length(w) + 1)) AS i FROM d)),
t AS (SELECT word, i, CASE WHEN i % 6 = 0 OR c IN ('', 'ˈ', 'ˌ', '.') THEN '' WHEN (i + length(w)) % 4 = 0 THEN replace(c, '|', '') || ':' ELSE replace(c, '|', '') END AS t FROM c),
p AS (SELECT t.*, v.new AS pair FROM (SELECT *, t || ' ' || lead(t) OVER (PARTITION BY word ORDER BY i) AS two FROM t) t LEFT JOIN {_values(ph.PAIRS)} v(old, new) ON two = old),
k AS (SELECT *, row_number() OVER (PARTITION BY word, run ORDER BY i) AS nth FROM (SELECT *, count(*) FILTER (pair IS NULL) OVER (PARTITION BY word ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM p)),
taken AS (SELECT *, pair IS NOT NULL AND nth % 2 = 1 AS takes FROM k), o AS (SELECT *, coalesce(lag(takes) OVER (PARTITION BY word ORDER BY i), false) AS gone FROM taken),
s AS (SELECT DISTINCT t, rtrim(t, ':') AS short FROM t), one AS (SELECT t, coalesce(a.new, CASE WHEN t LIKE '%:' THEN coalesce(l.new, b.new || right(b.new, 1)) END, e.new, replace(t, ':', '')) AS spelt FROM s LEFT JOIN {_values(ph.SINGLE)} a(old, new) ON a.old = t LEFT JOIN {_values(ph.SINGLE)} l(old, new) ON l.old = short || ':' LEFT JOIN {_values(ph.SINGLE)} b(old, new) ON b.old = short LEFT JOIN {_values(ph.SINGLE)} e(old, new) ON e.old = lower(t)),
j AS (SELECT word, string_agg(CASE WHEN takes THEN pair ELSE spelt END, '' ORDER BY i) FILTER (NOT gone) AS said FROM o JOIN one USING (t) GROUP BY word) SELECT word, CASE WHEN said <> '' THEN {_T12} END AS spelling FROM j"""))
def t12(spark, d):
    w = fx.words(spark, d).select("word").distinct().withColumn("w", F.translate("word", "ehr", "əʃɹ"))
    sound = lambda i: F.substring(F.col("w"), i, F.lit(1))
    tokens = F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.when(i % 6 == 0, "ˈ").when((i + F.length("w")) % 4 == 0, F.when(sound(i).isin("ˈ", "ˌ", "."), sound(i)).otherwise(F.concat(sound(i), F.lit("ː")))).otherwise(sound(i)))
    return w.select("word", ph.phonemes_to_hu(tokens).alias("spelling"))


@query("t2_roman_before_dot", r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS t FROM documents WHERE text IS NOT NULL AND text <> ''),
x AS MATERIALIZED (SELECT r, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM (SELECT r, regexp_extract_all(t, '[IVXLCDM]+\.?|[^IVXLCDM]+') AS ps FROM d)),
l AS (SELECT p, i, CASE substr(p, i, 1) WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 WHEN 'M' THEN 1000 END AS v FROM (SELECT p, unnest(range(1, length(p))) AS i FROM (SELECT DISTINCT p FROM x WHERE regexp_matches(p, '^[IVXLCDM]+\.$')))),
n AS (SELECT p, sum(CASE WHEN after > v THEN -v ELSE v END)::BIGINT || '.' AS said FROM (SELECT *, lead(v) OVER (PARTITION BY p ORDER BY i) AS after FROM l) GROUP BY p),
o AS (SELECT r, string_agg(coalesce(said, x.p), '' ORDER BY i) AS arabic FROM x LEFT JOIN n ON x.p = n.p GROUP BY r)
SELECT doc_id, arabic FROM d JOIN o USING (r) UNION ALL SELECT doc_id, text FROM documents WHERE text IS NULL OR text = ''""")
def t2(spark, d):
    s = fx.table(spark, d, "documents").select("doc_id", F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("text"))
    return nm.roman_before_dot(s).select("doc_id", "arabic")


# Hungarian number words below a million, from the words of digits and tens.
_HU_WORDS = """u(d, w) AS (VALUES (0, ''), (1, 'egy'), (2, 'kettő'), (3, 'három'), (4, 'négy'), (5, 'öt'), (6, 'hat'), (7, 'hét'), (8, 'nyolc'), (9, 'kilenc')),
t(d, w, j) AS (VALUES (0, '', ''), (1, 'tíz', 'tizen'), (2, 'húsz', 'huszon'), (3, 'harminc', 'harminc'), (4, 'negyven', 'negyven'), (5, 'ötven', 'ötven'), (6, 'hatvan', 'hatvan'), (7, 'hetven', 'hetven'), (8, 'nyolcvan', 'nyolcvan'), (9, 'kilencven', 'kilencven')),
hu AS MATERIALIZED (SELECT h.d * 100 + t.d * 10 + u.d AS n, CASE h.d WHEN 0 THEN '' WHEN 1 THEN 'száz' WHEN 2 THEN 'kétszáz' ELSE h.w || 'száz' END || CASE u.d WHEN 0 THEN t.w ELSE t.j || u.w END AS w FROM u h, t, u)"""


def _hu(n: str) -> str:
    """SQL of the words of a number below a million."""
    of = lambda x: f"(SELECT w FROM hu WHERE hu.n = {x})"
    return f"CASE WHEN {n} = 0 THEN 'nulla' WHEN {n} < 1000 THEN {of(n)} ELSE CASE {n} // 1000 WHEN 1 THEN '' WHEN 2 THEN 'két' ELSE {of(f'({n}) // 1000')} END || 'ezer' || CASE WHEN {n} % 1000 = 0 THEN '' WHEN {n} > 2000 THEN '-' ELSE '' END || {of(f'({n}) % 1000')} END"


@query("q2_numbers_to_words", "WITH " + _HU_WORDS + " SELECT o_orderkey, 'order ' || " + _hu("o_orderkey") + " || ' by ' || " + _hu("o_custkey") + " AS spoken FROM orders")
def q2(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", F.concat_ws(" ", F.lit("order"), "o_orderkey", F.lit("by"), "o_custkey").alias("text"))
    return nm.numbers_to_words(o, "hu").select("o_orderkey", "spoken")


@query("u1_normalise_registry", "WITH " + _HU_WORDS + ", o AS (SELECT o_orderkey, o_custkey, ['en', 'hu', 'xx', NULL][o_orderkey % 4 + 1] AS lang, 'The ' || o_orderkey || ' & (' || o_custkey || ') darab' AS text FROM orders) SELECT o_orderkey, CASE lang WHEN 'en' THEN " + _EN.format("text") + " WHEN 'hu' THEN 'A ' || replace(" + _hu("o_orderkey") + ", '-', '') || ' & ' || replace(" + _hu("o_custkey") + ", '-', '') || ' darab' ELSE text END AS text FROM o")
def u1_registry(spark, d):
    """Hungarian and English in one query; an unknown and a null language change nothing."""
    o = fx.table(spark, d, "orders")
    lang = F.element_at(F.array(F.lit("en"), F.lit("hu"), F.lit("xx"), F.lit(None)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    text = F.concat(F.lit("The "), F.col("o_orderkey").cast("string"), F.lit(" & ("), F.col("o_custkey").cast("string"), F.lit(") darab"))
    return o.select("o_orderkey", nm.normalise_by_lang(text, lang, {"en": _en, "hu": hu.normaliser([("the", "A")])}).alias("text"))


@query("u1_normalise_by_lang", "SELECT doc_id, CASE WHEN lang = 'en' THEN " + _EN.format("text") + " ELSE text END AS text FROM documents")
def u1(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", nm.normalise_by_lang(F.col("text"), F.col("lang"), {"en": _en}).alias("text"))


def _event_stream(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


@query("x1_stream_qc_counters", "SELECT 'u' || (user_id % 20) AS media_id, epoch_ms(date_trunc('day', ts)) AS from_ms, count(*) AS total, count(*) FILTER (value < 50) AS successful, count(*) FILTER (NOT value < 50) AS failed FROM events WHERE value IS NOT NULL GROUP BY ALL")
def x1(spark, d):
    e = _event_stream(spark, d).where("value IS NOT NULL").select(F.concat(F.lit("u"), F.col("user_id") % 20).alias("media_id"), F.col("user_id").alias("stem"), F.col("event_id").alias("attempt"), (F.col("value") < 50).alias("ok"), "ts")
    out = st.run_once(e, lambda x: st.qc_counters(x, "2 days"), _place(spark), close=True)
    return out.select("media_id", F.unix_millis("from").alias("from_ms"), "total", "successful", "failed")


def _place(spark) -> str:
    from cuelane.plans.session import shared_folder

    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query("x2_stream_pause_sessions", """WITH e AS (SELECT 'u' || user_id AS media_id, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + 60000 AS t FROM events), m AS (SELECT *, max(t) OVER (PARTITION BY media_id ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR s - before > 21600000 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT media_id, min(s) AS start_ms, max(t) AS end_ms, count(*) AS n_words FROM g GROUP BY media_id, g""")
def x2(spark, d):
    e = _event_stream(spark, d).select(F.concat(F.lit("u"), "user_id").alias("media_id"), "ts", F.lit(60000).alias("duration_ms"))
    return st.run_once(e, lambda x: st.pause_sessions(x, "2 days", 21_600_000), _place(spark), close=True)


@query("x3_stream_pending", "SELECT event_id // 10 AS seg_idx, 'u' || (event_id // 10 % 7) AS media_id, count(*) * 0 + 1 AS times FROM events GROUP BY event_id // 10")
def x3(spark, d):
    base = _place(spark)
    e = _event_stream(spark, d).select(F.concat(F.lit("u"), F.expr("event_id div 10 % 7")).alias("media_id"), F.expr("event_id div 10").alias("seg_idx"))
    for _ in range(2):  # the second run finds nothing new
        st.stream_pending(e, f"{base}/done", f"{base}/at", lambda df: df.withColumn("translated_text", F.lit("t")))
    return spark.read.parquet(f"{base}/done").groupBy("media_id", "seg_idx").agg(F.count("*").alias("times"))
