"""Queries over signal tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelane.operators import signals as sn
from cuelane.plans import fixtures as fx
from cuelane.plans.fixtures import oracle

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_FR = "fr AS (SELECT media_id, (pos // 8)::BIGINT AS frame_idx, sqrt(avg(sample::DOUBLE * sample)) AS rms FROM pcm GROUP BY ALL)"
_TH = _FR + """, pf AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY rms) - 1 AS rn, count(*) OVER (PARTITION BY media_id) AS n FROM fr WHERE rms > 0),
nn AS (SELECT media_id, median(rms) AS med, max(rms) AS top, max(rms) FILTER (rn = round_even(0.9 * (n - 1), 0)) AS p90 FROM pf GROUP BY 1),
th AS (SELECT media_id, least(CASE WHEN top > 150 THEN greatest(0.8 * med, 0.6 * p90, 150) ELSE greatest(0.8 * med, 0.6 * p90) END, top) AS high FROM nn)"""


@query("e1_frame_energy", oracle("pcm", _FR + " SELECT media_id, frame_idx, round(rms, 4) AS rms FROM fr"))
def e1(spark, d):
    return sn.frame_energy(fx.pcm(spark, d), 8).withColumn("rms", F.round("rms", 4))


@query("e2_energy_thresholds", oracle("pcm", _TH + " SELECT media_id, round(high, 4) AS high, round(high / 2, 4) AS low FROM th"))
def e2(spark, d):
    return sn.energy_thresholds(sn.frame_energy(fx.pcm(spark, d), 8)).select("media_id", F.round("high", 4).alias("high"), F.round("low", 4).alias("low"))


@query("e3_refine_words", oracle("pcm", _TH + """, wv AS (SELECT DISTINCT media_id, unnest(range(5)) AS input_pos FROM pcm), w AS (SELECT media_id, input_pos, input_pos * 16 + 2 AS start_ms, input_pos * 16 + 17 AS end_ms FROM wv),
f AS (SELECT w.*, start_ms // 10 AS f0, greatest(start_ms // 10, (end_ms - 1) // 10) AS f1 FROM w),
h AS (SELECT f.media_id, f.input_pos, start_ms, coalesce(min(frame_idx), any_value(f0)) * 10 AS s, (coalesce(max(frame_idx), any_value(f1)) + 1) * 10 AS e FROM f LEFT JOIN (SELECT fr.* FROM fr JOIN th USING (media_id) WHERE rms >= high) a ON a.media_id = f.media_id AND a.frame_idx BETWEEN f0 AND f1 GROUP BY ALL),
i AS (SELECT *, row_number() OVER w AS i FROM h WINDOW w AS (PARTITION BY media_id ORDER BY start_ms)), m AS (SELECT *, max(greatest(e, s + 20) - 20 * i) OVER (PARTITION BY media_id ORDER BY start_ms) + 20 * i AS en FROM i)
SELECT media_id, input_pos::INT AS input_pos, greatest(s, coalesce(lag(en) OVER (PARTITION BY media_id ORDER BY start_ms), 0))::BIGINT AS start_ms, en::BIGINT AS end_ms FROM m"""))
def e3(spark, d):
    p = fx.pcm(spark, d)
    fr = sn.frame_energy(p, 8)
    w = p.select("media_id").distinct().select("media_id", F.explode(F.expr("sequence(0, 4)")).alias("input_pos")).select("media_id", "input_pos", F.lit("w").alias("word"), (F.col("input_pos") * 16 + 2).alias("start_ms"), (F.col("input_pos") * 16 + 17).alias("end_ms"))
    return sn.refine_words(w, fr, sn.energy_thresholds(fr)).select("media_id", "input_pos", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"))


@query("e4_silence_chunks", oracle("pcm", """x AS MATERIALIZED (SELECT media_id, pos, CASE WHEN (pos // 5 + vec_id) % 3 = 0 THEN 0 ELSE abs(sample) / 32768.0::DOUBLE END AS x, count(*) OVER (PARTITION BY media_id) AS n FROM pcm),
runs AS MATERIALIZED (SELECT media_id, min(pos) AS s, max(pos) + 1 AS e FROM (SELECT media_id, pos, pos - row_number() OVER (PARTITION BY media_id ORDER BY pos) AS g FROM x WHERE x <= 1e-3::DOUBLE) GROUP BY media_id, g HAVING count(*) >= 3),
cut AS MATERIALIZED (SELECT x.media_id, x.pos AS lo, any_value(n) AS n, CASE WHEN x.pos + 24 >= any_value(n) THEN any_value(n) ELSE coalesce(max(least(e, x.pos + 24) - 3) FILTER (e IS NOT NULL) + 1, x.pos + 24) END AS hi
 FROM x LEFT JOIN runs r ON r.media_id = x.media_id AND s <= x.pos + 21 AND least(e, x.pos + 24) - 3 >= x.pos + 8 GROUP BY x.media_id, x.pos),
c(media_id, lo, hi) AS (SELECT media_id, lo, hi FROM cut WHERE lo = 0 UNION ALL SELECT cut.media_id, cut.lo, cut.hi FROM c JOIN cut ON cut.media_id = c.media_id AND cut.lo = c.hi),
k AS (SELECT c.media_id, c.lo, c.hi FROM c JOIN x ON x.media_id = c.media_id AND x.pos >= c.lo AND x.pos < c.hi GROUP BY ALL HAVING max(x) >= 1e-4::DOUBLE)
SELECT media_id, (row_number() OVER (PARTITION BY media_id ORDER BY lo) - 1)::INT AS chunk, lo::BIGINT AS start, hi::BIGINT AS "end" FROM k""").replace("WITH ", "WITH RECURSIVE ", 1))
def e4(spark, d):
    gate = (F.expr("pos div 5") + F.col("vec_id")) % 3 == 0  # stretches of silence, so that there is something to cut in
    return sn.silence_chunks(fx.pcm(spark, d).withColumn("x", F.when(gate, 0.0).otherwise(F.col("sample") / 32768.0)), 16, 1.5)


def _frames(spark, d):
    return fx.table(spark, d, "embeddings").where("embedding IS NOT NULL").select(F.concat(F.lit("v"), F.expr("vec_id div 4")).alias("media_id"), (F.col("vec_id") % 4).alias("frame_idx"), F.col("embedding").alias("samples"))


@query("e5_frame_pitch")
def e5(spark, d):
    return sn.frame_pitch(_frames(spark, d), 800, 20, 200).select("media_id", "frame_idx", F.round("rms", 6).alias("rms"), F.round("hz", 6).alias("hz"))


@query("e6_pitch_summary", """WITH p AS (SELECT 'v' || (l_orderkey % 40) AS media_id, l_discount AS rms, CASE WHEN l_partkey % 3 = 0 THEN 0.0 ELSE (80 + l_suppkey % 120)::DOUBLE END AS hz FROM lineitem)
SELECT media_id, round(coalesce(avg(hz) FILTER (rms >= 0.01 AND hz > 0), 0), 6) AS mean_hz, coalesce(median(hz) FILTER (rms >= 0.01 AND hz > 0), 0) AS median_hz, round(coalesce(stddev_samp(hz) FILTER (rms >= 0.01 AND hz > 0), 0), 6) AS std_hz, round(count(*) FILTER (rms >= 0.01 AND hz > 0) / count(*), 6) AS voiced FROM p GROUP BY 1""")
def e6(spark, d):
    p = fx.table(spark, d, "lineitem").select(F.concat(F.lit("v"), F.col("l_orderkey") % 40).alias("media_id"), F.col("l_discount").alias("rms"), F.when(F.col("l_partkey") % 3 == 0, 0.0).otherwise((F.lit(80) + F.col("l_suppkey") % 120).cast("double")).alias("hz"))
    o = sn.pitch_summary(p)
    return o.select("media_id", F.round("mean_hz", 6).alias("mean_hz"), "median_hz", F.round("std_hz", 6).alias("std_hz"), F.round("voiced", 6).alias("voiced"))


@query("e7_signal_prepare", oracle("pcm", "c AS (SELECT media_id, pos, sample - avg(sample) OVER (PARTITION BY media_id) AS x FROM pcm) SELECT media_id, pos::INT AS pos, round(x / max(abs(x)) OVER (PARTITION BY media_id), 6) AS x FROM c"))
def e7(spark, d):
    return sn.signal_prepare(fx.pcm(spark, d)).select("media_id", "pos", F.round("x", 6).alias("x"))


@query("e8_clip_levels", oracle("pcm", "SELECT media_id, round(20 * log10(sqrt(avg(sample::DOUBLE * sample)) / 32768.0::DOUBLE), 4) AS dbfs, round(20 * log10(max(abs(sample)) / 32768.0::DOUBLE), 4) AS peak_dbfs FROM pcm GROUP BY 1"))
def e8(spark, d):
    return sn.clip_levels(fx.pcm(spark, d)).select("media_id", F.round("dbfs", 4).alias("dbfs"), F.round("peak_dbfs", 4).alias("peak_dbfs"))


_OUT = "o AS (SELECT 'g' || (vec_id // 2) AS media_id, vec_id % 2 AS model, pos, sample / 32768.0::DOUBLE AS v, (sample % 4096) / 65536.0::DOUBLE AS n FROM pcm)"
_WT = _OUT + ", r AS (SELECT media_id, model, avg(v * v) / (avg(n * n) + 1e-9) AS r FROM o GROUP BY ALL), wt AS (SELECT media_id, model, CASE WHEN sum(r) OVER (PARTITION BY media_id) > 0 THEN r / sum(r) OVER (PARTITION BY media_id) ELSE 1 / count(*) OVER (PARTITION BY media_id) END AS weight FROM r)"


def _outputs(spark, d):
    return fx.pcm(spark, d).select(F.concat(F.lit("g"), F.expr("vec_id div 2")).alias("media_id"), (F.col("vec_id") % 2).alias("model"), "pos", (F.col("sample") / 32768.0).alias("v"), (F.col("sample") % 4096 / 65536.0).alias("n"))


@query("e9_ensemble_weights", oracle("pcm", _WT + " SELECT media_id, model, round(weight, 6) AS weight FROM wt"))
def e9(spark, d):
    return sn.ensemble_weights(_outputs(spark, d)).withColumn("weight", F.round("weight", 6))


@query("e10_ensemble_blend", oracle("pcm", _WT + """, j AS (SELECT media_id, pos, sum(weight * v) AS voice, sum(weight * n) AS bg, avg(v + n) AS mixture FROM o JOIN wt USING (media_id, model) GROUP BY ALL), b AS (SELECT *, 0.5 * bg + 0.5 * greatest(-1.0, least(1.0, mixture - voice)) AS background FROM j),
g AS (SELECT media_id, 10 * log10(avg(background * background) + 1e-12) AS nd, 10 * log10(avg(voice * voice) + 1e-12) AS vd FROM b GROUP BY 1)
SELECT media_id, pos::INT AS pos, round(voice, 6) AS voice, round(CASE WHEN nd - vd <= -25 OR nd <= -50 THEN 0 ELSE background END, 6) AS background FROM b JOIN g USING (media_id)"""))
def e10(spark, d):
    o = _outputs(spark, d)
    return sn.ensemble_blend(o, sn.ensemble_weights(o)).select("media_id", "pos", F.round("voice", 6).alias("voice"), F.round("background", 6).alias("background"))


@query("e11_overlap_add", oracle("pcm", """c AS (SELECT 'g' || (vec_id // 4) AS media_id, pos AS chunk_pos, (vec_id % 4) * 48 + pos AS pos, sample / 32768.0::DOUBLE AS x, least(pos, 63 - pos) AS edge FROM pcm), w AS (SELECT *, CASE WHEN edge < 16 THEN 1e-3 + (1 - 1e-3) * edge / 16 ELSE 1.0 END AS w FROM c)
SELECT media_id, pos::BIGINT AS pos, round(sum(x * w) / sum(w), 6) AS x FROM w GROUP BY media_id, pos"""))
def e11(spark, d):
    c = fx.pcm(spark, d).select(F.concat(F.lit("g"), F.expr("vec_id div 4")).alias("media_id"), F.col("pos").alias("chunk_pos"), F.lit(64).alias("size"), F.lit(16).alias("fade"), (F.col("vec_id") % 4 * 48 + F.col("pos")).alias("pos"), (F.col("sample") / 32768.0).alias("x"))
    return sn.overlap_add(c).withColumn("x", F.round("x", 6))


@query("e12_normalize_peak", "WITH p AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS peak FROM embeddings WHERE embedding IS NOT NULL) SELECT vec_id, round(0.95, 6)::DOUBLE AS peak, round(embedding[1]::DOUBLE * (0.95::DOUBLE / peak), 6) AS head FROM p WHERE peak > 0")
def e12(spark, d):
    e = fx.table(spark, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("samples"))
    o = sn.normalize_peak(e)
    return o.select("vec_id", F.round(F.array_max(F.transform("samples", F.abs)), 6).alias("peak"), F.round(F.get("samples", F.lit(0)), 6).alias("head")).where("peak > 0")


@query("q14_mixdown", oracle("pcm", """s AS (SELECT 'g' || (vec_id // 4) AS media_id, (vec_id % 4) * 40 + pos AS place, sum(sample) AS x FROM pcm GROUP BY ALL), g AS (SELECT media_id, (place // 64)::BIGINT AS block, place % 64 AS off, greatest(-32768, least(32767, x)) AS x FROM s)
SELECT media_id, block, sum(x)::BIGINT AS total, sum(x * (off + 1))::BIGINT AS moment FROM g GROUP BY ALL"""))
def q14(spark, d):
    e = fx.table(spark, d, "embeddings").where("embedding IS NOT NULL").select(F.concat(F.lit("g"), F.expr("vec_id div 4")).alias("media_id"), (F.col("vec_id") % 4 * 40).cast("int").alias("start"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 32767).cast("int")).alias("samples"))
    m = sn.mixdown(e).select("media_id", "block", F.posexplode("samples").alias("off", "x"))
    return m.groupBy("media_id", "block").agg(F.sum("x").alias("total"), F.sum(F.col("x") * (F.col("off") + 1)).alias("moment"))


@query("q15_loop_background", oracle("pcm", """l AS (SELECT DISTINCT media_id, 100 + vec_id % 50 AS n FROM pcm), o AS (SELECT media_id, unnest(range(n)) AS pos FROM l) SELECT o.media_id, o.pos, round(sample * 0.4::DOUBLE, 6) AS x FROM o JOIN pcm p ON p.media_id = o.media_id AND p.pos = o.pos % 64"""))
def q15(spark, d):
    p = fx.pcm(spark, d)
    return sn.loop_background(p.select("media_id", "pos", F.col("sample").cast("double").alias("x")), p.select("media_id", (F.lit(100) + F.col("vec_id") % 50).alias("n")).distinct(), 40).withColumn("x", F.round("x", 6))


@query("q16_nonsilent_end", oracle("pcm", """p AS (SELECT media_id, pos, avg(sample::DOUBLE * sample) OVER (PARTITION BY media_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS p, avg(sample::DOUBLE * sample) OVER (PARTITION BY media_id) AS level FROM pcm)
SELECT media_id, coalesce(max(pos) FILTER (pos >= 7 AND p > level * power(10, -0.3)) + 1, 64)::BIGINT AS "end" FROM p GROUP BY 1"""))
def q16(spark, d):
    return sn.nonsilent_end(fx.pcm(spark, d), 8, 3.0)
