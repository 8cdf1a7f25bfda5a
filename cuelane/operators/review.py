"""Edits of segments, clips that follow from them, and progress.

A batch of edits is checked against the stored segments: two edits of neighbours are both checked against the stored
neighbours, and a second edit of one index is rejected as a duplicate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cuelane.operators.intervals import overlap_join
from cuelane.operators.timeline import clip_name


def apply_updates(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (op update) with reason (null: accepted) and changed: edits of no segment, without times, with negative,
    empty or overlapping windows are rejected. changed: an accepted edit gives other times, text or translation (a null
    text or translation leaves it as it is), so that the clip of the old window is out of date."""
    if "translated_text" not in edits.columns:
        edits = edits.withColumn("translated_text", F.lit(None).cast("string"))
    if "translated_text" not in segments.columns:
        segments = segments.withColumn("translated_text", F.lit(None).cast("string"))
    w = W.partitionBy("media_id").orderBy("seg_idx")
    s = segments.select("media_id", "seg_idx", F.col("start_ms").alias("s0"), F.col("end_ms").alias("s1"), F.lag("end_ms").over(w).alias("prev_end"), F.lead("start_ms").over(w).alias("next_start"), F.col("text").alias("x0"), F.col("translated_text").alias("y0"))
    e = edits.where("op = 'update'").withColumn("rn", F.row_number().over(W.partitionBy("media_id", "seg_idx").orderBy("start_ms", "end_ms", "text", "translated_text")))
    j = e.join(s, ["media_id", "seg_idx"], "left")
    reason = (
        F.when(F.col("s0").isNull(), "no such segment").when(F.col("rn") > 1, "duplicate").when(F.col("start_ms").isNull() | F.col("end_ms").isNull(), "no times").when(F.col("start_ms") < 0, "negative").when(F.col("start_ms") >= F.col("end_ms"), "empty")
        .when(F.col("start_ms") < F.col("prev_end"), "overlaps previous").when(F.col("end_ms") > F.col("next_start"), "overlaps next")
    )
    other = [~F.col("start_ms").eqNullSafe(F.col("s0")), ~F.col("end_ms").eqNullSafe(F.col("s1"))]
    other += [F.col(new).isNotNull() & ~F.col(new).eqNullSafe(F.col(old)) for new, old in (("text", "x0"), ("translated_text", "y0"))]
    return j.select("media_id", "seg_idx", "start_ms", "end_ms", "text", "translated_text", reason.alias("reason"), (reason.isNull() & (other[0] | other[1] | other[2] | other[3])).alias("changed"))


def updated_segments(segments: DataFrame, checked: DataFrame) -> DataFrame:
    """Segments with the accepted updates of apply_updates. Words are dropped from all segments of an edited recording
    (null, where segments have words), as they may not fit any more."""
    names = ["start_ms", "end_ms", "text", "translated_text"]
    new = checked.where("reason IS NULL").select("media_id", "seg_idx", *[F.col(c).alias(f"__{c}") for c in names])
    out = segments.join(new, ["media_id", "seg_idx"], "left")
    for c in names:
        if c in segments.columns:
            out = out.withColumn(c, F.coalesce(f"__{c}", c))
    if "words" in segments.columns:
        edited = new.select("media_id", F.lit(True).alias("__edited")).distinct()
        out = out.join(edited, "media_id", "left").withColumn("words", F.when(F.col("__edited").isNull(), F.col("words")))
    return out.select(*segments.columns)


def apply_inserts(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (op insert) with reason (null: accepted): inside, covers, start overlaps, end overlaps an existing segment, by the first rule that fits."""
    e = edits.where("op = 'insert'").select("media_id", "seg_idx", F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))
    s = segments.select("media_id", F.col("start_ms").alias("s0"), F.col("end_ms").alias("s1"))
    rule = F.when((F.col("a") >= F.col("s0")) & (F.col("b") <= F.col("s1")), 1).when((F.col("a") <= F.col("s0")) & (F.col("b") >= F.col("s1")), 2).when(F.col("a") >= F.col("s0"), 3).otherwise(4)
    hit = overlap_join(e, s, "a", "b", "s0", "s1").withColumn("rule", rule).groupBy("media_id", "seg_idx", "a", "b").agg(F.min("rule").alias("rule"))
    name = F.element_at(F.array(F.lit("inside"), F.lit("covers"), F.lit("start overlaps"), F.lit("end overlaps")), F.col("rule"))
    out = e.join(hit, ["media_id", "seg_idx", "a", "b"], "left")
    return out.select("media_id", "seg_idx", F.col("a").alias("start_ms"), F.col("b").alias("end_ms"), F.when(F.col("a").isNull() | F.col("b").isNull(), "no times").when(F.col("a") < 0, "negative").when(F.col("b") <= F.col("a"), "empty").when(F.col("rule").isNotNull(), name).alias("reason"))


def inserted_segments(segments: DataFrame, checked: DataFrame, edits: DataFrame) -> DataFrame:
    """Segments with the accepted inserts, numbered anew by start."""
    new = checked.where("reason IS NULL").join(edits.where("op = 'insert'").select("media_id", "seg_idx", "text"), ["media_id", "seg_idx"]).select("media_id", "start_ms", "end_ms", "text")
    both = segments.select("media_id", "start_ms", "end_ms", "text").unionByName(new)
    return both.withColumn("seg_idx", F.row_number().over(W.partitionBy("media_id").orderBy("start_ms", "end_ms")) - 1)


def check_deletes(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (op delete) with reason (null: accepted): an index that no segment of the recording has is rejected, and a repeated delete."""
    e = edits.where("op = 'delete'").select("media_id", "seg_idx").withColumn("rn", F.row_number().over(W.partitionBy("media_id", "seg_idx").orderBy(F.lit(0))))
    known = segments.select("media_id", "seg_idx", F.lit(True).alias("known"))
    return e.join(known, ["media_id", "seg_idx"], "left").select("media_id", "seg_idx", F.when(F.col("known").isNull(), "no such segment").when(F.col("rn") > 1, "duplicate").alias("reason"))


def apply_deletes(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Segments without the deleted indices, numbered anew (old_idx keeps the index before)."""
    gone = edits.where("op = 'delete'").select("media_id", "seg_idx").distinct()
    kept = segments.join(gone, ["media_id", "seg_idx"], "left_anti").withColumnRenamed("seg_idx", "old_idx")
    return kept.withColumn("seg_idx", F.row_number().over(W.partitionBy("media_id").orderBy("old_idx")) - 1)


def invalidate_clips(windows: DataFrame, clips: DataFrame) -> DataFrame:
    """Clips (media_id, stem) that are named after a changed or deleted window."""
    names = windows.select("media_id", clip_name(F.col("start_ms"), F.col("end_ms")).alias("stem"))
    return clips.join(names, ["media_id", "stem"], "left_semi")


def segment_has_clip(segments: DataFrame, clips: DataFrame) -> DataFrame:
    """Adds has_clip: a clip (media_id, stem) with the name of the segment's window exists."""
    c = clips.select("media_id", F.col("stem").alias("__stem")).distinct().withColumn("__hit", F.lit(True))
    s = segments.withColumn("__stem", clip_name(F.col("start_ms"), F.col("end_ms")))
    return s.join(c, ["media_id", "__stem"], "left").withColumn("has_clip", F.coalesce("__hit", F.lit(False))).drop("__hit", "__stem")


def failed_resolved(failed: DataFrame, clips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Failed generations that now have a clip, and wav files among the others."""
    key = ["media_id", "stem"]
    return failed.join(clips, key, "left_semi"), failed.join(clips, key, "left_anti").where(F.lower("file_name").endswith(".wav"))


def prefer_translated(translated: DataFrame, speech: DataFrame) -> DataFrame:
    """Per file name the translated version if there is one, else the speech version (origin tells which)."""
    a = translated.withColumn("origin", F.lit("translated")).unionByName(speech.withColumn("origin", F.lit("speech")))
    return a.withColumn("rn", F.row_number().over(W.partitionBy("file_name").orderBy(F.col("origin").desc()))).where("rn = 1").drop("rn")


#: Fixed preference of audio file types.
AUDIO_TYPES = ["wav", "mp3", "flac", "m4a", "ogg"]


def match_audio(transcripts: DataFrame, files: DataFrame) -> DataFrame:
    """(stem, file_name): the audio file of each transcript stem, by preference of type."""
    f = files.select("file_name", F.regexp_extract("file_name", "^(.*)\\.([^.]+)$", 1).alias("stem"), F.array_position(F.array(*[F.lit(x) for x in AUDIO_TYPES]), F.lower(F.regexp_extract("file_name", "^(.*)\\.([^.]+)$", 2))).alias("pref")).where("pref > 0")
    best = f.groupBy("stem").agg(F.min_by("file_name", F.struct("pref", "file_name")).alias("file_name"))
    return transcripts.select("stem").join(best, "stem", "left")


def promote_failed_clip(failed: DataFrame, clips: DataFrame) -> DataFrame:
    """Adds target (the name before _attempt_) and conflict: a clip of that name exists."""
    f = failed.withColumn("target", F.regexp_replace("stem", "_attempt_.*$", ""))
    hit = clips.select("media_id", F.col("stem").alias("target")).distinct().withColumn("__hit", F.lit(True))
    return f.join(hit, ["media_id", "target"], "left").withColumn("conflict", F.coalesce("__hit", F.lit(False))).drop("__hit")


def split_progress(segments: DataFrame, clips: DataFrame) -> DataFrame:
    """Per recording: total, expected (text and times), ready (translated), completed (clip exists), missing, and different clip names."""
    s = segment_has_clip(segments, clips)
    told = F.trim(F.coalesce("text", F.lit(""))) != ""
    exp = told & F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()
    g = s.groupBy("media_id").agg(F.count("*").alias("total"), F.count_if(exp).alias("expected"), F.count_if(exp & (F.trim(F.coalesce("translated_text", F.lit(""))) != "")).alias("ready"), F.count_if(F.col("has_clip")).alias("completed"))
    n = clips.groupBy("media_id").agg(F.count_distinct("stem").alias("n_clips"))
    return g.join(n, "media_id", "left").withColumn("n_clips", F.coalesce("n_clips", F.lit(0).cast("long"))).withColumn("missing", F.greatest(F.lit(0).cast("long"), F.col("expected") - F.col("completed")))


def retry_gate(progress: DataFrame, allowed: int = 0) -> DataFrame:
    return progress.withColumn("gate", F.when(F.col("missing") > allowed, "retry").otherwise("continue"))
