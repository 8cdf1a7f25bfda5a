"""Small projections over records of clips, tracks and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Subtitle codecs and their file types, three-letter language codes and their two-letter ones.
CODECS = {"subrip": "srt", "ass": "ass", "ssa": "ssa", "webvtt": "vtt", "mov_text": "srt", "hdmv_pgs_subtitle": "sup", "dvd_subtitle": "sub"}
LANGUAGES = {"hun": "hu", "eng": "en", "ger": "de", "deu": "de", "fre": "fr", "fra": "fr", "spa": "es", "ita": "it"}


def _told(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\\s+", " ")), F.lit(""))


def first_failure_text(rows: DataFrame) -> DataFrame:
    """Adds first_text: the first text that is not blank of original_text, gen_text, then of both in the array failures, white space collapsed."""
    inner = F.flatten(F.transform("failures", lambda f: F.array(_told(f["original_text"]), _told(f["gen_text"]))))
    return rows.withColumn("first_text", F.coalesce(_told(F.col("original_text")), _told(F.col("gen_text")), F.get(F.filter(inner, lambda x: x.isNotNull()), F.lit(0))))


def subtitle_track_names(tracks: DataFrame) -> DataFrame:
    """Adds file_name: stem_lang.type of tracks (stem, pos, lang, codec), two-letter codes where known, txt for unknown codecs, _1, _2, ... for names that occur again."""
    m = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    lang = F.coalesce(m(LANGUAGES)[F.lower("lang")], F.lower("lang"), F.lit("und"))
    t = tracks.withColumn("__n", F.concat_ws("_", "stem", lang)).withColumn("__e", F.coalesce(m(CODECS)[F.lower("codec")], F.lit("txt")))
    again = F.row_number().over(W.partitionBy("__n", "__e").orderBy("pos")) - 1
    return t.withColumn("file_name", F.concat("__n", F.when(again > 0, F.concat(F.lit("_"), again.cast("string"))).otherwise(""), F.lit("."), "__e")).drop("__n", "__e")


def unescape_text(text: Column) -> Column:
    """Escaped double quotes as plain ones."""
    return F.replace(text, F.lit('\\"'), F.lit('"'))
