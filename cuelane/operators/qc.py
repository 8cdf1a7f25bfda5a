"""Checks of generated clips: text read back, pitch, verdicts over attempts, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cuelane.functions.normalise import numbers_to_words


def text_for_comparison(text: Column) -> Column:
    """Lower case, 'ly' as 'j', without .,?!-, single spaces."""
    t = F.regexp_replace(F.replace(F.lower(F.trim(text)), F.lit("ly"), F.lit("j")), "[.,?!-]", "")
    return F.trim(F.regexp_replace(t, "\\s+", " "))


def text_tolerance(text: Column, factor: float = 1.0, least: int = 2) -> Column:
    """Allowed edit distance: words times factor, rounded up, at least `least`."""
    words = F.size(F.filter(F.split(F.trim(text), "\\s+"), lambda w: w != ""))
    return F.greatest(F.ceil(words * F.lit(factor)), F.lit(least)).cast("int")


def text_check(attempts: DataFrame, factor: float = 1.0, least: int = 2, lang: str | None = None) -> DataFrame:
    """Adds distance (-1 if above the tolerance), tolerance and text_ok. The distance is only counted up to the tolerance.

    With lang (en, hu) whole numbers in the text read back are words before it is compared; a null one is empty.
    """
    a = attempts.withColumn("tolerance", text_tolerance(F.col("gen_text"), factor, least))
    heard = F.coalesce("transcribed", F.lit(""))
    if lang is not None:
        a, heard = numbers_to_words(a, lang, "transcribed"), F.coalesce("spoken", F.lit(""))
    distance = F.call_function("levenshtein", text_for_comparison(F.col("gen_text")), text_for_comparison(heard), F.greatest(F.col("tolerance"), F.lit(1)))
    return a.withColumn("distance", distance).withColumn("text_ok", F.col("distance") >= 0).drop(*["spoken"] if lang is not None else [])


def pitch_ok(tolerance: float = 20.0) -> Column:
    """A silent reference passes, a silent clip fails, else medians must differ by at most `tolerance` Hz."""
    return F.when(F.col("ref_voiced") <= 0, True).when(F.col("gen_voiced") <= 0, False).otherwise(F.abs(F.col("gen_hz") - F.col("ref_hz")) <= tolerance)


def attempt_outcome(checked: DataFrame, max_text: int = 5, max_pitch: int = 3, keep_best: bool = False) -> DataFrame:
    """(media_id, stem, outcome, attempt, tries) from attempts with text_ok, pitch_ok and raw_distance, in order of
    attempt: the first that passes both wins; trying stops after max_text text or max_pitch pitch failures. With
    keep_best the attempt of smallest distance with good pitch is taken where none wins."""
    w = W.partitionBy("media_id", "stem").orderBy("attempt").rowsBetween(W.unboundedPreceding, -1)
    fails = checked.withColumn("t", F.coalesce(F.sum(F.when(~F.col("text_ok"), 1).otherwise(0)).over(w), F.lit(0))).withColumn("p", F.coalesce(F.sum(F.when(F.col("text_ok") & ~F.col("pitch_ok"), 1).otherwise(0)).over(w), F.lit(0)))
    won = F.coalesce(F.max(F.when(F.col("text_ok") & F.col("pitch_ok"), 1).otherwise(0)).over(w), F.lit(0))
    tried = fails.withColumn("won", won).where((F.col("t") < max_text) & (F.col("p") < max_pitch) & (F.col("won") == 0))
    best = F.min_by("attempt", F.when(F.col("pitch_ok"), F.struct("raw_distance", "attempt"))) if keep_best else F.lit(None).cast("int")
    g = tried.groupBy("media_id", "stem").agg(F.min(F.when(F.col("text_ok") & F.col("pitch_ok"), F.col("attempt"))).alias("won"), best.alias("best"), F.count("*").alias("tries"))
    return g.select("media_id", "stem", F.when(F.col("won").isNotNull(), "accepted").when(F.col("best").isNotNull(), "kept_best").otherwise("failed").alias("outcome"), F.coalesce("won", "best").alias("attempt"), "tries")


def attempt_outcome_strict(checked: DataFrame, retries: int = 5, keep_best: bool = False) -> DataFrame:
    """The first attempt at distance 0 or 1 wins; else, after `retries` attempts, the closest one if within tolerance (or always with keep_best)."""
    g = checked.where(F.col("attempt") <= retries).groupBy("media_id", "stem").agg(
        F.min(F.when(F.col("raw_distance") <= 1, F.col("attempt"))).alias("now"), F.min_by(F.struct("attempt", "raw_distance", "tolerance"), F.struct("raw_distance", "attempt")).alias("b"))
    fits = F.lit(True) if keep_best else F.col("b.raw_distance") <= F.col("b.tolerance")
    return g.select("media_id", "stem", F.when(F.col("now").isNotNull(), "accepted").when(fits, "best").otherwise("failed").alias("outcome"), F.coalesce("now", F.when(fits, F.col("b.attempt"))).alias("attempt"))


def pitch_outliers(clips: DataFrame, narrator_hz: DataFrame, tolerance: float = 20.0) -> DataFrame:
    """Clips whose median pitch is off the narrator's by more than tolerance, or that have no voiced frame. narrator_hz: one row per recording (media_id, narrator_hz)."""
    j = clips.join(narrator_hz, "media_id").withColumn("diff_hz", F.when(F.col("gen_voiced") > 0, F.abs(F.col("gen_hz") - F.col("narrator_hz"))))
    return j.where("diff_hz IS NULL OR diff_hz > " + str(tolerance))


def qc_summary(verdicts: DataFrame) -> DataFrame:
    """Counts per recording of rows with outcome, and of their rejections (text_rejects, pitch_rejects)."""
    return verdicts.groupBy("media_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("outcome") != "failed").alias("successful"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.sum("text_rejects").alias("text_rejected"), F.sum("pitch_rejects").alias("pitch_rejected"))


def failure_log(failures: DataFrame) -> DataFrame:
    """Failures per clip as structs in order of attempt, and the latest time (columns attempt, distance, gen_text, transcribed, at)."""
    return failures.groupBy("media_id", "stem").agg(F.sort_array(F.collect_list(F.struct("attempt", "distance", "gen_text", "transcribed"))).alias("failures"), F.max("at").alias("last_update"))


def collect_new_words(texts: DataFrame, known: DataFrame, produced: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, spelling, n): different tokens of the texts that are in none of the tables (key), with the smallest spelling and count."""
    tok = texts.select(F.explode(F.regexp_extract_all("text", F.lit("(?U)[\\p{L}\\p{N}_]+"), F.lit(0))).alias("spelling")).withColumn("word", F.lower("spelling"))
    words = tok.groupBy("word").agg(F.min("spelling").alias("spelling"), F.count("*").alias("n"))
    for t in (known, produced, dictionary):
        words = words.join(t.select(F.lower("key").alias("word")).distinct(), "word", "left_anti")
    return words


def dedup_rules(rules: DataFrame) -> DataFrame:
    """(key, value, prio): the last value of each key at the place of its first."""
    return rules.groupBy("key").agg(F.max_by("value", "prio").alias("value"), F.min("prio").alias("prio"))
