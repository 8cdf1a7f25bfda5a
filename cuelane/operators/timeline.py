"""Clip names, levels, shifts and plans on the recording's time line."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Fixed format of clip names: HH-MM-SS-mmm_HH-MM-SS-mmm, with an optional tail.
NAME = "^(\\d{2})-(\\d{2})-(\\d{2})-(\\d{3})_(\\d{2})-(\\d{2})-(\\d{2})-(\\d{3})(?:_.*)?\\.wav$"


def stamp(ms: Column, sep: str = "-", last: str = "-") -> Column:
    p = lambda n, w: F.lpad(F.floor(n).cast("string"), w, "0")
    hours = F.floor(ms / 3600000).cast("string")
    return F.concat(F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours), F.lit(sep), p((ms / 60000) % 60, 2), F.lit(sep), p((ms / 1000) % 60, 2), F.lit(last), p(ms % 1000, 3))


def clip_name(start: Column, end: Column, wrap: bool = False) -> Column:
    """Name stem of a window in ms; wrap=True lets hours start again after a day."""
    day = 86_400_000
    return F.concat_ws("_", stamp(start % day if wrap else start), stamp(end % day if wrap else end))


def clip_name_of_seconds(start: Column, end: Column, mode: str = "trunc") -> Column:
    """Name stem of a window in seconds: milliseconds cut off (trunc) or rounded, half to even (round); nothing is below zero."""
    if mode not in ("trunc", "round"):
        raise ValueError("mode is trunc or round")
    ms = lambda s: F.greatest(F.lit(0), (F.bround(s * 1000) if mode == "round" else F.floor(s * 1000)).cast("long"))
    return clip_name(ms(start), ms(end))


def clip_window(names: DataFrame) -> DataFrame:
    """Adds start_ms, end_ms (null for names that do not follow the format) and named_ms (null if negative)."""
    g = lambda i: F.regexp_extract("file_name", NAME, i).cast("long")
    t = lambda i: g(i) * 3600000 + g(i + 1) * 60000 + g(i + 2) * 1000 + g(i + 3)
    ok = F.col("file_name").rlike(NAME)
    out = names.withColumn("start_ms", F.when(ok, t(1))).withColumn("end_ms", F.when(ok, t(5)))
    return out.withColumn("named_ms", F.when(F.col("end_ms") >= F.col("start_ms"), F.col("end_ms") - F.col("start_ms")))


def clip_duration_report(clips: DataFrame) -> DataFrame:
    """Named and real duration in seconds with two decimals ('--' if unknown) and too_long: real over named by more than 10 ms."""
    show = lambda c: F.when(F.col(c).isNull(), "--").otherwise(F.concat(F.expr(f"{c} div 1000"), F.lit("."), F.lpad(F.expr(f"({c} % 1000) div 10").cast("string"), 2, "0")))
    return clips.withColumn("named_s", show("named_ms")).withColumn("real_s", show("actual_ms")).withColumn("too_long", F.coalesce(F.col("actual_ms") - F.col("named_ms") > 10, F.lit(False)))


def loudness_gain(clips: DataFrame, least_ref: float = -40.0) -> DataFrame:
    """gain_db: reference minus clip level, not above the headroom to the reference peak; null for silent clips or references below least_ref; applied if at least 0.1 dB or capped."""
    raw = F.col("ref_db") - F.col("clip_db")
    room = F.col("ref_peak_db") - F.col("clip_peak_db")
    usable = F.col("clip_db").isNotNull() & F.col("ref_db").isNotNull() & (F.col("ref_db") >= least_ref)
    out = clips.withColumn("capped", usable & (raw > room)).withColumn("gain_db", F.when(usable, F.least(raw, room)))
    return out.withColumn("applied", F.coalesce(F.col("capped") | (F.abs("gain_db") >= 0.1), F.lit(False)))


def onset_shift(clips: DataFrame) -> DataFrame:
    """action and shift_ms from reference and clip speech starts: pad if later by over 1 ms, trim if earlier, error if the trim eats the clip, deletable without speech."""
    d = F.col("ref_onset_ms") - F.col("onset_ms")
    act = F.when(F.col("onset_ms").isNull(), "delete").when(d > 1, "pad").when((d < -1) & (-d >= F.col("actual_ms")), "error").when(d < -1, "trim").otherwise("keep")
    return clips.withColumn("action", act).withColumn("shift_ms", F.when(act.isin("pad", "trim"), d).otherwise(0))


#: Thresholds of tail trimming in dB, tried in this order, and chunks that a step inside a worker holds.
LEVELS, STEP_CHUNKS = [-50 - 5 * i for i in range(7)], 1 << 20


def tail_trim(chunks: DataFrame, clips: DataFrame, chunk_ms: int = 5, tail_ms: int = 100, guard: float = 0.7) -> DataFrame:
    """(media_id, stem, threshold_db, new_ms, guard_triggered, guard_resolved, status): clips cut after the last chunk at or above a threshold plus a tail. The
    threshold goes down from -50 to -80 dB in steps of 5 while the result is shorter than `guard` of the window; if none
    meets it, the last is used. guard_triggered tells that the threshold went
    down, guard_resolved that some threshold met the guard; else the clip is to stay as it was. chunks: (media_id, stem, idx, db)."""
    last = chunks.groupBy("media_id", "stem").agg(*[F.max(F.when(F.col("db") >= t, F.col("idx"))).alias(f"l{-t}") for t in LEVELS])
    return _tail_cut(clips.join(last, ["media_id", "stem"], "left"), chunk_ms, tail_ms, guard)


def tail_trim_measured(clips: DataFrame, levels: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], chunk_ms: int = 5, tail_ms: int = 100, guard: float = 0.7) -> DataFrame:
    """tail_trim of clips (media_id, stem, actual_ms, window_ms, ...) whose levels are measured where the clips lie: `levels` gives
    those of all chunks of a batch's clips in a row, and how many each clip has. No chunk becomes a row of a table, nothing
    is grouped or joined; a step holds some STEP_CHUNKS chunks, or those of one longer clip."""

    def last_chunks(batch: pa.RecordBatch) -> Iterator[pa.Array]:
        db, sizes = levels(batch)
        end = np.cumsum(sizes)
        begin = end - sizes
        last, at = begin - 1, None  # at: places of db that are left; only behind the last one at a threshold can a lower one's be
        for t in LEVELS:
            hits = np.flatnonzero(db >= t) if at is None else at[db >= t]
            hits = np.concatenate(([-1], hits))
            last = np.maximum(last, hits[np.searchsorted(hits, end) - 1])
            yield pa.array(last - begin, pa.int64(), mask=last < begin)
            behind = end - 1 - last
            left = np.repeat(last + 1 - (np.cumsum(behind) - behind), behind) + np.arange(behind.sum())
            db, at = db[left if at is None else np.searchsorted(at, left)], left

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = np.cumsum(batch.column(2).fill_null(0).to_numpy() // chunk_ms) // STEP_CHUNKS
            cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *last_chunks(part)], names=names)

    c = clips.select("media_id", "stem", "actual_ms", "window_ms", *[x for x in clips.columns if x not in ("media_id", "stem", "actual_ms", "window_ms")])
    names = [*c.columns[:4], *[f"l{-t}" for t in LEVELS]]
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in c.schema.fields[:4]] + [f"{n} long" for n in names[4:]]
    return _tail_cut(c.mapInArrow(run, ", ".join(kinds)), chunk_ms, tail_ms, guard)


def _tail_cut(j: DataFrame, chunk_ms: int, tail_ms: int, guard: float) -> DataFrame:
    """The cut of clips that know their last chunk at or above each threshold."""
    levels = LEVELS
    new = lambda t: F.when(F.col(f"l{-t}").isNotNull(), (F.col(f"l{-t}") + 1) * chunk_ms + tail_ms).otherwise(tail_ms)
    fine = lambda t: (new(t) >= F.col("actual_ms")) | (new(t) >= guard * F.col("window_ms"))
    pick = F.lit(levels[-1])
    for t in reversed(levels[:-1]):
        pick = F.when(fine(t), F.lit(t)).otherwise(pick)
    out = j.withColumn("threshold_db", pick)
    length = F.lit(None).cast("long")
    for t in levels:
        length = F.when(F.col("threshold_db") == t, new(t)).otherwise(length)
    resolved = fine(levels[-1])
    for t in reversed(levels[:-1]):
        resolved = fine(t) | resolved
    return out.select("media_id", "stem", "threshold_db", length.cast("long").alias("new_ms"), (~fine(levels[0])).alias("guard_triggered"), resolved.alias("guard_resolved"), F.when(resolved, "success").otherwise("skipped_guard_unresolved").alias("status"))


def overlay_plan(clips: DataFrame, most: float = 1.18) -> DataFrame:
    """Adds overlap_ms with the next clip's start, rate and final_ms: a clip that would run into the next is sped up, at most by `most`, and cut to its window."""
    nxt = F.lead("start_ms").over(W.partitionBy("media_id").orderBy("start_ms", "end_ms"))
    over = F.greatest(F.lit(0), F.coalesce(F.col("start_ms") + F.col("actual_ms") - nxt, F.lit(0)))
    target = nxt - F.col("start_ms")
    fast = (over > 0) & (target > 0)
    rate = F.when(fast, F.least(F.col("actual_ms") / target, F.lit(most))).otherwise(F.lit(1.0))
    out = clips.withColumn("overlap_ms", over).withColumn("target", target).withColumn("rate", rate)
    return out.withColumn("final_ms", F.when(F.col("rate") > 1, F.least("target", F.floor(F.col("actual_ms") / F.col("rate")))).otherwise(F.col("actual_ms")).cast("long")).drop("target")


def sequential_plan(clips: DataFrame, faster_percent: int = 10) -> DataFrame:
    """Adds place_ms and length_ms: clips sped up, each at its own start or where the one before ends, whichever is later. The push is a running maximum: place = C(i-1) + max over j<=i of (start_j - C(j-1)), C being summed lengths."""
    w = W.partitionBy("media_id").orderBy("start_ms", "end_ms")
    c = clips.withColumn("length_ms", F.expr(f"actual_ms * 100 div {100 + faster_percent}")).withColumn("before", F.sum("length_ms").over(w) - F.col("length_ms"))
    return c.withColumn("place_ms", F.col("before") + F.max(F.col("start_ms") - F.col("before")).over(w)).drop("before")


def timing_stats(shifts: DataFrame) -> DataFrame:
    """Counts by action, mean silence added and trimmed, mean gain applied (at least 0.1 dB) and deletable clips per recording."""
    return shifts.groupBy("media_id").agg(
        F.count_if(F.col("action") == "pad").alias("padded"), F.count_if(F.col("action") == "trim").alias("trimmed"), F.count_if(F.col("action") == "delete").alias("deleted"), F.count_if(F.col("action") == "error").alias("errors"),
        F.round(F.avg(F.when(F.col("action") == "pad", F.col("shift_ms"))), 6).alias("mean_added_ms"), F.round(F.avg(F.when(F.col("action") == "trim", -F.col("shift_ms"))), 6).alias("mean_trimmed_ms"),
        F.round(F.avg(F.when(F.abs("gain_db") >= 0.1, F.col("gain_db"))), 6).alias("mean_gain_db"))
