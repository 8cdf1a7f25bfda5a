"""Turns, regions and windows of time: interval joins, runs, sweeps."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cuelane.operators import chains

#: Width of the time buckets that interval joins meet in, besides the recording, so that one long recording is many keys.
BUCKET_MS = 60_000


def bucketed(df: DataFrame, start: str, end: str, name: str, width: int = BUCKET_MS) -> DataFrame:
    """One row per time bucket that [start, end) touches."""
    return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(F.col(start), F.col(end) - 1) / width))))


def overlap_join(left: DataFrame, right: DataFrame, ls: str, le: str, rs: str, re: str, media: str = "media_id", width: int = BUCKET_MS) -> DataFrame:
    """Rows of both sides of one recording that overlap in time, each pair once: in the bucket where the overlap begins. right's recording column is dropped. Sides are sorted where they lie: the planner does not count the rows that buckets add and would broadcast them."""
    a = bucketed(left, ls, le, "__b", width).hint("merge")
    b = bucketed(right.withColumnRenamed(media, "__m"), rs, re, "__c", width)
    on = (F.col(media) == F.col("__m")) & (F.col("__b") == F.col("__c")) & (F.col(rs) < F.col(le)) & (F.col(re) > F.col(ls)) & (F.floor(F.greatest(F.col(ls), F.col(rs)) / width) == F.col("__b"))
    return a.join(b, on).drop("__b", "__c", "__m")


def crop_turns(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """(media_id, seg_idx, start_ms, end_ms, speaker): turns cut to each segment's window, of positive length."""
    s = segments.select("media_id", "seg_idx", F.col("start_ms").alias("s0"), F.col("end_ms").alias("s1"))
    t = turns.select("media_id", F.col("start_ms").alias("t0"), F.col("end_ms").alias("t1"), "speaker")
    j = overlap_join(s, t, "s0", "s1", "t0", "t1")
    return j.select("media_id", "seg_idx", F.greatest("s0", "t0").alias("start_ms"), F.least("s1", "t1").alias("end_ms"), "speaker")


def _runs(cropped: DataFrame, brk: Column) -> DataFrame:
    w = W.partitionBy("media_id", "seg_idx").orderBy("start_ms", "end_ms", "speaker")
    marked = cropped.withColumn("__brk", F.when(F.coalesce(brk, F.lit(True)), 1).otherwise(0)).withColumn("run_idx", (F.sum("__brk").over(w) - 1).cast("int"))
    return marked.groupBy("media_id", "seg_idx", "run_idx").agg(F.min("start_ms").alias("start_ms"), F.max_by("end_ms", F.struct("start_ms", "end_ms")).alias("end_ms"), F.min("speaker").alias("speaker"))


def merge_runs(cropped: DataFrame, touch: int = 10) -> DataFrame:
    """Neighbouring turns of one speaker less than `touch` ms apart become one run that ends where the later ends."""
    w = W.partitionBy("media_id", "seg_idx").orderBy("start_ms", "end_ms", "speaker")
    return _runs(cropped, (F.col("speaker") != F.lag("speaker").over(w)) | (F.col("start_ms") - F.lag("end_ms").over(w) >= touch))


def speaker_runs(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """(media_id, seg_idx, run_idx, start_ms, end_ms, speaker): islands of one speaker in each segment; a segment without turns is one run of UNKNOWN."""
    runs = _own_runs(segments, turns)
    each = segments.select("media_id", "seg_idx", F.col("start_ms").alias("s0"), F.col("end_ms").alias("s1")).join(runs, ["media_id", "seg_idx"], "left")
    return each.select("media_id", "seg_idx", F.coalesce("run_idx", F.lit(0)).alias("run_idx"), F.coalesce("start_ms", "s0").alias("start_ms"), F.coalesce("end_ms", "s1").alias("end_ms"), F.coalesce("speaker", F.when(F.col("run_idx").isNull(), "UNKNOWN")).alias("speaker"))


def _own_runs(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """speaker_runs without those of UNKNOWN."""
    w = W.partitionBy("media_id", "seg_idx").orderBy("start_ms", "end_ms", "speaker")
    return _runs(crop_turns(segments, turns), F.col("speaker") != F.lag("speaker").over(w))


def assign_words_to_runs(words: DataFrame, runs: DataFrame) -> DataFrame:
    """Words (media_id, seg_idx, ...) with run_idx and run_speaker: the first run that holds the word's middle, both ends
    included, else the run with the largest share of the word, at least half; words with neither are dropped."""
    r = runs.select("media_id", "seg_idx", "run_idx", F.col("start_ms").alias("r0"), F.col("end_ms").alias("r1"), F.col("speaker").alias("run_speaker"))
    mid = (F.col("start_ms") + F.col("end_ms")) / 2
    share = (F.least("end_ms", "r1") - F.greatest("start_ms", "r0")) / F.greatest(F.lit(1), F.col("end_ms") - F.col("start_ms"))
    j = words.join(r, ["media_id", "seg_idx"]).withColumn("holds", mid.between(F.col("r0"), F.col("r1"))).withColumn("share", share).where("holds OR share >= 0.5")
    best = W.partitionBy("media_id", "seg_idx", "input_pos").orderBy(F.col("holds").desc(), F.when(~F.col("holds"), -F.col("share")), "run_idx")
    return j.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn", "holds", "share", "r0", "r1")


def split_by_speaker(segments: DataFrame, words: DataFrame, turns: DataFrame, min_segment: int = 500, min_chunk: int = 200) -> DataFrame:
    """(media_id, seg_idx, part, start_ms, end_ms, text, speaker) of segments split at speaker runs.

    Segments shorter than min_segment keep their speaker (default UNKNOWN); one run labels the whole segment; several
    give a part each with its words. Parts without words are dropped if shorter than min_chunk, else keep the whole
    text; if all parts go, the segment stays as UNKNOWN.
    """

    def parts(t: pa.Table, group: np.ndarray) -> pa.Table:
        return pa.concat_tables(_parts(t, group, min_segment, min_chunk)[:2])

    own = {f.name: f.dataType.simpleString() for f in segments.schema.fields}
    schema = f"media_id {own['media_id']}, seg_idx {own['seg_idx']}, part int, start_ms long, end_ms long, text string, speaker string"
    return _split(segments, words, turns, min_segment, parts, schema)


def split_counters(segments: DataFrame, words: DataFrame, turns: DataFrame, min_segment: int = 500, min_chunk: int = 200) -> DataFrame:
    """(media_id, scanned, skipped_short, split, created): segments looked at, those too short to split, those that several
    speakers share, and the parts that came of these beyond one each."""

    def counters(t: pa.Table, group: np.ndarray) -> pa.Table:
        _, _, of, short, kept = _parts(t, group, min_segment, min_chunk)
        there, at = np.unique(of, return_index=True)
        count = lambda x=None: pa.array(np.bincount(of, x, len(group) and group[-1] + 1)[there].astype(np.int64))
        media = t.filter(pa.compute.equal(t["kind"], 0))["media_id"].take(pa.array(at))
        return pa.table([media, count(), count(short), count(kept > 0), count(np.maximum(kept - 1, 0))], names=["media_id", "scanned", "skipped_short", "split", "created"])

    return _split(segments, words, turns, min_segment, counters, f"media_id {segments.schema['media_id'].dataType.simpleString()}, scanned long, skipped_short long, split long, created long")


def _split(segments: DataFrame, words: DataFrame, turns: DataFrame, min_segment: int, run: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """run on the segments (kind 0), speaker runs (1) and words (2) of whole recordings, sorted by segment, kind and place.
    The window has the rows of a recording lie together, which those that are dealt by it do already."""
    times = [F.col(c).cast("long").alias(c) for c in ("start_ms", "end_ms")]
    rest = segments.where(F.col("end_ms") - F.col("start_ms") >= min_segment)
    rows = segments.select("media_id", "seg_idx", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("pos"), *times, "text", "speaker")
    for kind, side in enumerate((_own_runs(rest, turns).withColumnRenamed("run_idx", "pos"), words.withColumnsRenamed({"input_pos": "pos", "text": "__text"}).withColumnRenamed("word", "text")), 1):
        rows = rows.unionByName(side.select("media_id", "seg_idx", F.lit(kind).alias("kind"), F.col("pos").cast("long").alias("pos"), *times, "text" if kind == 2 else F.lit(None).cast("string").alias("text"), "speaker" if kind == 1 else F.lit(None).cast("string").alias("speaker")))
    place = ["seg_idx", "kind", "pos"]
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("media_id").orderBy(*place)))
    return chains.by_groups(rows, ["media_id"], place, run, schema, together=True)


def _runs_of_words(starts: np.ndarray, ends: np.ndarray, run_starts: np.ndarray, run_ends: np.ndarray, first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The run of each word, or -1, by the rule of assign_words_to_runs: `first` is the first of the `many` runs that are
    offered to it, in order."""
    begin = np.cumsum(many) - many
    word = np.repeat(np.arange(len(many)), many)
    run = np.arange(len(word)) - begin[word] + first[word]
    none = len(run_starts)
    a, b, ra, rb = starts[word], ends[word], run_starts[run], run_ends[run]
    holds = (a + b >= 2 * ra) & (a + b <= 2 * rb)
    share = (np.minimum(b, rb) - np.maximum(a, ra)) / np.maximum(1, b - a)
    held = np.minimum.reduceat(np.where(holds, run, none), begin)
    most = np.maximum.reduceat(share, begin)
    near = np.minimum.reduceat(np.where((share == most[word]) & (share >= 0.5), run, none), begin)
    best = np.where(held < none, held, near)
    return np.where(best < none, best, -1)


def _parts(t: pa.Table, group: np.ndarray, min_segment: int, min_chunk: int) -> tuple[pa.Table, pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of segments that stay whole and of parts, and of each segment its recording, whether it is short, and its number of parts."""
    col = lambda c, fill=0: t[c].fill_null(fill).to_numpy().astype(np.int64)
    kind, seg, start, end, pos = col("kind"), col("seg_idx", -1), col("start_ms"), col("end_ms"), col("pos")
    timed = pa.compute.and_(t["start_ms"].is_valid(), t["end_ms"].is_valid()).to_numpy()
    own = np.cumsum(np.append(True, (np.diff(group) != 0) | (np.diff(seg) != 0))[: len(group)]) - 1  # a segment's rows
    n = own[-1] + 1 if len(own) else 0
    s, r, w = (np.flatnonzero(kind == k) for k in range(3))
    runs = np.bincount(own[r], minlength=n)
    first = np.cumsum(runs) - runs
    w = w[(runs[own[w]] > 1) & timed[w]]
    run = _runs_of_words(start[w], end[w], start[r], end[r], first[own[w]], runs[own[w]]) if len(w) else np.zeros(0, np.int64)
    w, run = w[run >= 0], run[run >= 0]
    heard = np.bincount(run, minlength=len(r))
    w, run = (x[np.argsort(run, kind="stable")] for x in (w, run))
    words = t["text"].take(pa.array(w)).combine_chunks()
    there = words.is_valid()
    words, run = words.filter(there), run[there.to_numpy(zero_copy_only=False)]
    said = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array(np.searchsorted(run, np.arange(len(r) + 1)), pa.int32()), words), " ")
    stays = (runs[own[r]] > 1) & ((heard > 0) | (end[r] - start[r] >= min_chunk))
    kept = np.bincount(own[r[stays]], minlength=n)
    short = timed[s] & (end[s] - start[s] < min_segment)
    split = ~short & (runs[own[s]] > 1) & (kept[own[s]] > 0)

    names = ["media_id", "seg_idx", "part", "start_ms", "end_ms", "text", "speaker"]
    one = s[~split]
    # a short segment has its own speaker, one with one run has that one's
    spoke = np.where(short[~split], one, np.where(runs[own[one]] == 1, r[np.minimum(first[own[one]], len(r) - 1)] if len(r) else 0, -1))
    speaker = t["speaker"].take(pa.array(np.maximum(spoke, 0), mask=spoke < 0))
    speaker = pa.compute.if_else(pa.array(short[~split] | (spoke < 0)), speaker.fill_null("UNKNOWN"), speaker)
    take = lambda c, of: t[c].take(pa.array(of))
    whole = pa.table([take("media_id", one), take("seg_idx", one), pa.array(np.zeros(len(one), np.int32)), take("start_ms", one), take("end_ms", one), take("text", one), speaker], names=names)
    many = kept[own[s[split]]]
    of = np.repeat(s[split], many)
    place = np.cumsum(kept) - kept
    at = np.flatnonzero(stays)[np.repeat(place[own[s[split]]], many) + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)]
    text = pa.compute.if_else(pa.array(heard[at] > 0), said.take(pa.array(at)), take("text", of).combine_chunks())
    parts = pa.table([take("media_id", of), take("seg_idx", of), pa.array(pos[r[at]].astype(np.int32)), take("start_ms", r[at]), take("end_ms", r[at]), text, take("speaker", r[at])], names=names)
    return whole, parts, group[s], short, np.where(split, kept[own[s]], 0)


def atomic_regions(turns: DataFrame) -> DataFrame:
    """(media_id, start_ms, end_ms, kind): stretches with one turn ('single') or more ('overlap') active, by one sweep over starts and ends; equal neighbours are one, silence is left out."""
    ev = turns.select("media_id", F.explode(F.array(F.struct(F.col("start_ms").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_ms").alias("t"), F.lit(-1).alias("d")))).alias("e")).select("media_id", "e.*")
    ev = ev.groupBy("media_id", "t").agg(F.sum("d").alias("d"))
    w = W.partitionBy("media_id").orderBy("t")
    at = ev.select("media_id", F.col("t").alias("start_ms"), F.lead("t").over(w).alias("end_ms"), F.sum("d").over(w).alias("n")).where("end_ms IS NOT NULL AND n > 0")
    at = at.withColumn("kind", F.when(F.col("n") > 1, "overlap").otherwise("single"))
    v = W.partitionBy("media_id").orderBy("start_ms")
    brk = F.coalesce((F.col("kind") != F.lag("kind").over(v)) | (F.col("start_ms") != F.lag("end_ms").over(v)), F.lit(True))
    g = at.withColumn("brk", F.when(brk, 1).otherwise(0)).withColumn("g", F.sum("brk").over(v))
    return g.groupBy("media_id", "g", "kind").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).select("media_id", "start_ms", "end_ms", "kind")


def _absorbed(t: pa.Table, group: np.ndarray, least: int) -> pa.Table:
    """One walk over each group of regions: what is kept so far is long, a short region goes to its left, its right or fuses both."""
    starts, ends, kinds = (t[c].to_pylist() for c in ("start_ms", "end_ms", "kind"))
    edges = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(group)]
    rows: list[int] = []  # a row of each group, for its recording
    out: list[tuple[int, int, str]] = []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        kept: list[tuple[int, int, str]] = []
        i, begin = lo, starts[lo]  # the next region, with what it has been given on its left
        while i < hi:
            end, kind = ends[i], kinds[i]
            if end - begin >= least or i + 1 == hi and not kept:
                kept.append((begin, end, kind))
            elif i + 1 == hi:
                kept[-1] = (kept[-1][0], end, kept[-1][2])
            elif not kept:
                i += 1
                continue  # begin stays: the next one takes it
            else:
                left, right = kept[-1], kinds[i + 1]
                if left[2] == right:
                    i += 1
                    kept[-1] = (left[0], ends[i], right)
                elif left[1] - left[0] >= ends[i + 1] - starts[i + 1]:
                    kept[-1] = (left[0], end, left[2])
                else:
                    i += 1
                    continue
            i += 1
            begin = starts[i] if i < hi else 0
        rows += [lo] * len(kept)
        out += kept
    cols = list(zip(*out, strict=True)) or [[], [], []]
    return pa.table([t["media_id"].take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["media_id", "start_ms", "end_ms", "kind"])


def filter_short_regions(regions: DataFrame, least: int = 250) -> DataFrame:
    """Regions (media_id, start_ms, end_ms, kind) with the first one shorter than `least` given away until none is: an edge
    to its neighbour, between equal kinds all three fuse, else to the longer neighbour (the left on ties).

    Where two long regions follow each other nothing passes from one to the other, so the regions between such places
    are walked through by themselves, where the windows that find them lie. Recordings are not null.
    """
    w = W.partitionBy("media_id").orderBy("start_ms", "end_ms")
    long = F.col("end_ms") - F.col("start_ms") >= least
    cut = F.when(long & F.coalesce(F.lag(long).over(w), F.lit(False)), 1).otherwise(0)
    parts = regions.select("media_id", "start_ms", "end_ms", "kind").withColumn("__cut", cut).withColumn("part", F.sum("__cut").over(w)).drop("__cut")
    return chains.by_groups(parts, ["media_id", "part"], ["start_ms", "end_ms"], lambda t, g: _absorbed(t, g, least), "media_id string, start_ms long, end_ms long, kind string", together=True)


def change_points(regions: DataFrame, tolerance: int = 50) -> DataFrame:
    """(media_id, t_ms): borders between regions; a border within `tolerance` of the running value is averaged into it (half
    to even). The running value is never behind the last border, so a wider step between borders begins anew, and only
    borders that follow each other closely are folded together."""
    w = W.partitionBy("media_id").orderBy("start_ms")
    t = regions.select("media_id", F.lead("start_ms").over(w).alias("t")).where("t IS NOT NULL")
    by_t = W.partitionBy("media_id").orderBy("t")
    far = F.coalesce(F.col("t") - F.lag("t").over(by_t) > tolerance, F.lit(True))
    near = t.withColumn("far", F.when(far, 1).otherwise(0)).withColumn("part", F.sum("far").over(by_t.rowsBetween(W.unboundedPreceding, 0)))
    one = near.groupBy("media_id", "part").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    mean = lambda a, b: F.bround((a + b) / 2).cast("long")
    met = lambda acc, x: x - acc["last"] <= tolerance
    start = F.struct(F.get("ts", F.lit(0)).alias("last"), F.array().cast("array<bigint>").alias("done"))
    step = lambda acc, x: F.struct(F.when(met(acc, x), mean(acc["last"], x)).otherwise(x).alias("last"), F.when(met(acc, x), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["last"]))).alias("done"))
    values = F.aggregate(F.slice("ts", F.lit(2), F.greatest(F.size("ts") - 1, F.lit(0))), start, step, lambda acc: F.concat(acc["done"], F.array(acc["last"])))
    return one.select("media_id", F.explode(values).alias("t_ms"))


def stitch_overlapping_turns(turns: DataFrame, windows: DataFrame, overlap: int) -> DataFrame:
    """Turns of overlapping analysis windows (window_id, local times; windows: media_id, window_id, start_ms, end_ms, is_first, is_last) in recording time, each window giving the part without half of the overlap at its inner edges."""
    w = windows.select("media_id", "window_id", F.col("start_ms").alias("w0"), (F.col("start_ms") + F.when(F.col("is_first"), 0).otherwise(overlap // 2)).alias("lo"), (F.col("end_ms") - F.when(F.col("is_last"), 0).otherwise(overlap // 2)).alias("hi"))
    j = turns.join(w, ["media_id", "window_id"])
    return j.select("media_id", F.greatest(F.col("start_ms") + F.col("w0"), "lo").alias("start_ms"), F.least(F.col("end_ms") + F.col("w0"), "hi").alias("end_ms"), "speaker").where("end_ms > start_ms")


def best_assignment(gain: list[list[int]]) -> int:
    """The largest sum of entries with no two in one row or column (shortest augmenting paths); entries are not negative."""
    if gain and len(gain) > len(gain[0]):
        gain = [list(c) for c in zip(*gain, strict=True)]
    n, m = len(gain), len(gain[0]) if gain else 0
    u, v, match = [0] * (n + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j, way = i, 0, [0] * (m + 1)
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while match[j]:
            used[j] = True
            row, step, at = match[j], float("inf"), 0
            for k in range(1, m + 1):
                if not used[k]:
                    cost = -gain[row - 1][k - 1] - u[row] - v[k]
                    if cost < least[k]:
                        least[k], way[k] = cost, j
                    if least[k] < step:
                        step, at = least[k], k
            for k in range(m + 1):
                if used[k]:
                    u[match[k]] += step
                    v[k] -= step
                else:
                    least[k] -= step
            j = at
        while j:
            match[j] = match[way[j]]
            j = way[j]
    return sum(gain[match[k] - 1][k - 1] for k in range(1, m + 1) if match[k])


def _mapped(ref: np.ndarray, hyp: np.ndarray, ms: np.ndarray) -> int:
    """The most time that a one to one map of speakers explains; ref, hyp (numbers) and ms of each pair that is heard together."""
    rs, r = np.unique(ref, return_inverse=True)
    hs, h = np.unique(hyp, return_inverse=True)
    time = np.zeros((len(rs), len(hs)), np.int64)
    time[r, h] = ms
    return int(best_assignment(time.tolist()))


def _explained(pairs: DataFrame) -> DataFrame:
    """(media_id, best) of (media_id, x, y, ms), in Arrow batches of whole recordings. A recording's rows are its speaker pairs."""

    def run(t: pa.Table, group: np.ndarray) -> pa.Table:
        number = lambda c: np.unique(t[c].to_pandas().fillna("").to_numpy(), return_inverse=True)[1]
        x, y, ms = number("x"), number("y"), t["ms"].to_numpy()
        first = np.flatnonzero(np.diff(group, prepend=-1))
        ends = [*first[1:], len(group)]
        best = [_mapped(x[a:b], y[a:b], ms[a:b]) for a, b in zip(first, ends, strict=True)]
        return pa.table({"media_id": t["media_id"].take(pa.array(first)), "best": pa.array(best, pa.int64())})

    return chains.by_groups(pairs.select("media_id", "x", "y", "ms"), ["media_id"], ["x", "y"], run, "media_id string, best long")


def _swept(turns: DataFrame, collar: int, partitions: int | None = None, width: int = BUCKET_MS) -> DataFrame:
    """(media_id, cell, side, speaker, g, a, b, missed, false_alarm, shared, total) of turns with a side, 'r' or 'h': one
    row per stretch that a speaker talks through in a cell of time, and one without side per cell. a and b are its ends on a
    clock of the cell that stands still inside collars; the sums over a recording's rows are its times. Turns are shuffled
    once, to the cells that they or their collars touch, so a recording of any length is many keys."""
    at = lambda x: F.floor(x / width)
    t = turns.withColumn("cell", F.explode(F.sequence(at(F.col("start_ms") - collar), at(F.greatest("start_ms", "end_ms") + collar))))
    t = t.repartition(*([] if partitions is None else [partitions]), "media_id", "cell")
    key = [F.xxhash64("media_id", "cell").alias("key"), "media_id", "cell"]  # sorts by number before it sorts by name
    lo, hi = F.col("cell") * width, (F.col("cell") + 1) * width
    t = t.select(*key, "side", "speaker", F.col("start_ms").alias("x"), F.col("end_ms").alias("y"), F.greatest("start_ms", lo).alias("s"), F.least("end_ms", hi).alias("e")).withColumn("live", F.col("e") > F.col("s"))
    own = W.partitionBy("key", "media_id", "cell", "side", "speaker", "live").orderBy("s", "e")
    till_now = own.rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumn("brk", F.when(F.col("s") <= F.max("e").over(own.rowsBetween(W.unboundedPreceding, -1)), 0).otherwise(1))
    t = t.withColumn("g", F.sum("brk").over(till_now)).withColumn("till", F.max("e").over(till_now)).withColumn("last", F.coalesce(F.lead("brk").over(own), F.lit(1)))
    is_ref = F.col("side") == "r"
    side_r, side_h = F.when(is_ref, 1).otherwise(0), F.when(is_ref, 0).otherwise(1)

    def event(at: Column, r: Column = F.lit(0), h: Column = F.lit(0), c: int = 0, speaks: bool = False) -> Column:
        return F.struct(at.alias("t"), r.cast("int").alias("r"), h.cast("int").alias("h"), F.lit(c).alias("c"), F.lit(speaks).alias("speaks"))

    def around(border: str) -> Column:
        a, b = F.greatest(F.col(border) - collar, lo), F.least(F.col(border) + collar, hi)
        return F.when(is_ref & (b > a), F.array(event(a, c=1), event(b, c=-1))).otherwise(nothing)

    nothing = F.array().cast("array<struct<t:bigint,r:int,h:int,c:int,speaks:boolean>>")
    live = F.col("live")
    begins = F.when(live & (F.col("brk") == 1), F.array(event(F.col("s"), side_r, side_h, speaks=True))).otherwise(nothing)
    ends = F.when(live & (F.col("last") == 1), F.array(event(F.col("till"), -side_r, -side_h, speaks=True))).otherwise(nothing)
    there = F.when(live, nothing).otherwise(F.array(event(lo)))  # also a recording of empty turns has a row
    e = t.select("key", "media_id", "cell", "side", "speaker", "g", F.explode(F.concat(around("x"), around("y"), begins, ends, there)).alias("v"))
    whose = [F.when(F.col("v.speaks"), F.col(c)).alias(c) for c in ("side", "speaker", "g")]
    e = e.select("key", "media_id", "cell", *whose, "v.t", "v.r", "v.h", "v.c")
    by_t = W.partitionBy("key", "media_id", "cell").orderBy("t")  # rows of one time share their sums
    e = e.select("key", "media_id", "cell", "side", "speaker", "g", "t", *[F.sum(x).over(by_t).alias(x) for x in "rhc"])
    before = lambda c: F.lag(c).over(by_t)
    e = e.withColumn("ms", F.when(before("c") == 0, F.col("t") - before("t")).otherwise(0)).withColumn("r", F.coalesce(before("r"), F.lit(0))).withColumn("h", F.coalesce(before("h"), F.lit(0)))
    e = e.withColumn("clock", F.sum("ms").over(by_t))
    ms, r, h = F.col("ms"), F.col("r"), F.col("h")
    return e.groupBy("media_id", "cell", "side", "speaker", "g").agg(
        F.min("clock").alias("a"), F.max("clock").alias("b"), F.sum(F.greatest(F.lit(0), r - h) * ms).alias("missed"), F.sum(F.greatest(F.lit(0), h - r) * ms).alias("false_alarm"),
        F.sum(F.least(r, h) * ms).alias("shared"), F.sum(r * ms).alias("total"))


def diarization_error(reference: DataFrame, hypothesis: DataFrame, collar: int = 250, partitions: int | None = None) -> DataFrame:
    """(media_id, missed, false_alarm, confusion, total, der): missed, false and confused speaker time over reference time, outside a collar around reference borders; speakers are mapped one to one for the least confusion.

    One sweep per cell of time over the borders of both sides and of the collars gives active speakers and a clock that
    stands still inside collars. What two speakers have in common is the overlap of their stretches on that clock; only the
    matrix of speakers of a recording meets in one place. Turns without recording or times take no part; all turns
    without a name count as one speaker's. Cells are dealt to `partitions`, where given, else to as many as the session says.
    """
    turn = lambda df, side: df.select("media_id", F.lit(side).alias("side"), F.coalesce("speaker", F.lit("")).alias("speaker"), F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms")).where("media_id IS NOT NULL AND start_ms IS NOT NULL AND end_ms IS NOT NULL")
    parts = chains.stored(_swept(turn(reference, "r").unionByName(turn(hypothesis, "h")), collar, partitions))
    spoken = lambda side, name: parts.where((F.col("side") == side) & (F.col("b") > F.col("a"))).select("media_id", "cell", F.col("speaker").alias(name), F.col("a").alias(f"{name}0"), F.col("b").alias(f"{name}1"))
    heard = spoken("r", "x").join(spoken("h", "y"), ["media_id", "cell"]).where("x0 < y1 AND y0 < x1")
    pairs = heard.groupBy("media_id", "x", "y").agg(F.sum(F.least("x1", "y1") - F.greatest("x0", "y0")).alias("ms"))
    sums = parts.groupBy("media_id").agg(*[F.sum(c).alias(c) for c in ("missed", "false_alarm", "shared", "total")])
    out = sums.join(_explained(pairs), "media_id", "left").na.fill(0)
    out = out.select("media_id", "missed", "false_alarm", (F.col("shared") - F.col("best")).alias("confusion"), "total")
    der = (F.col("missed") + F.col("false_alarm") + F.col("confusion")) / F.col("total")
    return out.withColumn("der", F.when(F.col("total") > 0, der).otherwise(0.0))
