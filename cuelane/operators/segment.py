"""Words into segments: breaks by pause, speaker, punctuation and forced points, and caps on length.

All windows share one partitioning (media_id) and order (start_ms, input_pos). A recording is one window partition;
recordings have at most some hundred thousand words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cuelane.operators import chains


def order():
    return W.partitionBy("media_id").orderBy("start_ms", "input_pos")


def joined(col: str, by: str, sep: str = " ") -> Column:
    """Aggregate: values of col joined in the order of another column."""
    return F.array_join(F.sort_array(F.collect_list(F.struct(by, col)))[col], sep)


def _numbered(words: DataFrame, brk: Column) -> DataFrame:
    """seg_idx from break flags: rows with the flag, and the first, begin a segment."""
    flagged = words.withColumn("__brk", F.when(F.coalesce(brk, F.lit(True)), 1).otherwise(0))
    return flagged.withColumn("seg_idx", (F.sum("__brk").over(order()) - 1).cast("int")).drop("__brk")


def pause_break(max_pause: int) -> Column:
    """True after a pause over max_pause ms, null for the first word."""
    return F.col("start_ms") - F.lag("end_ms").over(order()) > max_pause


def speaker_break() -> Column:
    """Both speakers known and different from the word before."""
    return F.coalesce(F.col("speaker") != F.lag("speaker").over(order()), F.lit(False))


def pause_segments(words: DataFrame, max_pause: int = 300) -> DataFrame:
    """seg_idx per word: a new segment where the gap to the word before exceeds max_pause (equal does not break)."""
    return _numbered(words, pause_break(max_pause))


def pause_speaker_segments(words: DataFrame, max_pause: int = 300) -> DataFrame:
    return _numbered(words, pause_break(max_pause) | speaker_break())


def punct_segments(words: DataFrame, max_pause: int = 300) -> DataFrame:
    """Breaks at pauses and after words that end a sentence."""
    return _numbered(words, pause_break(max_pause) | F.lag(F.col("word").rlike("[.!?]$")).over(order()))


def forced_segments(words: DataFrame, forced: DataFrame, max_pause: int = 300, by_speaker: bool = False) -> DataFrame:
    """Breaks at pauses (and speakers) and at forced word indices (media_id, idx) from snap_change_points. Indices are laid
    among the words of their recording and mark the word behind them, so that words need not be dealt by index."""
    numbered = words.withColumn("idx", F.row_number().over(order()) - 1).withColumn("__kind", F.lit(1))
    hit = forced.where("media_id IS NOT NULL AND idx IS NOT NULL").select("media_id", F.col("idx").cast("int").alias("idx"), F.lit(0).alias("__kind"))
    laid = numbered.unionByName(hit, allowMissingColumns=True).withColumn("__hit", F.lag("__kind").over(W.partitionBy("media_id").orderBy("idx", "__kind")) == 0)
    marked = laid.where("__kind = 1")
    brk = pause_break(max_pause) | F.col("__hit")
    return _numbered(marked, brk | speaker_break() if by_speaker else brk).drop("__hit", "__kind", "idx")


def snap_change_points(words: DataFrame, points: DataFrame, max_shift: int = 250) -> DataFrame:
    """(media_id, idx): the inner word boundary (middle between a word's end and the next start) nearest to each change
    point, the earlier one on ties, if within max_shift ms. Both neighbours of a point come from one ordered pass over
    boundaries and points, not from a join of all with all."""
    bounds = words.select("media_id", (F.row_number().over(order()) - 1).alias("idx"), ((F.lag("end_ms").over(order()) + F.col("start_ms")) / 2).alias("t")).where("idx > 0")
    both = bounds.select("media_id", "t", "idx", F.lit(0).alias("kind")).unionByName(points.select("media_id", F.col("t_ms").cast("double").alias("t"), F.lit(None).cast("int").alias("idx"), F.lit(1).alias("kind")))
    before = W.partitionBy("media_id").orderBy("t", "kind", "idx").rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy("media_id").orderBy(F.desc("t"), F.desc("kind"), F.desc("idx")).rowsBetween(W.unboundedPreceding, 0)  # the same order from the end: a growing frame, where a shrinking one would be read anew for each row
    left = F.when(F.col("kind") == 0, F.struct("t", (-F.col("idx")).alias("neg")))  # of boundaries at one time the first counts
    right = F.when(F.col("kind") == 0, F.struct("t", "idx"))
    near = both.select("media_id", "kind", "t", F.max(left).over(before).alias("p"), F.min(right).over(after).alias("n")).where("kind = 1")
    dp, dn = F.col("t") - F.col("p.t"), F.col("n.t") - F.col("t")
    chosen = near.select("media_id", F.when(dn.isNull() | (dp <= dn), F.struct(dp.alias("d"), (-F.col("p.neg")).alias("idx"))).otherwise(F.struct(dn.alias("d"), F.col("n.idx").alias("idx"))).alias("c"))
    return chosen.where((F.col("c.d") <= max_shift)).select("media_id", "c.idx").distinct()


def segment_bounds(words: DataFrame) -> DataFrame:
    """(media_id, seg_idx, start_ms, end_ms, n_words) of segment_rows, without texts."""
    return words.groupBy("media_id", "seg_idx").agg(F.min("start_ms").alias("start_ms"), F.max_by("end_ms", F.struct("start_ms", "input_pos")).alias("end_ms"), F.count("*").alias("n_words"))


def segment_rows(words: DataFrame) -> DataFrame:
    """One row per (media_id, seg_idx): start of the first word, end of the last, text without double quotes, the
    speaker with most words (ties: heard first), mixed_speakers, and the words in order. Words have a start. Text, speaker
    and words are lists of their own, so that what a query does not read is not put together."""
    rows = words.groupBy("media_id", "seg_idx").agg(
        F.min("start_ms").alias("start_ms"), F.max_by("end_ms", F.struct("start_ms", "input_pos")).alias("end_ms"),
        F.sort_array(F.collect_list(F.struct("start_ms", "input_pos", "word"))).alias("said"),
        F.coalesce(F.min("speaker") != F.max("speaker"), F.lit(False)).alias("mixed_speakers"), F.min("speaker").alias("one"),
        F.sort_array(F.collect_list(F.when(F.col("speaker").isNotNull(), F.struct("speaker", "input_pos")))).alias("turns"),
        F.sort_array(F.collect_list(F.struct("start_ms", "input_pos", "word", "end_ms", "score", "speaker"))).alias("ws"),
    )
    text = F.trim(F.replace(F.array_join("said.word", " "), F.lit('"'), F.lit("")))
    return rows.select(
        "media_id", "seg_idx", "start_ms", "end_ms", text.alias("text"), F.when(F.col("mixed_speakers"), _most(rows, "turns")).otherwise(F.col("one")).alias("speaker"), "mixed_speakers",
        F.transform("ws", lambda w: F.struct(w["word"].alias("word"), w["start_ms"].alias("start_ms"), w["end_ms"].alias("end_ms"), w["score"].alias("score"), w["speaker"].alias("speaker"))).alias("words"),
    )


def _most(rows: DataFrame, turns: str) -> Column:
    """The speaker with most entries in a list of (speaker, input_pos) sorted so, of equal ones the one with the least input_pos."""
    place = rows.schema[turns].dataType.elementType["input_pos"].dataType.simpleString()
    none = F.lit(None).cast(f"struct<less:int,input_pos:{place},speaker:string>")

    def step(acc: Column, x: Column) -> Column:
        same = acc["now"]["speaker"] == x["speaker"]
        less = F.when(same, acc["now"]["less"] - 1).otherwise(F.lit(-1))
        now = F.struct(less.alias("less"), F.when(same, acc["now"]["input_pos"]).otherwise(x["input_pos"]).alias("input_pos"), x["speaker"].alias("speaker"))
        return F.struct(now.alias("now"), F.least(acc["best"], now).alias("best"))

    return F.aggregate(turns, F.struct(none.alias("now"), none.alias("best")), step, lambda acc: acc["best"]["speaker"])


def drop_bracketed(segments: DataFrame) -> DataFrame:
    """Without segments whose text is one bracketed remark."""
    t = F.trim("text")
    return segments.where(~(t.startswith("[") & t.endswith("]")))


def word_segments(words: DataFrame) -> DataFrame:
    """One segment per word."""
    return words.select("media_id", (F.row_number().over(order()) - 1).alias("seg_idx"), "start_ms", "end_ms", F.col("word").alias("text"), "speaker")


def gap_segments(segments: DataFrame, durations: DataFrame) -> DataFrame:
    """(media_id, start_ms, end_ms) of the silence between a segment's end and the next start, before the first and after the last (durations: media_id, duration_ms)."""
    w = W.partitionBy("media_id").orderBy("start_ms", "seg_idx")
    inner = segments.select("media_id", F.coalesce(F.lag("end_ms").over(w), F.lit(0)).alias("a"), F.col("start_ms").alias("b"))
    last = segments.groupBy("media_id").agg(F.max_by("end_ms", F.struct("start_ms", "seg_idx")).alias("last"))
    tail = durations.join(last, "media_id", "left").select("media_id", F.coalesce("last", F.lit(0)).alias("a"), F.col("duration_ms").alias("b"))
    return inner.unionByName(tail).where("b > a").select("media_id", F.col("a").alias("start_ms"), F.col("b").alias("end_ms"))


# Rules that depend on earlier cuts: the next cut of each word, and the chain of cuts from the first word on.


def punct_comma_segments(words: DataFrame, max_pause: int = 300, max_ms: int = 8000) -> DataFrame:
    """seg_idx per word: breaks at pauses, after sentence ends, and after a comma once the segment has lasted max_ms.

    Pauses and sentence ends begin an island whatever came before. Inside an island a comma's break depends on the one
    before, and only words behind a comma that ends max_ms or more after the island's start can begin a segment: these few
    are walked through in order, where they lie, and the breaks are dealt to the words. Recordings are not null.
    """
    island = ["media_id", "__isl"]
    inside = W.partitionBy(*island).orderBy("start_ms", "input_pos")
    n = punct_segments(words, max_pause).withColumnRenamed("seg_idx", "__isl").withColumn("__k", F.row_number().over(inside).cast("long") - 1)
    here = F.col("start_ms").cast("long")
    behind = n.select(*island, F.col("__k").alias("k"), here.alias("start_ms"), F.lag("end_ms").over(inside).cast("long").alias("till"), F.lag(F.col("word").endswith(",")).over(inside).alias("comma"), F.first(here).over(inside).alias("begin"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, begin = None, 0
        for batch in batches:
            cuts = []
            for i, (media, isl, _, start, till, first) in enumerate(zip(*[c.to_pylist() for c in batch.columns], strict=True)):
                if (media, isl) != last:
                    last, begin = (media, isl), first
                if till - begin >= max_ms:
                    cuts.append(i)
                    begin = start
            yield batch.select([0, 1, 2]).take(pa.array(cuts, pa.int64()))

    late = behind.where(f"comma AND till - begin >= {max_ms}").select(*island, "k", "start_ms", "till", "begin")
    cuts = chains.passed(late, [*island, "k"], walk, f"media_id {n.schema['media_id'].dataType.simpleString()}, __isl int, __k long")
    out = n.join(cuts.withColumn("__cut", F.lit(True)), [*island, "__k"], "left")
    return _numbered(out, (F.col("__k") == 0) | F.coalesce("__cut", F.lit(False))).drop("__k", "__cut", "__isl")


#: Words of a stretch that is cut to the end in one place: each cut looks no further than its reach, so that such a stretch costs its words.
LOCAL = 65_536
#: Rules of split_words: marks or the largest gap decide where a stretch is cut, and what happens where no mark is in reach.
RULES = ("recursive", "max_gap", "halving")


def _reach(t: pa.Table, group: np.ndarray, rule: str, cap: int, width: int) -> pa.Table:
    """Where the next cut is if a stretch begins at a word, for all words of a block at once: the words in reach are looked
    at by their distance, nearest first, until no word of the batch reaches further."""
    col = lambda c: t[c].combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    start, end, k, mark, after, hi, until = (col(c) for c in ("start_ms", "end_ms", "k", "mark", "after_ms", "hi", "until_ms"))
    n = len(k)
    best, comma, gap = np.full(n, -1), np.full(n, -1), np.full(n, np.iinfo(np.int64).min)
    live, d = np.flatnonzero((col("edge") == 0) & (until - start > cap) & (hi - k > 1)), 0
    open_rows = live
    while len(live):
        at = live + d
        live = live[(at < n)]
        at = live + d
        same = (group[at] == group[live]) & (start[at] <= start[live] + cap)
        live, at = live[same], at[same]
        fits = (end[at] <= start[live] + cap) & (k[at] <= hi[live] - 2)
        row, at = live[fits], at[fits]
        if rule == "max_gap":
            wide = after[at] - end[at] >= gap[row]
            row, at = row[wide], at[wide]
            gap[row], best[row] = after[at] - end[at], at
        else:
            best[row[mark[at] == 2]] = at[mark[at] == 2]
            comma[row[mark[at] == 1]] = at[mark[at] == 1]
        d += 1
    if rule == "max_gap":
        best[open_rows] = np.where(best[open_rows] < 0, open_rows, best[open_rows])  # no word in reach: the first word alone
    else:
        best = np.where(best < 0, comma, best)
    own = np.flatnonzero(col("edge") == 0)
    to, lo = best[own], col("lo")[own]
    found = to >= 0
    nxt = pa.array(np.where(found, k[to] + 1 - lo, 0), mask=~found)
    nxt_b = pa.array(np.where(found, after[to] // width, 0), mask=~found)
    names = ["media_id", "seg_idx", "lo", "b"]
    return pa.table([t[c].take(pa.array(own)) for c in names] + [pa.array(k[own] - lo), nxt, nxt_b], names=[*names, "k", "nxt", "nxt_b"])


def _finished(t: pa.Table, group: np.ndarray, rule: str, cap: int) -> pa.Table:
    """All cuts of stretches that are short enough to be looked at in one place."""
    edges = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(group)]
    start, end, mark = (t[c].to_pylist() for c in ("start_ms", "end_ms", "mark"))
    cuts: list[int] = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        todo = [(a, b)]
        while todo:
            lo, hi = todo.pop()
            begin, total = start[lo], end[hi - 1] - start[lo]
            if hi - lo < 2 or total <= cap:
                continue
            stop = comma = wide = None
            i = lo
            while i < hi - 1 and start[i] - begin <= cap:
                if end[i] - begin <= cap:
                    stop, comma = (i if mark[i] == 2 else stop), (i if mark[i] == 1 else comma)
                    gap = start[i + 1] - end[i]
                    wide = (gap, i) if wide is None or gap >= wide[0] else wide
                i += 1
            if rule == "max_gap":
                at = [lo + 1 if wide is None else wide[1] + 1]
            elif stop is not None or comma is not None:
                at = [(comma if stop is None else stop) + 1]
            else:
                parts = max(2, -(-total // cap))
                part = [min(parts - 1, (x - begin) * parts // total) for x in start[lo:hi]] if rule == "recursive" else [0]
                at = [lo + j for j in range(1, len(part)) if part[j] != part[j - 1]] or [lo + (hi - lo) // 2]
            cuts += at
            todo += zip([lo, *at], [*at, hi], strict=True)
    return t.select(["media_id", "seg_idx", "k"]).take(pa.array(cuts, pa.int64()))


def _cuts(spans: DataFrame, rule: str, cap: int) -> tuple[DataFrame, DataFrame]:
    """One round over the words of open stretches: the cuts (media_id, seg_idx, k) that follow one from the other, and the
    words of what no cut could be found for, as stretches of their own."""
    width = max(cap, 60_000)  # of a block; a word's reach ends in the next one at most
    blocks = spans.withColumn("b", F.expr(f"start_ms div {width}")).withColumn("edge", F.lit(0))
    edges = blocks.where(f"start_ms - b * {width} <= {cap}").withColumn("b", F.col("b") - 1).withColumn("edge", F.lit(1))
    schema = "media_id string, seg_idx int, lo long, b long, k long, nxt long, nxt_b long"
    key = ["media_id", "seg_idx", "lo"]
    points = chains.stored(chains.by_groups(blocks.unionByName(edges), [*key, "b"], ["k"], lambda t, g: _reach(t, g, rule, cap, width), schema))
    reached = chains.stored(chains.chain(points, key))
    cuts = reached.where("k > 0").select("media_id", "seg_idx", (F.col("lo") + F.col("k")).alias("k"))
    if rule == "max_gap":
        return cuts, spans.limit(0)
    last = reached.groupBy(*key).agg((F.max("k") + F.col("lo")).alias("from"))
    rest = spans.join(last, key).where("k >= from").withColumn("begin", F.min("start_ms").over(W.partitionBy(*key)))
    rest = rest.where(f"until_ms - begin > {cap} AND hi - from > 1")
    part = F.expr("IF(k - from < (hi - from) div 2, 0, 1)")
    if rule == "recursive":
        n = F.greatest(F.lit(2), F.ceil((F.col("until_ms") - F.col("begin")) / F.lit(cap)))
        by_time = lambda c: F.least(n - 1, F.floor((F.col(c) - F.col("begin")) * n / (F.col("until_ms") - F.col("begin"))))
        part = F.when(by_time("last_ms") == 0, part).otherwise(by_time("start_ms"))  # words that all begin in the first part are halved
    group = W.partitionBy(*key, "part")
    ends = group.orderBy("k").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    parts = rest.withColumn("part", part).select(
        "media_id", "seg_idx", F.min("k").over(group).alias("lo"), (F.max("k").over(group) + 1).alias("hi"), "k", "start_ms", "end_ms", "after_ms", "mark", F.last("end_ms").over(ends).alias("until_ms"), F.last("start_ms").over(ends).alias("last_ms"),
    )
    parts = chains.stored(parts)
    cuts = cuts.unionByName(parts.where("k = lo").select("media_id", "seg_idx", "k"))
    return cuts, parts.withColumn("begin", F.min("start_ms").over(W.partitionBy("media_id", "seg_idx", "lo"))).where(f"until_ms - begin > {cap} AND hi - lo > 1").drop("begin")


def split_words(words: DataFrame, rule: str = "recursive", cap: int = 11500, local: int = LOCAL, parts: int | None = None) -> DataFrame:
    """Words with seg_idx of segments cut until none is longer than cap ms (or is one word), renumbered in order.

    recursive: after the last sentence end whose word ends within cap of the start, else the last comma, else into equal
    spans of time. halving: the same, else in the middle. max_gap: at the largest gap in reach, the last of equal ones.
    The last word of a stretch is never its mark. Stretches of up to `local` words are cut to the end at once, where they
    lie; only longer ones are stored. For these each round finds all cuts that marks or gaps give, in blocks of time, and cuts what is left over; words of
    short segments take no part. `parts` is the number of partitions that words lie in by recording, the session's if not
    given. Recordings are not null.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    inside = W.partitionBy("media_id", "seg_idx").orderBy("start_ms", "input_pos")
    whole = inside.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    n = words.withColumn("k", F.row_number().over(inside).cast("long") - 1)
    end = F.rtrim("word")
    mark = F.when(end.rlike("[.!?]\\s*$"), 2).when(F.col("word").rlike(",\\s*$"), 1).otherwise(0).cast("long")
    spans = n.select(
        "media_id", F.col("seg_idx").cast("int").alias("seg_idx"), F.lit(0).cast("long").alias("lo"), F.count("*").over(whole).alias("hi"), "k", "start_ms", "end_ms", F.lead("start_ms").over(inside).alias("after_ms"), mark.alias("mark"),
        F.last("end_ms").over(whole).alias("until_ms"), F.last("start_ms").over(whole).alias("last_ms"), F.first("start_ms").over(whole).alias("begin"),
    ).where(f"until_ms - begin > {cap} AND hi > 1").drop("begin")
    finish = lambda t, g: _finished(t, g, rule, cap)
    short = spans.where(f"hi - lo <= {local}").select("media_id", "seg_idx", "k", "start_ms", "end_ms", "mark")
    cuts = chains.by_groups(short, ["media_id", "seg_idx"], ["k"], finish, "media_id string, seg_idx int, k long", together=True)
    # a count of words tells which recordings can have longer ones, without making the stretches
    large = words.groupBy("media_id").agg(F.count("*").alias("__n")).where(f"__n > {local}").select("media_id")
    spans = None if large.isEmpty() else chains.stored(spans.where(f"hi - lo > {local}").join(large, "media_id", "left_semi"))
    while spans is not None and not spans.isEmpty():
        found, spans = _cuts(spans, rule, cap)
        cuts = cuts.unionByName(found).unionByName(chains.by_groups(spans.where(f"hi - lo <= {local}"), ["media_id", "seg_idx", "lo"], ["k"], finish, "media_id string, seg_idx int, k long"))
        spans = spans.where(f"hi - lo > {local}")
    # cuts are laid among the words of their recording, so that words need not be dealt by place
    parts = parts or int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = n.withColumn("__kind", F.lit(1)).unionByName(cuts.withColumn("__kind", F.lit(0)).repartition(parts, "media_id"), allowMissingColumns=True)
    order = W.partitionBy("media_id").orderBy("seg_idx", "k", "__kind")
    cut = laid.withColumn("__cut", F.lag("__kind").over(order) == 0).where("__kind = 1")
    first = F.when((F.col("k") == 0) | F.col("__cut"), 1).otherwise(0)
    return cut.withColumn("seg_idx", (F.sum(first).over(order) - 1).cast("int")).drop("k", "__cut", "__kind")


def split_long(segments: DataFrame, rule: str = "recursive", cap: int = 11500) -> DataFrame:
    """Segments (with words) cut by split_words; times, text and speaker are made anew from the words of each part."""
    w = segments.select("media_id", "seg_idx", F.posexplode("words").alias("input_pos", "w")).select("media_id", "seg_idx", "input_pos", "w.*")
    return segment_rows(split_words(w, rule, cap))


def resegment(words: DataFrame, points: DataFrame, max_pause: int = 300, padding: int = 100, cap: int = 11500, parts: int | None = None) -> DataFrame:
    """The whole job: pad, snap change points, break, cap, drop bracketed remarks."""
    from cuelane.operators.words import pad_words

    padded = pad_words(words, padding)
    forced = chains.stored_as_dealt(snap_change_points(padded, points))  # few rows, read twice
    return drop_bracketed(segment_rows(split_words(forced_segments(padded, forced, max_pause, True), "recursive", cap, parts=parts)))
