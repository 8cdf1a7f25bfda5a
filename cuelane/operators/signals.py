"""Signal tables: frames, levels, pitch, blends, mixing. Sample tables are (media_id, pos, sample int or x double)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Samples of a block. Work on samples meets in (media_id, block), so that a long recording is many keys.
BLOCK = 65_536


def _blocked(pcm: DataFrame, block: int) -> DataFrame:
    """Rows with a place, and the block that they lie in."""
    return pcm.where("media_id IS NOT NULL AND pos IS NOT NULL").withColumn("block", F.expr(f"pos div {block}"))


def _per_block(blocked: DataFrame, parts: dict[str, tuple[Column, str]]) -> DataFrame:
    """(media_id, block, parts...) where each part, a column with the aggregate (sum, min or max) that makes it and puts it
    together, holds for the whole recording. Only one row per block crosses from block to recording."""
    own = blocked.groupBy("media_id", "block").agg(*[getattr(F, how)(c).alias(n) for n, (c, how) in parts.items()])
    whole = W.partitionBy("media_id")
    return own.select("media_id", "block", *[getattr(F, how)(n).over(whole).alias(n) for n, (_, how) in parts.items()])


def frame_energy(pcm: DataFrame, frame: int) -> DataFrame:
    """(media_id, frame_idx, rms): root mean square per `frame` samples; a last part counts as a frame."""
    return pcm.groupBy("media_id", F.expr(f"pos div {frame}").alias("frame_idx")).agg(F.sqrt(F.avg(F.col("sample").cast("double") * F.col("sample"))).alias("rms"))


def energy_thresholds(frames: DataFrame, floor: float = 150.0) -> DataFrame:
    """(media_id, high, low): of positive frames, the larger of 0.8 of the median and 0.6 of the 90th percentile (by rank, half to even), at least `floor` if the largest frame exceeds it, at most the largest; low is half."""
    f = frames.where("rms > 0").withColumn("rn", F.row_number().over(W.partitionBy("media_id").orderBy("rms")) - 1)
    n = frames.where("rms > 0").groupBy("media_id").agg(F.count("*").alias("n"), F.median("rms").alias("med"), F.max("rms").alias("top"))
    p = f.join(n, "media_id").where(F.col("rn") == F.bround(F.lit(0.9) * (F.col("n") - 1)).cast("long")).select("media_id", F.col("rms").alias("p90"))
    high = F.greatest(0.8 * F.col("med"), 0.6 * F.col("p90"))
    high = F.least(F.when(F.col("top") > floor, F.greatest(high, F.lit(floor))).otherwise(high), F.col("top"))
    return n.join(p, "media_id").select("media_id", high.alias("high"), (high / 2).alias("low"))


def refine_words(words: DataFrame, frames: DataFrame, thresholds: DataFrame, frame_ms: int = 10, least_ms: int = 20) -> DataFrame:
    """Words with start and end moved to the first and last frame of their window above the high threshold; without any,
    the frame-aligned window. A start is not before the refined end of the word before, and a word lasts least_ms: the
    running end is a maximum of shifted sums, so two window passes do."""
    act = frames.join(thresholds.select("media_id", "high"), "media_id").where("rms >= high").select("media_id", "frame_idx", (F.expr("frame_idx div 100")).alias("b"))
    w = words.withColumn("f0", F.expr(f"start_ms div {frame_ms}")).withColumn("f1", F.expr(f"greatest(start_ms div {frame_ms}, (end_ms - 1) div {frame_ms})"))
    spread = w.select("media_id", "input_pos", "f0", "f1", F.explode(F.expr("sequence(f0 div 100, f1 div 100)")).alias("b"))
    hit = spread.join(act, ["media_id", "b"]).where("frame_idx BETWEEN f0 AND f1").groupBy("media_id", "input_pos").agg(F.min("frame_idx").alias("lo"), F.max("frame_idx").alias("hi"))
    j = w.join(hit, ["media_id", "input_pos"], "left")
    j = j.withColumn("s", F.coalesce("lo", "f0") * frame_ms).withColumn("e", (F.coalesce("hi", "f1") + 1) * frame_ms)
    order = W.partitionBy("media_id").orderBy("start_ms", "input_pos")
    i = F.row_number().over(order)
    a = j.withColumn("i", i).withColumn("a", F.greatest("e", F.col("s") + least_ms) - least_ms * F.col("i"))
    end = a.withColumn("end", F.max("a").over(order) + least_ms * F.col("i"))
    return end.withColumn("begin", F.greatest("s", F.coalesce(F.lag("end").over(order), F.lit(0)))).select("media_id", "input_pos", "word", F.col("begin").alias("start_ms"), F.col("end").alias("end_ms"))


def quiet_runs(pcm: DataFrame, least: int, level: float = 1e-3, block: int = BLOCK) -> DataFrame:
    """(media_id, s, e): runs [s, e) of at least `least` samples x within the level. Runs are found per block; only those
    that are long enough or touch an edge of their block meet their neighbours."""
    quiet = _blocked(pcm, block).where(F.abs("x") <= level).select("media_id", "block", "pos")
    own = quiet.withColumn("g", F.col("pos") - F.row_number().over(W.partitionBy("media_id", "block").orderBy("pos")))
    own = own.groupBy("media_id", "block", "g").agg(F.min("pos").cast("long").alias("s"), (F.max("pos") + 1).cast("long").alias("e"))
    own = own.where((F.col("e") - F.col("s") >= least) | (F.col("s") == F.col("block") * block) | (F.col("e") == (F.col("block") + 1) * block))
    by_pos = W.partitionBy("media_id").orderBy("s")
    new = F.coalesce(F.lag("e").over(by_pos) < F.col("s"), F.lit(True))
    own = own.withColumn("new", F.when(new, 1).otherwise(0)).withColumn("run", F.sum("new").over(by_pos))
    return own.groupBy("media_id", "run").agg(F.min("s").alias("s"), F.max("e").alias("e")).where(F.col("e") - F.col("s") >= least).select("media_id", "s", "e")


def cuts_between(runs: Iterable[tuple[int, int]], n: int, rate: int, most: int, need: int) -> Iterator[tuple[int, int]]:
    """Chunks of at most `most` of n samples, given the quiet runs in order: a chunk ends in the middle of the last `need`
    quiet samples that lie in its final second, else at the limit. Holds one run at a time."""
    lo, till = 0, None
    for s, e in [*runs, (n, n)] if isinstance(runs, list) else runs:
        while lo < n and (lo + most >= n or s > lo + most - need):
            hi = min(n, lo + most)
            if hi < n and till is not None:
                at = min(till, hi) - need
                if at >= max(lo, hi - rate):
                    hi = at + need // 2
            yield lo, hi
            lo = max(hi, lo + 1)
        till = e


def silence_chunks(pcm: DataFrame, rate: int, longest_s: float = 30.0, quiet_s: float = 0.2, level: float = 1e-3, block: int = BLOCK) -> DataFrame:
    """(media_id, chunk, start, end) in samples x (doubles at pos 0, 1, ...): chunks of at most longest_s, cut in the last
    quiet run of quiet_s within the final second, else at the limit; chunks that stay below 1e-4 are dropped.

    Samples are reduced to quiet runs block by block. The runs of a recording, at most one per quiet_s of sound, pass in
    order through one task, which holds one run at a time; chunks then meet loud samples in stretches of longest_s. A
    null sample is neither quiet nor loud; rows without recording or place take no part.
    """
    most, need = max(1, int(longest_s * rate)), max(1, int(quiet_s * rate))
    pcm = pcm.select("media_id", F.col("pos").cast("long").alias("pos"), "x").where("media_id IS NOT NULL AND pos IS NOT NULL")
    size = pcm.groupBy("media_id").agg((F.max("pos") + 1).alias("e")).select("media_id", F.lit(-1).cast("long").alias("s"), "e")
    # dealt by a hash of its own: Spark would leave out a dealing by media_id, as both parts are dealt so, and then put their partitions together differently
    rows = size.unionByName(quiet_runs(pcm, need, level, block)).repartition(F.xxhash64("media_id")).sortWithinPartitions("media_id", "s")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

        def chunks() -> Iterator[tuple]:
            it = each()
            head = next(it, None)
            while head is not None:
                media, _, n = head
                head = None

                def runs() -> Iterator[tuple[int, int]]:
                    nonlocal head
                    for m, s, e in it:
                        if s < 0:
                            head = (m, s, e)
                            break
                        yield s, e
                    yield n, n

                for lo, hi in cuts_between(runs(), n, rate, most, need):
                    yield media, lo, hi

        held: list[tuple] = []
        for row in chunks():
            held.append(row)
            if len(held) == 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], ["media_id", "start", "end"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], ["media_id", "start", "end"])

    kinds = [pa.string(), pa.int64(), pa.int64()]
    cuts = rows.select("media_id", "s", "e").mapInArrow(cut, "media_id string, start long, end long")
    spread = cuts.where("end > start").withColumn("b", F.explode(F.expr(f"sequence(start div {most}, (end - 1) div {most})")))
    loud = pcm.where(F.abs("x") >= 1e-4).select("media_id", F.expr(f"pos div {most}").alias("b"), "pos")
    on = (F.col("c.media_id") == F.col("l.media_id")) & (F.col("c.b") == F.col("l.b")) & (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end"))
    kept = spread.alias("c").join(loud.alias("l"), on, "left_semi").select("media_id", "start", "end").distinct()
    return kept.select("media_id", (F.row_number().over(W.partitionBy("media_id").orderBy("start")) - 1).alias("chunk"), "start", "end")


def pitch_of(x: np.ndarray, rate: int, low: float = 50.0, high: float = 500.0) -> float:
    """Pitch of one frame by autocorrelation under a Hann window; 0 if the peak is below a tenth of the energy."""
    x = (x - x.mean()) * np.hanning(len(x))
    a = np.correlate(x, x, "full")[len(x) - 1 :]
    lo, hi = max(1, int(rate / high)), min(len(x) - 1, int(rate / low))
    if a[0] < 1e-10 or hi <= lo:
        return 0.0
    lag = lo + int(np.argmax(a[lo : hi + 1]))
    return rate / lag if a[lag] / a[0] >= 0.1 else 0.0


def frame_pitch(frames: DataFrame, rate: int, low: float = 50.0, high: float = 500.0) -> DataFrame:
    """(media_id, frame_idx, rms, hz) of frames with an array column samples, in Arrow batches."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            xs = [np.asarray(s, float) for s in pdf["samples"]]
            yield pd.DataFrame({"media_id": pdf["media_id"], "frame_idx": pdf["frame_idx"], "rms": [float(np.sqrt((x * x).mean())) for x in xs], "hz": [pitch_of(x, rate, low, high) for x in xs]})

    return frames.select("media_id", "frame_idx", "samples").mapInPandas(run, "media_id string, frame_idx long, rms double, hz double")


def pitch_summary(pitched: DataFrame, least_rms: float = 0.01) -> DataFrame:
    """Mean, median, deviation and share of voiced frames (rms at least least_rms and pitch above 0) per recording; zeros without any."""
    v = (F.col("rms") >= least_rms) & (F.col("hz") > 0)
    hz = F.when(v, F.col("hz"))
    zero = F.lit(0.0)
    return pitched.groupBy("media_id").agg(F.coalesce(F.avg(hz), zero).alias("mean_hz"), F.coalesce(F.median(hz), zero).alias("median_hz"), F.coalesce(F.stddev_samp(hz), zero).alias("std_hz"), (F.count_if(v) / F.count("*")).alias("voiced"))


def signal_prepare(pcm: DataFrame, block: int = BLOCK) -> DataFrame:
    """x without its mean, scaled to a peak of 1 (silent recordings stay 0; x of a null sample is null). Sums and extremes
    are put together from one row per block, and samples meet them by block. Rows without recording or place take no part."""
    b = _blocked(pcm, block)
    whole = _per_block(b, {"__sum": (F.col("sample"), "sum"), "__n": (F.when(F.col("sample").isNotNull(), 1).otherwise(0), "sum"), "__low": (F.col("sample"), "min"), "__high": (F.col("sample"), "max")})
    mean = F.col("__sum") / F.col("__n")
    whole = whole.select("media_id", "block", mean.alias("__mean"), F.greatest(F.abs(F.col("__high") - mean), F.abs(F.col("__low") - mean)).alias("__peak"))
    x = F.when(F.col("__peak") > 0, (F.col("sample") - F.col("__mean")) / F.col("__peak")).otherwise(F.when(F.col("sample").isNotNull(), 0.0))
    return b.join(whole, ["media_id", "block"]).withColumn("x", x).drop("block", "__mean", "__peak")


def clip_levels(pcm: DataFrame, full: float = 32768.0) -> DataFrame:
    """(media_id, dbfs, peak_dbfs), null when silent."""
    g = pcm.groupBy("media_id").agg(F.sqrt(F.avg(F.col("sample").cast("double") * F.col("sample"))).alias("r"), F.max(F.abs("sample")).alias("p"))
    db = lambda c: F.when(F.col(c) > 0, 20 * F.log10(F.col(c) / full))
    return g.select("media_id", db("r").alias("dbfs"), db("p").alias("peak_dbfs"))


def ensemble_weights(outputs: DataFrame) -> DataFrame:
    """(media_id, model, weight): voice power over noise power (v, n), scaled to a sum of 1; all zero: equal."""
    g = outputs.groupBy("media_id", "model").agg((F.avg(F.col("v") * F.col("v")) / (F.avg(F.col("n") * F.col("n")) + 1e-9)).alias("r"))
    w = W.partitionBy("media_id")
    total = F.sum("r").over(w)
    return g.select("media_id", "model", F.when(total > 0, F.col("r") / total).otherwise(1 / F.count("*").over(w)).alias("weight"))


def ensemble_blend(outputs: DataFrame, weights: DataFrame, mix: float = 0.5) -> DataFrame:
    """(media_id, pos, voice, background): weighted sums of the models' outputs; the background is blended with what the
    voice leaves of the mixture (n + v, clipped to 1), and silenced where a recording is pure speech."""
    j = outputs.join(weights, ["media_id", "model"]).groupBy("media_id", "pos").agg(F.sum(F.col("weight") * F.col("v")).alias("voice"), F.sum(F.col("weight") * F.col("n")).alias("bg"), F.avg(F.col("v") + F.col("n")).alias("mixture"))
    left = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("mixture") - F.col("voice")))
    b = j.withColumn("background", mix * F.col("bg") + (1 - mix) * left)
    db = lambda c: 10 * F.log10(F.avg(F.col(c) * F.col(c)) + 1e-12)
    gate = b.groupBy("media_id").agg(db("background").alias("nd"), db("voice").alias("vd")).select("media_id", ((F.col("nd") - F.col("vd") <= -25) | (F.col("nd") <= -50)).alias("pure"))
    return b.join(gate, "media_id").select("media_id", "pos", "voice", F.when(F.col("pure"), 0.0).otherwise(F.col("background")).alias("background"))


def overlap_add(chunks: DataFrame) -> DataFrame:
    """(media_id, pos, x): overlapping chunk samples (chunk_pos, size, fade, pos, x) averaged with linear fades from 1e-3 to 1."""
    edge = F.least("chunk_pos", F.col("size") - 1 - F.col("chunk_pos"))
    w = F.when(edge < F.col("fade"), F.lit(1e-3) + (1 - 1e-3) * edge / F.greatest(F.lit(1), F.col("fade"))).otherwise(1.0)
    return chunks.withColumn("w", w).groupBy("media_id", "pos").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("x"))


def normalize_peak(arrays: DataFrame, target: float = 0.95) -> DataFrame:
    """samples (array) scaled to the target peak (0.95 if the target is not in (0, 1]); silent arrays stay."""
    t = target if 0 < target <= 1 else 0.95
    peak = F.array_max(F.transform("samples", F.abs))
    return arrays.withColumn("samples", F.when(peak > 0, F.transform("samples", lambda x: x * (t / peak))).otherwise(F.col("samples")))


def nonsilent_end(pcm: DataFrame, window: int = 80, drop_db: float = 18.0, block: int = BLOCK) -> DataFrame:
    """(media_id, end): one past the last sample position whose trailing window lies above the recording's level minus
    drop_db; the length for short or silent recordings. A block brings the samples that windows of the next one reach
    back to, so windows are worked out block by block; the level is put together from one row per block."""
    block = max(block, window)
    power = F.col("sample").cast("double") * F.col("sample")
    b = _blocked(pcm, block).select("media_id", "block", F.col("pos").cast("long").alias("pos"), power.alias("p"))
    whole = _per_block(b, {"__sum": (F.col("p"), "sum"), "__n": (F.lit(1), "sum"), "__m": (F.when(F.col("p").isNotNull(), 1).otherwise(0), "sum")})
    reach = F.when(F.col("pos") % block >= block - (window - 1), F.array("block", F.col("block") + 1)).otherwise(F.array("block"))
    w = W.partitionBy("media_id", "block").orderBy("pos").rowsBetween(-(window - 1), 0)
    own = b.withColumn("own", F.col("block")).withColumn("block", F.explode(reach)).withColumn("p", F.avg("p").over(w)).where((F.col("own") == F.col("block")) & (F.col("pos") >= window - 1))
    loud = own.join(whole, ["media_id", "block"]).where(F.col("p") > F.col("__sum") / F.col("__m") * 10 ** (-drop_db / 10))
    last = loud.groupBy("media_id").agg((F.max("pos") + 1).alias("e"))
    return whole.groupBy("media_id").agg(F.max("__n").alias("n")).join(last, "media_id", "left").select("media_id", F.coalesce("e", "n").cast("long").alias("end"))


def mixdown(clips: DataFrame, block: int = 64) -> DataFrame:
    """(media_id, block, samples array<int>): clip samples (media_id, start, samples) summed per position in blocks, limited to 16 bits. Arrays, not rows, are shuffled."""

    def split(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for m, start, xs in zip(pdf["media_id"], pdf["start"], pdf["samples"], strict=True):
                x = np.asarray(xs, np.int64)
                for b in range(start // block, (start + max(len(x), 1) - 1) // block + 1):
                    lo, hi = max(start, b * block), min(start + len(x), (b + 1) * block)
                    rows.append((m, b, lo - b * block, x[lo - start : hi - start].tolist()))
            yield pd.DataFrame(rows, columns=["media_id", "block", "off", "part"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(block, np.int64)
        for off, part in zip(pdf["off"], pdf["part"], strict=True):
            total[off : off + len(part)] += np.asarray(part, np.int64)
        return pd.DataFrame([(pdf["media_id"].iloc[0], pdf["block"].iloc[0], np.clip(total, -32768, 32767).tolist())], columns=["media_id", "block", "samples"])

    parts = clips.select("media_id", "start", "samples").mapInPandas(split, "media_id string, block long, off int, part array<int>")
    return parts.groupBy("media_id", "block").applyInPandas(add, "media_id string, block long, samples array<int>")


def loop_background(background: DataFrame, lengths: DataFrame, percent: float, block: int = BLOCK, turns: int = 1024) -> DataFrame:
    """(media_id, pos, x): the background (media_id, pos, x) repeated and cut to each recording's length (media_id, n), at
    percent of its loudness. A sample knows its places by index arithmetic, so nothing is joined per place: it meets the
    length by block and is dealt for `turns` repetitions at a time, so that a short background under a long recording is
    many rows of work. Lengths that are null or below 1 give no row."""
    b = _blocked(background.select("media_id", F.col("pos").cast("long").alias("pos"), "x"), block)
    size = _per_block(b, {"size": (F.lit(1), "sum")})
    sized = size.join(lengths.where("n > 0").select("media_id", F.col("n").cast("long").alias("n")), "media_id")
    round_ = F.col("size") * turns
    dealt = b.join(sized, ["media_id", "block"]).where("pos < size AND pos < n").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1 - F.col("pos")) / round_))))
    dealt = dealt.repartition("media_id", "block", "part").withColumn("first", F.col("pos") + F.col("part") * round_)
    out = F.sequence("first", F.least(F.col("n") - 1, F.col("first") + round_ - 1), F.col("size"))
    return dealt.select("media_id", F.explode(out).alias("pos"), (F.col("x") * (percent / 100)).alias("x"))
