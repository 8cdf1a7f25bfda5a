"""Importance resampling towards a target distribution: hashed word features, one gain per bucket, a seeded draw.

The vocabulary has a head and a tail. Frequent words, and frequent pairs of them, are counted over all documents and
broadcast with their exact CRC states and buckets; any other feature takes its CRC directly, from the state of the word
it begins with. Both feed the same exact bucket totals.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cuelane.llm.byte_bpe import flat_strings
from cuelane.llm.common import SLICE_BYTES, byte_slices, checkpointed, ship, texts_of

#: Frequent words and pairs that are broadcast, and the bytes of a word that may be one of them.
HEAD_WORDS, HEAD_PAIRS, HEAD_BYTES = 20_000, 20_000, 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


class Head:
    """Frequent words with their CRC states, frequent pairs with their CRCs."""

    def __init__(self, words: list[str], pairs: list[tuple[str, str]]):
        self.words = pa.array(words, pa.large_string())
        self.state = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words))
        place = {w: i for i, w in enumerate(words)}
        known = sorted((place[a] * max(len(words), 1) + place[b], zlib.crc32(b" " + b.encode(), int(self.state[place[a]]))) for a, b in pairs if a in place and b in place)
        self.pair, self.pair_crc = np.array([k for k, _ in known], np.int64), np.array([c for _, c in known], np.int64)

    def states(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """CRC state of each word, and its place in the head or -1."""
        at = pc.fill_null(pc.index_in(words, self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.empty(len(at), np.int64)
        out[at >= 0] = self.state[at[at >= 0]]
        tail = np.flatnonzero(at < 0)
        out[tail] = np.fromiter((zlib.crc32(w.encode()) for w in words.take(pa.array(tail)).to_pylist()), np.int64, len(tail))
        return out, at

    def pairs_of(self, a: np.ndarray, b: np.ndarray, states: np.ndarray, at: np.ndarray, words: pa.Array) -> np.ndarray:
        """CRC of each pair of words (numbers into `words`), joined by one space."""
        code = np.where((at[a] >= 0) & (at[b] >= 0), at[a] * max(len(self.words), 1) + at[b], -1)
        out = np.full(len(a), -1, np.int64)
        if len(self.pair):
            near = np.minimum(np.searchsorted(self.pair, code), len(self.pair) - 1)
            hit = self.pair[near] == code
            out[hit] = self.pair_crc[near[hit]]
        rest = np.flatnonzero(out < 0)
        tails = words.take(pa.array(b[rest])).to_pylist()
        out[rest] = np.fromiter((zlib.crc32(b" " + w.encode(), s) for w, s in zip(tails, states[a[rest]].tolist(), strict=True)), np.int64, len(rest))
        return out


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words, the number of each word of all texts, and offsets of the texts among them. Bytes decide: A-Z are
    lower-cased, digits, a-z and all bytes of characters beyond ASCII make words."""
    raw, off = flat_strings(texts)
    raw = _LOWER[raw]
    inside = _WORD[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[off[:-1]] = True
    begin = inside & first[:-1]
    begin[1:] |= inside[1:] & ~inside[:-1]
    starts = np.flatnonzero(begin)
    kept = np.concatenate(([0], np.cumsum(inside)))
    bounds = np.append(kept[starts], kept[-1]).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw[inside]))]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(starts, off)


def runs(codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring words of one text: both numbers, and the offsets of the texts among the pairs."""
    n = np.diff(off)
    inner = np.ones(len(codes), bool)
    inner[off[1:][n > 0] - 1] = False
    at = np.flatnonzero(inner)
    return codes[at], codes[np.minimum(at + 1, len(codes) - 1)], np.concatenate(([0], np.cumsum(np.maximum(n - 1, 0))))


def features(texts: pa.Array, head: Head, buckets: int, pairs: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each feature, offsets of the texts), for words and, if asked, pairs."""
    words, codes, off = words_of(texts)
    states, at = head.states(words)
    yield states[codes] % buckets, off
    if pairs:
        a, b, pair_off = runs(codes, off)
        unique, use = np.unique(a * max(len(words), 1) + b, return_inverse=True)
        crc = head.pairs_of(unique // max(len(words), 1), unique % max(len(words), 1), states, at, words)
        yield crc[use] % buckets, pair_off


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for batch in batches:
        texts = texts_of(batch.column(column))
        for lo, hi in byte_slices(texts, SLICE_BYTES):
            yield batch.slice(lo, hi - lo), texts.slice(lo, hi - lo)


def head_of(docs: DataFrame, text_col: str, pairs: bool, head_words: int = HEAD_WORDS, head_pairs: int = HEAD_PAIRS) -> Head:
    """The words, and pairs of them, that are most frequent in all documents: all from some count on, at most as many as
    the numbers say. Each slice of texts is counted before the shuffle; what comes to the driver is bounded by both
    numbers and by HEAD_BYTES, and by a row per step of the count."""
    text = docs.select(F.col(text_col).alias("text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _slices(batches, 0):
            found, codes, _ = words_of(texts)
            short = pc.less_equal(pc.binary_length(found), HEAD_BYTES)
            yield pa.RecordBatch.from_arrays([found.filter(short).cast(pa.string()), pa.array(np.bincount(codes, minlength=len(found))).filter(short)], names=["word", "n"])

    frequent = sorted(r.word for r in _most_frequent(text.mapInArrow(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), head_words))
    if not pairs or not frequent:
        return Head(frequent, [])
    known = pa.array(frequent, pa.large_string())

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _slices(batches, 0):
            found, codes, off = words_of(texts)
            a, b, _ = runs(codes, off)
            at = pc.fill_null(pc.index_in(found, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            hit = (at[a] >= 0) & (at[b] >= 0)
            pair, n = np.unique(at[a[hit]] << 32 | at[b[hit]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

    best = _most_frequent(text.mapInArrow(both, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), head_pairs)
    return Head(frequent, [(frequent[r.pair >> 32], frequent[r.pair & 0xFFFFFFFF]) for r in best])


def _most_frequent(counts: DataFrame, most: int) -> list:
    """Rows of counts (..., n) from some n on, as many as there can be without exceeding `most`. Counts are taken in steps of about a thirtieth."""
    counts = checkpointed(counts.withColumn("step", F.floor(F.log2("n") * 20).cast("int")))
    floor, held = None, 0
    for r in sorted(counts.groupBy("step").agg(F.count("*").alias("rows")).collect(), key=lambda r: -r["step"]):
        held += r["rows"]
        if held > most:
            break
        floor = r["step"]
    return [] if floor is None else counts.where(F.col("step") >= floor).collect()


def bucket_totals(docs: DataFrame, text_col: str, head: Head, buckets: int, pairs: bool) -> list[int]:
    """Features in each bucket over all texts; one row per task and bucket is shuffled, one per bucket collected."""
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for _, texts in _slices(batches, 0):
            for bucket, _ in features(texts, shared.value, buckets, pairs):
                held += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(held[used])], names=["bucket", "n"])

    out = [0] * buckets
    for r in docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over its share in the source, one added to each count."""
    buckets, s, t = len(source), float(sum(source)), float(sum(target))
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + buckets) / ((x + 1.0) * (t + buckets)))) for x, y in zip(source, target, strict=True)], np.int64)


def weigh(docs: DataFrame, id_col: str, text_col: str, head: Head, gain: np.ndarray, pairs: bool) -> DataFrame:
    """(id, n_words, n_features, weight) of every document."""
    sc = docs.sparkSession.sparkContext
    shared, table = sc.broadcast(head), sc.broadcast(gain)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _slices(batches, 1):
            n, weight = np.zeros((2, len(texts)), np.int64), np.zeros(len(texts), np.int64)
            for i, (bucket, off) in enumerate(features(texts, shared.value, len(table.value), pairs)):
                n[i] = np.diff(off)
                weight += np.diff(np.concatenate(([0], np.cumsum(table.value[bucket])))[off])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n[0]), pa.array(n.sum(0)), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, n_words long, n_features long, weight long")


def noise(id_col: str, seed: int) -> Column:
    """Whole thousandths of a Gumbel value that the seed and the id give."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, eligible: Column, *order: Column) -> tuple[DataFrame, int]:
    """The rows with rank (1, 2, 3 ... of the eligible ones in the given order, else null), and how many are eligible. Rows are dealt by ranges of the order
    and numbered inside each range; only the sizes of ranges come to the driver. Equal rows can be split over ranges."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = rows.withColumn("__out", ~F.coalesce(eligible, F.lit(False))).withColumn("__tie", F.monotonically_increasing_id())
    dealt = checkpointed(checkpointed(marked).repartitionByRange(parts, "__out", *order, "__tie").withColumn("__part", F.spark_partition_id()))
    sizes = {r["__part"]: r["n"] for r in dealt.where("NOT __out").groupBy("__part").agg(F.count("*").alias("n")).collect()}
    base, seen = [], 0
    for p in range(max(sizes, default=-1) + 1):
        base.append(seen)
        seen += sizes.get(p, 0)
    start = F.element_at(F.array(*[F.lit(b).cast("long") for b in base]), F.col("__part") + 1) if base else F.lit(0).cast("long")
    at = F.row_number().over(W.partitionBy("__part").orderBy("__out", *order, "__tie"))
    return dealt.withColumn("rank", F.when(~F.col("__out"), start + at)).drop("__out", "__tie", "__part"), seen


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", pairs: bool = False, buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20, head: Head | None = None) -> DataFrame:
    """(id, n_features, weight, score, rank), all long but the id, one row per input row.

    Features are all words, with `pairs` also all pairs of neighbours. A document's weight is the sum of its buckets'
    gains, its score adds Gumbel noise, and of the N documents with at least `least_words` words the floor(percent N /
    100) highest scores are drawn without replacement (ties: smaller id, nulls last; equal rows in any order). Null
    texts have no features, weight 0; an empty table gives an empty one, an empty target a weight that only counts
    rarity in the documents. Repeated rows count and are drawn one by one. Other columns are not read.
    """
    ship(docs.sparkSession)
    head = head or head_of(docs, text_col, pairs)
    gain = gains(bucket_totals(docs, text_col, head, buckets, pairs), bucket_totals(target, target_col, head, buckets, pairs))
    rows = weigh(docs, id_col, text_col, head, gain, pairs).withColumn("score", F.col("weight") + noise("id", seed))
    out, n = ranked(rows, F.col("n_words") >= least_words, F.desc("score"), F.asc_nulls_last("id"))
    rank = F.when(F.col("rank") <= n * percent // 100, F.col("rank"))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.alias("rank"))
