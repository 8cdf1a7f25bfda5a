"""SimHash near-duplicates: 64-bit fingerprints, deletion-variant index, verified links, components.

For links at `radius` differing bits a fingerprint is cut into ceil((radius + 1) / 2) segments. If two fingerprints
differ in at most `radius` bits, one segment differs in at most one bit, so the two agree on that segment with one
position left out. Every fingerprint is indexed under each (position, segment without it); an equality join finds
all pairs that can link, each is verified by counting bits, and a pair is given out at one position only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelane.llm.common import byte_slices, checkpointed, ragged_take, ship, texts_of

_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Hashes turned into bits at once.
STEP = 1 << 16
#: Keys of minima per text and minima in a key: a pair of similarity 0.8 shares no key once in 2,800 pairs, 0.9 once in 10^7.
BANDS, ROWS = 20, 5
#: Odd multipliers that stand for independent orders of the runs of words.
ORDERS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.translate(_UPPER))


def shingle_hashes(words: list[bytes], size: int) -> list[int]:
    """XXH64 (seed 42) of each run of `size` words joined by a space; fewer words are one run; none: empty."""
    from xxhash import xxh64_intdigest as h

    if len(words) <= size:
        return [h(b" ".join(words), 42)] if words else []
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - size + 1
    return [h(text[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray, weights: np.ndarray | None, offsets: np.ndarray) -> np.ndarray:
    """One fingerprint per row: a bit is set where over half the weight of the row's hashes has it; no hashes: zero."""
    rows = len(offsets) - 1
    ones = np.zeros((rows, 64), np.int64)
    total = np.zeros(rows, np.int64)
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    for lo in range(0, len(hashes), STEP):
        h, own = hashes[lo : lo + STEP], owner[lo : lo + STEP]
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        cut = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1))
        if weights is None:
            ones[own[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
            total[own[cut]] += np.diff(np.append(cut, len(own)))
        else:
            w = weights[lo : lo + STEP].astype(np.int32)
            ones[own[cut]] += np.add.reduceat(bits * w[:, None], cut, axis=0, dtype=np.int64)
            total[own[cut]] += np.add.reduceat(w, cut, dtype=np.int64)
    return np.packbits(2 * ones > total[:, None], axis=1).reshape(-1).view(">u8").astype(np.uint64)


def fingerprint_texts(texts: list[bytes], shingle: int, features: str) -> np.ndarray:
    from xxhash import xxh64_intdigest as h

    lists, weights = [], [] if features == "words" else None
    for t in texts:
        words = words_of(t)
        if weights is None:
            lists.append(np.array(shingle_hashes(words, shingle), np.uint64))
        else:
            own = [w for w in set(words) if len(w) > 3] or list(set(words))
            lists.append(np.array([h(w, 42) for w in own], np.uint64))
            weights.append(np.array([max(1, len(w) - 3) for w in own], np.int64))
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
    flat = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
    return majority(flat, None if weights is None else np.concatenate(weights or [np.zeros(0, np.int64)]), offsets)


def band_keys(texts: list[bytes], size: int) -> np.ndarray:
    """(texts, BANDS) keys: texts share a key where ROWS minima over their runs of `size` words agree. Texts without words share all."""
    from xxhash import xxh64_intdigest as h

    odd = np.uint64(0x9E3779B97F4A7C15)
    low = np.full((len(texts), BANDS * ROWS), np.iinfo(np.uint64).max, np.uint64)
    for own, text in zip(low, texts, strict=True):
        words = words_of(text)
        if not words:
            continue
        known = {w: h(w, 42) for w in set(words)}
        x = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(size, len(x))
        runs = x[: len(x) - k + 1].copy()
        for j in range(1, k):
            runs = runs * odd + x[j : len(x) - k + 1 + j]
        runs ^= runs >> np.uint64(32)
        for lo in range(0, len(runs), 4096):
            np.minimum(own, (ORDERS[:, None] * runs[lo : lo + 4096]).min(axis=1), out=own)
    low = low.reshape(len(texts), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), low.shape[:2]).copy()
    for r in range(ROWS):
        keys = (keys ^ low[:, :, r]) * odd
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, features: str = "shingles") -> DataFrame:
    """(id, fp long): the 64-bit fingerprint as a signed long, one row per input row.

    features='shingles': all runs of `shingle` words, repeats included. features='words': the text's different words,
    weighted by length beyond three bytes, which moves less when single words are changed. A null text is empty; a
    text without words has fingerprint 0.
    """
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            for lo, hi in byte_slices(texts, 2 << 20):
                fp = fingerprint_texts(texts.slice(lo, hi - lo).cast(pa.binary()).to_pylist(), shingle, features)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, fp long")


def segments(radius: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment, widths as even as 64 bits allow."""
    if not 0 <= radius < 64:
        raise ValueError("radius must be from 0 to 63")
    m = (radius + 2) // 2
    cuts = [round(64 * i / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def variants(fps: DataFrame, radius: int) -> DataFrame:
    """(p, v, fp): each fingerprint under its 64 one-wildcard segments; p is the bit left out, v the segment without it."""
    masks = [_signed((((1 << w) - 1) << lo) & ~(1 << p)) for lo, w in segments(radius) for p in range(lo, lo + w)]
    return fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("p", "v"))


def links(fps: DataFrame, radius: int) -> DataFrame:
    """(a, b), a < b: all pairs of different fingerprints within `radius` bits, each once. fps has one row per fingerprint.

    The join sorts both sides: the planner sizes the index like the fingerprints, of which it has 64 rows each, and would
    send it whole through the driver.
    """
    index = variants(fps, radius).hint("merge")
    left, right = (index.select(F.col("p").alias(f"p{s}"), F.col("v").alias(f"v{s}"), F.col("fp").alias(s)) for s in "ab")
    x, p = F.col("a").bitwiseXOR(F.col("b")), F.col("pa")
    own: Column = F.lit(False)
    before: Column = F.lit(True)
    for lo, w in segments(radius):
        diff = x.bitwiseAND(F.lit(_signed(((1 << w) - 1) << lo)))
        # equal segments agree at every position: the first one stands for all; later segments give way to earlier ones
        own = own | (p.between(lo, lo + w - 1) & before & ((diff != 0) | (p == lo)))
        before = before & (F.bit_count(diff) > 1)
    on = (F.col("pa") == F.col("pb")) & (F.col("va") == F.col("vb")) & (F.col("a") < F.col("b")) & (F.bit_count(x) <= radius) & own
    return left.join(right, on).select("a", "b")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable, for every node with an edge (a, b).

    Alternating star contraction: each round links neighbours to the smallest node around, by aggregation and join,
    so that no node's neighbourhood is gathered in one place. Lineage is cut every round.
    """
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = checkpointed(small.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
    raise RuntimeError("components did not settle")


def connected(fps: DataFrame, radius: int) -> DataFrame:
    """(node, root): components over all links of at most `radius` bits; fps has one row per fingerprint."""
    return components(links(fps, radius))


def linked(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id reachable over links of at most `radius` bits.

    Work is done on different fingerprints, so copies cost one row. Ids may repeat or be null; a component of null
    ids only has null.
    """
    fps = checkpointed(fps)
    groups = fps.groupBy("fp").agg(F.min("id").alias("low"))
    roots = connected(groups.select("fp"), radius)
    named = groups.join(roots, groups.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    tops = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = checkpointed(named.join(tops, "root").select(F.col("fp").alias("f"), "component_id"))
    return fps.join(by_fp, F.col("fp") == F.col("f")).select("id", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(id, fingerprint, component_id): the fingerprint as 16 hex digits; documents linked at `radius` bits or fewer
    share the smallest id reachable. Null texts are empty, texts without words have fingerprint 0 and link like any
    other, repeated rows stay, an empty table gives an empty one, other columns are not read."""
    out = linked(fingerprints(docs, id_col, text_col, shingle), radius)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _prints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, h, h2, th, fp, bands): hashes of the text, its number, fingerprint of different words and band keys on runs of `words` words, one row per input row. The number is the first hash; texts that share it and differ in the second have another one."""
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(3))
            for lo, hi in byte_slices(texts, 2 << 20):
                own = texts.slice(lo, hi - lo).cast(pa.binary()).to_pylist()
                fp, keys = fingerprint_texts(own, words, "words"), band_keys(own, words)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in range(3)), pa.array(fp.view(np.int64)), bands], names=["id", "h", "h2", "fp", "bands"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col).alias("id"), *_hashes(text), text.alias("text")).mapInArrow(run, f"id {id_type}, h long, h2 long, fp long, bands array<long>")
    return _numbered(checkpointed(out))


def _hashes(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text).alias("h"), F.xxhash64(F.lit(7), text).alias("h2")


def _numbered(prints: DataFrame) -> DataFrame:
    """Adds th, one number per different text."""
    met = prints.groupBy("h").agg(F.min("h2").alias("__lo"), F.max("h2").alias("__hi")).where("__lo <> __hi").select(F.col("h").alias("__h"), "__lo")
    return prints.join(met, F.col("h") == F.col("__h"), "left").withColumn("th", F.when(F.col("h2") == F.coalesce("__lo", "h2"), F.col("h")).otherwise(F.xxhash64("h", "h2"))).drop("__h", "__lo")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 5, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component_id), one row per input row: documents whose texts are equal, or chained by pairs with a Jaccard
    similarity of at least `similarity` on runs of `words` words, share the smallest id of the chain.

    Candidates are fingerprints of different words within `radius` bits and texts that share a band key of minima, which
    finds the pairs that a fingerprint sets further apart; each pair of texts is verified on whole texts. Texts with one
    fingerprint or band key are compared with the first of them by hash; then all texts of a band key that are not yet
    in one chain are compared with each other, in chunks. Null texts are empty and equal; null ids take part but give no
    component_id of their own; repeated rows stay; an empty table stays empty.
    """
    return _grouped(docs, id_col, text_col, radius, words, similarity).select("id", "component_id")


def _grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 5, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """similar_groups with the text hashes h and h2."""
    prints = checkpointed(_prints(docs, id_col, text_col, words))
    nodes = prints.select("fp", "th").distinct()
    first = nodes.groupBy("fp").agg(F.min("th").alias("rep"))
    found = links(first.select("fp"), radius)
    ra, rb = first.select(F.col("fp").alias("a"), F.col("rep").alias("ta")), first.select(F.col("fp").alias("b"), F.col("rep").alias("tb"))
    pairs = found.join(ra, "a").join(rb, "b").select("ta", "tb")
    pairs = pairs.unionByName(nodes.join(first, "fp").where("th <> rep").select(F.col("rep").alias("ta"), F.col("th").alias("tb")))
    shared = _shared(prints)
    pairs = pairs.unionByName(shared.where("th <> rep").select(F.col("rep").alias("ta"), F.col("th").alias("tb")))
    pairs = checkpointed(pairs.select(F.least("ta", "tb").alias("ta"), F.greatest("ta", "tb").alias("tb")).distinct())
    sets = _sets(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), prints, pairs.select(F.explode(F.array("ta", "tb")).alias("th")), words)
    roots = components(_verified(pairs, sets, similarity))
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_unmet(shared, roots, prints, sets, similarity)))
    named = prints.groupBy("th").agg(F.min("id").alias("low")).join(roots, F.col("th") == F.col("node"), "left").select("th", "low", F.coalesce("root", "th").alias("root"))
    tops = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_text = checkpointed(named.join(tops, "root").select(F.col("th").alias("t"), "component_id"))
    return prints.join(by_text, F.col("th") == F.col("t")).select("id", "h", "h2", "component_id")


def _shared(prints: DataFrame) -> DataFrame:
    """(band, th, rep) of the band keys that several texts have; rep is the smallest text hash of the key."""
    members = prints.select("th", F.explode("bands").alias("band")).distinct()
    several = members.groupBy("band").agg(F.min("th").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    return checkpointed(members.join(several, "band").select("band", "th", "rep"))


#: Texts of one band key that are compared in one task.
CHUNK = 256


def _unmet(shared: DataFrame, roots: DataFrame, prints: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of texts of one band key with different roots whose sets are similar enough.

    In each key the texts outside its most frequent root meet all others, chunk by chunk: a task holds two chunks with
    their sets, counts common members for all their pairs at once and gives only the pairs that are similar. A pair is
    looked at in the first of its common keys.
    """
    of = shared.join(roots, F.col("th") == F.col("node"), "left").select("band", "th", F.coalesce("root", "th").alias("root"))
    counts = of.groupBy("band", "root").agg(F.count("*").alias("n"))
    main = counts.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("n_out"), F.count("*").alias("roots")).where("roots > 1")
    bands = prints.select("th", "bands").dropDuplicates(["th"])
    of = of.join(main, "band").join(bands, "th").join(sets, "th")
    chunk = lambda n, salt: F.pmod(F.xxhash64("th", F.lit(salt)), F.ceil(F.col(n) / CHUNK).cast("long"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / CHUNK).cast("long") - 1))
    cols = ["band", "ca", "cb", "th", "root", "bands", "s"]
    of = checkpointed(of)
    left = of.where("root <> main").withColumn("ca", chunk("n_out", 1)).withColumn("cb", each("n")).select(cols)
    right = of.withColumn("cb", chunk("n", 2)).withColumn("ca", each("n_out")).select(*cols, (F.col("root") == F.col("main")).alias("in_main"))

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        a, b = [], []
        if x.num_rows and y.num_rows:
            band = x["band"][0].as_py()
            ths, roots_y, main_y = (y[c].to_numpy() for c in ("th", "root", "in_main"))
            bands_y = np.array(y["bands"].to_pylist(), np.int64)
            members = [np.frombuffer(v, np.uint32) for v in y["s"].to_pylist()]
            sizes = np.array([len(m) for m in members])
            values, at = np.unique(np.concatenate(members), return_inverse=True)
            owners, held = np.repeat(np.arange(len(members)), sizes)[np.argsort(at, kind="stable")], np.bincount(at, minlength=len(values))
            begin = np.cumsum(held) - held
            for th, root, own, keys in zip(x["th"].to_pylist(), x["root"].to_pylist(), x["s"].to_pylist(), x["bands"].to_pylist(), strict=True):
                own = np.frombuffer(own, np.uint32)
                both = np.zeros(len(members), np.int64)
                if len(values) and len(own):
                    place = np.minimum(np.searchsorted(values, own), len(values) - 1)
                    place = place[values[place] == own]
                    both = np.bincount(ragged_take(owners, begin[place], held[place]), minlength=len(members))
                first = keys.index(band)
                met = (both >= similarity * (len(own) + sizes - both)) & (roots_y != root) & (main_y | (ths > th)) & ~(bands_y[:, :first] == np.array(keys[:first], np.int64)).any(1)
                b += ths[met].tolist()
                a += [th] * int(met.sum())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    keys = ["band", "ca", "cb"]
    right = right.withColumnsRenamed({k: f"of_{k}" for k in keys})
    return left.groupBy(*keys).cogroup(right.groupBy(*[f"of_{k}" for k in keys])).applyInArrow(compare, "a long, b long").distinct()


def _sets(texts: DataFrame, prints: DataFrame, need: DataFrame, words: int) -> DataFrame:
    """(th, s): the hashed runs of words of each text hash in need. One document per text is read."""
    chosen = prints.groupBy("h", "h2", "th").agg(F.min("id").alias("low")).join(need.distinct(), "th").withColumnsRenamed({"h": "__h", "h2": "__h2"})
    rows = texts.select("id", "text", *_hashes(F.col("text"))).join(chosen, (F.col("h") == F.col("__h")) & (F.col("h2") == F.col("__h2")) & F.col("id").eqNullSafe(F.col("low"))).select("th", "text")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(1)
            for lo, hi in byte_slices(own, 2 << 20):
                cells = [np.unique(np.array(shingle_hashes(words_of(t), words), np.uint64).astype(np.uint32)).tobytes() for t in own.slice(lo, hi - lo).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(cells, pa.binary())], names=["th", "s"])

    return checkpointed(rows.mapInArrow(hashes, "th long, s binary").dropDuplicates(["th"]))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the pairs (ta, tb) of text hashes whose sets are similar enough."""

    def jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sa, sb = sets.select(F.col("th").alias("ta"), F.col("s").alias("sa")), sets.select(F.col("th").alias("tb"), F.col("s").alias("sb"))
    return pairs.join(sa, "ta").join(sb, "tb").select(F.col("ta").alias("a"), F.col("tb").alias("b"), "sa", "sb").mapInArrow(jaccard, "a long, b long")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one document of each group of similar_groups: the one with the smallest id, with all its rows of the group. Rows with a null id stay."""
    groups = _grouped(docs, id_col, text_col, **how)
    gone = groups.where("id <> component_id").select(F.col("id").alias("__id"), F.col("h").alias("__h"), F.col("h2").alias("__h2")).distinct()
    h, h2 = _hashes(F.coalesce(F.col(text_col), F.lit("")))
    return docs.join(gone, (F.col(id_col) == F.col("__id")) & (h == F.col("__h")) & (h2 == F.col("__h2")), "left_anti")
