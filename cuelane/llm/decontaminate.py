"""Benchmark decontamination in DataFrame functions only.

A window of a document, as long as a benchmark item, is a copy of the item if the two agree in at least `similarity` of
their weighted five-word shingles (weight: how often a shingle occurs). Windows get SimHash fingerprints. Windows and
items meet in a multi-index of Hamming blocks: fingerprints within the radius differ in at most two bits of one of eight
blocks, so items are indexed under every such variant of each block, windows are looked up by their own blocks, and
nothing within the radius is missed. What lies within it is verified exactly.

Windows without most of an item's shingles cannot reach the similarity, so a document's windows of a length are laid only
where enough of their positions hold a shingle of some item of that length. A window may start at its first such
position, or as late as the document allows: what it shares with an item does not shrink by that.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelane.llm.common import checkpointed

#: Item shingles that are few enough to be sent to all tasks; beyond it the join shuffles.
BROADCAST_SHINGLES = 500_000
#: Fingerprints of similarity 0.8 differ in 13 of 64 bits on average, by 3 up or down; at most 23 in 998 of 1,000 pairs.
RADIUS = 23
#: Bits in a block and the most of them that one block of two fingerprints within the radius differs by.
BLOCK, SLIPS = 8, 2
#: What one place of one length, or one content of a window or an item, is known by.
CONTENT = ["k", "n", "c1", "c2"]


def _hash128(col: str, *names: str) -> list[Column]:
    """Two hashes that stand for a value; equal values are handled once."""
    return [F.xxhash64(col).alias(names[0]), F.xxhash64(F.lit(7), col).alias(names[1])]


def _words(text_col: str) -> Column:
    """Lower-cased runs of letters, marks and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^\\p{L}\\p{M}\\p{N}]+"), "")


def _hashes(words: Column, size: int) -> Column:
    """Hash of the shingle at each position; none for fewer words."""
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))).otherwise(F.array().cast("array<bigint>"))


def _of_size(xs: str, k: int) -> Column:
    """The structs of an array whose shingles have k words."""
    return F.filter(xs, lambda x: x.k == k)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def fingerprints(contents: DataFrame) -> DataFrame:
    """(CONTENT, fp) of rows (CONTENT, h array): a bit is one where over half of the shingles, repeats included, have it."""
    two = (1 << 32) + 1  # bits b and b + 32 are summed in the two halves of one long
    sums = [F.sum(F.shiftrightunsigned("g", b).bitwiseAND(F.lit(two))).alias(f"b{b}") for b in range(32)]
    rows = contents.select(*CONTENT, F.explode("h").alias("g")).groupBy(*CONTENT).agg(F.count("*").alias("of"), *sums)
    rows = checkpointed(rows)  # else the planner takes minutes over the sums in one expression
    low = [(b, F.col(f"b{b}").bitwiseAND(F.lit((1 << 32) - 1))) for b in range(32)]
    high = [(b + 32, F.shiftrightunsigned(f"b{b}", 32)) for b in range(32)]
    bits = [F.when(2 * ones > F.col("of"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")) for b, ones in low + high]
    return checkpointed(rows.select(*CONTENT, reduce(Column.bitwiseOR, bits).alias("fp")))


def variants(block: int = BLOCK, slips: int = SLIPS) -> list[int]:
    """What a block value is changed by to give all values within `slips` bits."""
    return [sum(1 << b for b in bits) for s in range(slips + 1) for bits in combinations(range(block), s)]


def _blocks(fp: str, spread: bool) -> Column:
    """(block, value) structs of a fingerprint, with spread also of all values within SLIPS bits of each block."""
    out = []
    for i in range(64 // BLOCK):
        value = F.shiftrightunsigned(fp, i * BLOCK).bitwiseAND(F.lit((1 << BLOCK) - 1)).cast("int")
        out += [F.struct(F.lit(i).alias("block"), value.bitwiseXOR(F.lit(v)).alias("value")) for v in (variants() if spread else [0])]
    return F.array(*out)


def near_contents(windows: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(CONTENT, item), each pair once: window contents and items of one length whose fingerprints differ in at most `radius` bits.

    windows: (CONTENT, fp); items: (item, k, n, ifp). Above the radius that the blocks guarantee pairs would be lost, so it is refused.
    """
    if radius >= (SLIPS + 1) * (64 // BLOCK):
        raise ValueError("radius is beyond what the blocks guarantee")
    index = items.select("item", F.col("k").alias("ik"), F.col("n").alias("in"), "ifp", F.explode(_blocks("ifp", True)).alias("b")).select("item", "ik", "in", "ifp", F.col("b.block").alias("ib"), F.col("b.value").alias("iv"))
    asked = windows.select(*CONTENT, "fp", F.explode(_blocks("fp", False)).alias("b")).select(*CONTENT, "fp", "b.block", "b.value")
    met = asked.join(index, (F.col("k") == F.col("ik")) & (F.col("n") == F.col("in")) & (F.col("block") == F.col("ib")) & (F.col("value") == F.col("iv")))
    return met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= radius).select(*CONTENT, "item").distinct()


def _windows(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, sizes: list[int], similarity: float) -> DataFrame:
    """(r1, r2, start, CONTENT, h): the windows of each different text that hold enough shingles of items of their length."""
    spots = items.select("k", "n", F.explode("h").alias("g")).distinct()
    small = spots.count() <= BROADCAST_SHINGLES
    named = docs.select(F.col(id_col).alias("id"), *_hash128(text_col, "r1", "r2"), _words(text_col).alias("w"))
    places = _union([named.select("id", "r1", "r2", F.lit(k).alias("k"), _hashes(F.col("w"), k).alias("h")) for k in sizes])
    places = places.select("id", "r1", "r2", "k", F.size("h").alias("doc_n"), F.posexplode_outer("h").alias("pos", "g"))  # outer: else a filter on h is pushed down and makes all hashes twice
    hits = places.join(F.broadcast(spots) if small else spots, ["k", "g"])
    spread = hits.groupBy("r1", "r2", "k", "n", "doc_n").agg(F.min("id").alias("low"), F.sort_array(F.collect_set("pos")).alias("ps"))  # at most the positions of one text
    need, last = F.ceil(F.lit(similarity) * F.col("n") - F.lit(1e-9)).cast("int"), F.greatest(F.lit(0), F.col("doc_n") - F.col("n"))
    early = F.filter("ps", lambda p, i: (p < last) & (F.get(F.col("ps"), i + need - 1) < p + F.col("n")))
    late = F.when(F.size(F.filter("ps", lambda p: p >= last)) >= need, F.array(last)).otherwise(F.array().cast("array<int>"))
    laid = spread.select("low", "r1", "r2", "k", "n", F.concat(early, late).alias("starts")).where(F.size("starts") > 0)
    wanted = laid.groupBy("low", F.col("r1").alias("w1"), F.col("r2").alias("w2")).agg(F.collect_list(F.struct("k", "n", "starts")).alias("xs"))  # one entry per length of items
    again = docs.select(F.col(id_col).alias("id"), *_hash128(text_col, "r1", "r2"), F.col(text_col).alias("t"))
    texts = again.join(wanted, F.col("id").eqNullSafe(F.col("low")) & (F.col("r1") == F.col("w1")) & (F.col("r2") == F.col("w2"))).dropDuplicates(["r1", "r2"]).select("r1", "r2", "xs", _words("t").alias("w"))
    texts = checkpointed(_union([texts.select("r1", "r2", F.lit(k).alias("k"), _of_size("xs", k).alias("xs"), _hashes(F.col("w"), k).alias("h")) for k in sizes]))
    cut = F.flatten(F.transform("xs", lambda x: F.transform(x.starts, lambda s: F.struct(x.n.alias("n"), s.alias("start"), F.slice(F.col("h"), s + 1, x.n).alias("h")))))
    return checkpointed(texts.select("r1", "r2", "k", F.explode(cut).alias("x")).select("r1", "r2", "k", "x.*").withColumns(dict(zip(["c1", "c2"], _hash128("h", "c1", "c2"), strict=True))))


def matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", words: int = 5, similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """(r1, r2, item, start, similarity): item-sized windows of each different text, by their first shingle, that copy an item; r1 and r2 are the text's hash.

    An item of fewer than `words` words is one shingle of all its words, which a text copies by holding them in a row.
    Null texts and texts or items without words never match. A document shorter than an item is compared whole.
    """
    items = checkable_items(bench, item_col, item_text, words)
    sizes = sorted(r.k for r in items.select("k").distinct().collect()) or [words]  # at most `words` numbers
    windows = _windows(docs, items, id_col, text_col, sizes, similarity)
    named = items.select("item_id", "item", "k", "n", "h", *_hash128("h", "c1", "c2"))
    contents = checkpointed(windows.select(*CONTENT, "h").unionByName(named.select(*CONTENT, "h")).dropDuplicates(CONTENT))  # a passage that many texts hold is one row
    prints = fingerprints(contents)
    mine = windows.select(*CONTENT).distinct().join(prints, CONTENT)
    theirs = named.join(prints.withColumnRenamed("fp", "ifp"), CONTENT).select("item", "k", "n", "ifp")
    near = near_contents(mine, theirs, radius)
    held = contents.select(*CONTENT, F.explode("h").alias("g")).groupBy(*CONTENT, "g").agg(F.count("*").alias("c"))
    asked = items.select("item_id", "item", F.explode("h").alias("g")).groupBy("item_id", "item", "g").agg(F.count("*").alias("ic"))
    both = near.join(held, CONTENT).join(asked, ["item", "g"]).groupBy(*CONTENT, "item_id").agg(F.sum(F.least("c", "ic")).alias("shared"))
    copies = both.withColumn("similarity", F.col("shared") / F.col("n")).where(F.col("similarity") >= similarity)
    return windows.drop("h").join(copies, CONTENT).select("r1", "r2", F.col("item_id").alias("item"), "start", "similarity")


def checkable_items(bench: DataFrame, item_col: str, item_text: str, words: int) -> DataFrame:
    """(item_id, item, k, n, h): the n shingles of k words of items that have words; item is a key of id and text, so that an item given with two texts counts with both."""
    rows = bench.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), F.col(item_text).alias("t")).distinct()
    rows = rows.select("item_id", F.xxhash64("item_id", "t").alias("item"), _words("t").alias("w")).where(F.size("w") > 0)
    whole = F.array(F.xxhash64(F.get("w", F.lit(0))))
    for k in range(2, words):
        whole = F.when(F.size("w") == k, F.array(F.xxhash64(*[F.get("w", F.lit(j)) for j in range(k)]))).otherwise(whole)
    rows = rows.select("item_id", "item", F.least(F.size("w"), F.lit(words)).alias("k"), F.when(F.size("w") < words, whole).otherwise(_hashes(F.col("w"), words)).alias("h"))
    return checkpointed(rows.select("item_id", "item", "k", F.size("h").alias("n"), "h"))


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, n_items long, item_ids array, similarity double, contaminated boolean), one row per different id of docs.

    item_ids are the items copied by any text of the id, sorted; similarity is the highest found, 0 where none. Null
    ids give no row; null and empty texts copy nothing; an empty document table gives an empty result; with an empty
    benchmark nothing is contaminated; other columns are not read.
    """
    found = matches(docs, bench, id_col, text_col, **how).groupBy(F.col("r1").alias("f1"), F.col("r2").alias("f2"), "item").agg(F.max("similarity").alias("similarity"))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), *_hash128(text_col, "r1", "r2"))
    mine = rows.join(found, (F.col("r1") == F.col("f1")) & (F.col("r2") == F.col("f2"))).groupBy("__id").agg(F.sort_array(F.collect_set("item")).alias("item_ids"), F.round(F.max("similarity"), 6).alias("similarity"))
    out = docs.where(F.col(id_col).isNotNull()).select(id_col).distinct().join(mine, F.col(id_col) == F.col("__id"), "left")
    items = F.coalesce("item_ids", F.array().cast(dict(mine.dtypes)["item_ids"]))
    return out.select(id_col, F.size(items).cast("long").alias("n_items"), items.alias("item_ids"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.col("__id").isNotNull().alias("contaminated"))


def clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the rows whose text copies a benchmark item, whatever their id; clean texts under the same id stay, as do null and empty ones and all other columns."""
    bad = matches(docs, bench, id_col, text_col, **how).select(F.col("r1").alias("__r1"), F.col("r2").alias("__r2")).distinct()
    return docs.join(bad, (F.xxhash64(text_col) == F.col("__r1")) & (F.xxhash64(F.lit(7), text_col) == F.col("__r2")), "left_anti")
