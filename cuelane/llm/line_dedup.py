"""Line dedup in DataFrame functions only: explode, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = " \t\n\x0b\x0c\r"
_LAST = (1 << 63) - 1


def _doc(docs: DataFrame, id_col: str) -> Column:
    """A document's place in the order of ids, null behind all others."""
    if docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long"):
        return F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"))


def _whole(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def keyed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, row, pos, h1, h2) of every line whose key has at least `min_chars` code points; row tells apart different
    texts under one id, h1 and h2 are a 128-bit hash of the key. A null id counts as one document behind all others."""
    lines = docs.select(_doc(docs, id_col).alias("doc"), F.xxhash64(text_col).alias("row"), F.posexplode_outer(F.split(F.translate(_whole(text_col), _UPPER, _LOWER), "\n")).alias("pos", "line"))  # outer: else a filter splits every text twice
    keys = lines.where(F.length("line") >= min_chars).withColumn("key", F.btrim("line", F.lit(_SPACE))).where(F.length("key") >= min_chars)
    return keys.select("doc", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """(doc, row, pos) of the lines to drop: their key is in at least `min_docs` documents and this is not the smallest."""
    lines = keyed_lines(docs, id_col, text_col, min_chars)
    if min_docs == 2:
        shared = lines.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    else:
        shared = lines.select("h1", "h2", "doc").distinct().groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
    # a key more than the hashes has both sides shuffled for the join, so that adaptive execution can split the rows of a very common line
    shared = shared.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "first", F.col("h1").bitwiseXOR(F.col("h2")).alias("k3"))
    on = (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & (F.col("h3") == F.col("k3"))
    return lines.withColumn("h3", F.col("h1").bitwiseXOR(F.col("h2"))).join(shared, on).where("doc <> first").select("doc", "row", "pos")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """All columns of docs plus kept_text, n_lines and n_dropped (columns of these names are replaced).

    A line's key is the line without blanks at both ends and with A-Z lower-cased. Keys of at least `min_chars` code
    points that at least `min_docs` documents hold lose all their lines but those in the smallest id. Null or empty
    texts are one empty line; a text that loses all lines becomes empty; repeated rows of one id are one document
    and are treated alike; rows with a null id count together as one last document. An empty table stays empty.
    """
    gone = dropped_lines(docs, id_col, text_col, min_chars, min_docs).groupBy("doc", "row").agg(F.collect_set("pos").alias("__gone")).withColumnsRenamed({"doc": "__doc", "row": "__row"})
    kept = docs.drop("kept_text", "n_lines", "n_dropped").join(gone, _doc(docs, id_col).eqNullSafe(F.col("__doc")) & (F.xxhash64(text_col) == F.col("__row")), "left")
    kept = kept.withColumn("__lines", F.split(_whole(text_col), "\n"))
    lines = F.col("__lines")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), _whole(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    return kept.select(*docs.drop("kept_text", "n_lines", "n_dropped").columns, text.alias("kept_text"), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"))
