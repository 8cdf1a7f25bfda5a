"""Sharding by fixed virtual slots: rows are hashed into slots, bytes are summed per slot, and a versioned map
gives each slot a shard. The map is small (one row per slot) and is edited, not made anew, when loads change."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLOTS = 4096
#: Copies of one row that are dealt at once.
CHUNK = 1 << 16
MAP_SCHEMA = "version int, vslot int, shard int, bytes long, n long, base long"


def text_size(text_col: str) -> Column:
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")


def slot_of(n_slots: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n_slots)).cast("int")


def slot_loads(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(vslot, bytes, rows) of rows with vslot and size; at most one entry per slot comes to the driver."""
    return [(r.vslot, r.bytes, r.n) for r in rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()]


def first_map(loads: list[tuple[int, int, int]], shards: int) -> list[tuple]:
    """Version 1: heaviest slot first, each to the shard with fewest bytes, ties to the lower shard."""
    heap = [(0, s) for s in range(shards)]
    place = {}
    for slot, size, _ in sorted(loads, key=lambda x: (-x[1], x[0])):
        held, shard = heapq.heappop(heap)
        place[slot] = shard
        heapq.heappush(heap, (held + size, shard))
    return _rows(1, place, loads)


def rebalanced_map(old: list[tuple], loads: list[tuple[int, int, int]], shards: int, slack: float = 0.02) -> list[tuple]:
    """The next version of a map: slots stay where they are unless their shard is above the mean by over `slack` or no
    longer exists; those that leave go to the lightest shards. Slots that the old map lacks are placed likewise."""
    size = {s: b for s, b, _ in loads}
    place = {r[1]: r[2] for r in old if r[1] in size and r[2] < shards}
    held = [0] * shards
    for s, shard in place.items():
        held[shard] += size[s]
    mean = sum(size.values()) / shards
    loose = [s for s in size if s not in place]
    for shard in range(shards):
        for s in sorted((s for s, k in place.items() if k == shard), key=lambda s: (size[s], s)):
            if held[shard] <= mean * (1 + slack):
                break
            if held[shard] - size[s] >= mean * (1 - slack):
                held[shard] -= size[s]
                del place[s]
                loose.append(s)
    heap = [(b, k) for k, b in enumerate(held)]
    heapq.heapify(heap)
    for s in sorted(loose, key=lambda s: (-size[s], s)):
        b, k = heapq.heappop(heap)
        place[s] = k
        heapq.heappush(heap, (b + size[s], k))
    return _rows(max((r[0] for r in old), default=0) + 1, place, loads)


def _rows(version: int, place: dict[int, int], loads: list[tuple[int, int, int]]) -> list[tuple]:
    """Map rows; base is the number of rows in lower slots of the same shard."""
    seen: dict[int, int] = {}
    out = []
    for slot, size, n in sorted(loads):
        shard = place[slot]
        out.append((version, slot, shard, size, n, seen.get(shard, 0)))
        seen[shard] = seen.get(shard, 0) + n
    return out


def map_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, MAP_SCHEMA)


def store_map(spark: SparkSession, rows: list[tuple], folder: str) -> None:
    """Adds a version of a map to its folder, one Parquet folder per version."""
    map_frame(spark, rows).coalesce(1).write.parquet(f"{folder}/map-{rows[0][0]:08d}")


def stored_map(spark: SparkSession, folder: str) -> list[tuple] | None:
    """The latest version in a map folder, or None where there is none; one row per virtual slot."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []
    names = [n for n in names if n.startswith("map-") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return [tuple(r) for r in spark.read.parquet(f"{folder}/{names[-1]}").collect()] if names else None


def shard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, n_slots: int = SLOTS, map_folder: str | None = None) -> DataFrame:
    """(id, size, text_crc32, shard, slot, vslot, map_version): every row in one shard, shard sizes near equal.

    size is the text's UTF-8 bytes plus 8 (null: 8), slot the row's place in its shard, from 0 without gaps. Rows that
    are equal in id and text are numbered, and the number is hashed too, so copies spread over slots. Empty tables
    give an empty result. With `map_folder` the latest map there is edited where there is one, and the map used is stored
    as the next version, so that rows move only as far as loads have changed.
    """
    same = docs.select(F.col(id_col).alias("id"), (text_size(text_col) + 8).alias("size"), F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("text_crc32")).groupBy("id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    chunks = same.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {CHUNK}"))))  # no array grows with the copies of a row
    rows = chunks.select("id", "size", "text_crc32", F.explode(F.sequence(F.col("chunk") * CHUNK + 1, F.least(F.col("copies"), (F.col("chunk") + 1) * CHUNK))).alias("copy"))
    rows = rows.withColumn("vslot", slot_of(n_slots, "id", "text_crc32", "copy"))
    loads = slot_loads(rows)
    spark = docs.sparkSession
    old = stored_map(spark, map_folder) if map_folder else None
    now = first_map(loads, shards) if old is None else rebalanced_map(old, loads, shards)
    if map_folder and now:
        store_map(spark, now, map_folder)
    table = map_frame(spark, now)
    placed = rows.withColumn("at", F.row_number().over(Window.partitionBy("vslot").orderBy("id", "text_crc32", "size", "copy")))
    small = F.broadcast(table.select("vslot", "shard", "base", F.col("version").alias("map_version")))  # at most n_slots rows
    return placed.join(small, "vslot").select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("base") + F.col("at") - 1).alias("slot"), "vslot", "map_version")
