"""Cuts that depend on the cut before: each position knows where the next cut would be if one were there, and the cuts
are the positions that the first one leads to.

Positions of a key lie in blocks. Inside a block a position's last step and its exit are found for all blocks of a
batch at once; only exits of entered positions are joined from block to block, by doubling, so that a key of any length
is many tasks and log n small joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelane.plans.session import shared_folder

#: Positions of a block, where positions are counted.
BLOCK = 4096


def stored(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_as_dealt(df: DataFrame) -> DataFrame:
    """stored, and what comes after still knows by which columns the rows are dealt: an adaptive plan would not say."""
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return stored(df.select("*"))
    finally:
        conf.set("spark.sql.adaptive.enabled", before)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of sorted batches, cut between groups, and the number of each row's group. Only the last group of a batch waits for the next."""

    def numbers(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        for k in keys:
            col = t[k].combine_chunks().dictionary_encode()
            col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
            codes = np.nan_to_num(col.indices.to_numpy(zero_copy_only=False), nan=-1)
            new[1:] |= codes[1:] != codes[:-1]
        return np.cumsum(new)

    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        held = t
        if t.num_rows:
            group = numbers(t)
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                yield t.slice(0, cut), group[:cut]
                held = t.slice(cut)
    if held is not None and held.num_rows:
        yield held, numbers(held)


def by_groups(df: DataFrame, keys: list[str], order: list[str], run: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, together: bool = False) -> DataFrame:
    """run on tables that hold whole groups of equal keys, sorted by keys and order. together: groups lie in one partition each already, as after a window over them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in whole_groups(batches, keys):
            yield from run(t, group).to_batches()

    dealt = df if together else df.repartition(*[F.col(k) for k in keys])
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(each, schema)


def passed(df: DataFrame, order: list[str], run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """run on the sorted batches of each partition, one after another. Rows of one key lie in one partition already, as after
    a window over it; what run remembers between batches is all that it holds."""
    return df.sortWithinPartitions(*order).mapInArrow(run, schema)


def walk(points: DataFrame) -> DataFrame:
    """(media_id, k): the positions of each recording that its first one leads to, for points (media_id, k, nxt) that lie
    together by recording. k counts from 0 without gaps, nxt > k or null. Jumps from cut to cut through the sorted rows and
    remembers the next cut only; nothing is stored or shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = -1
        for batch in batches:
            k, nxt = (batch.column(i).fill_null(-1).to_numpy(zero_copy_only=False) for i in (1, 2))
            firsts = np.flatnonzero(k == 0)
            edges = [0, *firsts[firsts > 0].tolist(), len(k)]
            cuts = []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                want = 0 if k[lo] == 0 else want
                while 0 <= want - k[lo] < hi - lo:
                    at = lo + int(want - k[lo])
                    cuts.append(at)
                    want = nxt[at]
            yield batch.select([0, 1]).take(pa.array(cuts, pa.int64()))

    kind = points.schema["media_id"].dataType.simpleString()
    return passed(points.select("media_id", F.col("k").cast("long").alias("k"), F.col("nxt").cast("long").alias("nxt")), ["media_id", "k"], run, f"media_id {kind}, k long")


def _steps(group: np.ndarray, k: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """The row that each row's next position is, or -1 where it is in another block or there is none."""
    code = (group << 40) + k
    want = (group << 40) + nxt
    at = np.minimum(np.searchsorted(code, want), max(len(code) - 1, 0))
    return np.where((nxt >= 0) & (code[at] == want), at, -1) if len(code) else np.zeros(0, np.int64)


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t[name].combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def chain(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, k): the positions of each key that its first one leads to.

    points: (keys, b, k, nxt, nxt_b), different k from 0 on, with the block b of each, nxt > k or null, and blocks that do
    not fall as k grows. Read twice; store it first where it is dear.
    """
    schema = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    head = ", ".join(f"{k} {schema[k]}" for k in keys)
    rows = points.select(*keys, "b", F.col("k").cast("long").alias("k"), F.col("nxt").cast("long").alias("nxt"), F.col("nxt_b").cast("long").alias("nxt_b"), F.lit(0).alias("entry"))
    first = rows.where("k = 0").select(*keys, "b", "k")
    crossing = rows.where("nxt_b > b").select(*keys, F.col("nxt_b").cast(schema["b"]).alias("b"), F.col("nxt").alias("k")).distinct()

    def entered(entries: DataFrame) -> DataFrame:
        return rows.unionByName(entries.select(*keys, "b", "k", F.lit(None).cast("long").alias("nxt"), F.lit(None).cast("long").alias("nxt_b"), F.lit(1).alias("entry")))

    def split(t: pa.Table, group: np.ndarray) -> tuple[np.ndarray, ...]:
        """Rows of positions, their next rows, and which of them are entered: an entry sorts behind the position it names."""
        entry = _column(t, "entry") == 1
        own = np.flatnonzero(~entry)
        place = np.cumsum(~entry) - 1
        return own, _steps(group[own], _column(t, "k")[own], _column(t, "nxt")[own]), np.unique(place[entry])

    def exits(t: pa.Table, group: np.ndarray) -> pa.Table:
        own, step, inn = split(t, group)
        last = np.where(step >= 0, step, np.arange(len(step)))
        while True:
            on = last[last]
            if np.array_equal(on, last):
                break
            last = on
        out = t.take(pa.array(own[inn]))
        to = t.take(pa.array(own[last[inn]]))
        left = pa.compute.is_valid(to["nxt"])
        return pa.table([out[k].filter(left) for k in [*keys, "k"]] + [to["nxt"].filter(left), to["nxt_b"].filter(left)], names=[*keys, "k", "to_k", "to_b"])

    def marked(t: pa.Table, group: np.ndarray) -> pa.Table:
        own, step, at = split(t, group)
        hit = np.zeros(len(own), bool)
        while len(at):
            hit[at] = True
            at = step[at]
            at = at[at >= 0]
        return t.select([*keys, "k"]).take(pa.array(own[hit]))

    reached = first
    if not crossing.isEmpty():
        jump = stored(by_groups(entered(crossing.unionByName(first).distinct()), [*keys, "b"], ["k", "entry"], exits, f"{head}, k long, to_k long, to_b long"))
        known = 0
        reached = first.withColumn("b", F.col("b").cast("long"))
        while True:
            hop = reached.join(jump, [*keys, "k"]).select(*keys, F.col("to_b").alias("b"), F.col("to_k").alias("k"))
            reached = stored(reached.unionByName(hop).distinct())
            n = reached.count()
            if n == known:
                break
            known = n
            on = jump.select(*keys, F.col("k").alias("to_k"), F.col("to_k").alias("far_k"), F.col("to_b").alias("far_b"))
            jump = stored(jump.join(on, [*keys, "to_k"]).select(*keys, "k", F.col("far_k").alias("to_k"), F.col("far_b").alias("to_b")))
        reached = reached.withColumn("b", F.col("b").cast(schema["b"]))
    return by_groups(entered(reached), [*keys, "b"], ["k", "entry"], marked, f"{head}, k long")
