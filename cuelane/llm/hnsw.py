"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, kept as flat neighbour
arrays in a table, searched where the shard is, shard results merged.

Shards are bounded (`shard_rows`, SHARD_BYTES), so a vector's nearest earlier vectors are found by products of blocks of
rows with all earlier ones instead of a beam over the growing graph; neighbours are then chosen by diversity, linked back
and cut to size as usual. Graphs are built and walked in single precision on centred and scaled vectors; results are
measured on the original vectors in doubles.
"""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelane.llm.common import checkpointed, ship

#: Links per vector above the base layer (twice that on it), candidates looked at when linking, beam when searching.
LINKS, CANDIDATES, BEAM = 16, 64, 96
#: Bytes of vectors in a shard at most, rows worked on at once, queries that meet a shard at once.
SHARD_BYTES, BLOCK, SLICE = 16 << 20, 256, 32_768
INDEX_SCHEMA = "dim int, shard int, n int, ids binary, counts binary, vectors binary, tops binary, graphs array<binary>, members array<binary>"


def _scaled(vectors: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Vectors in single precision, moved and scaled as `like` needs to be centred and within 2."""
    mean = like.mean(axis=0) if len(like) else 0.0
    most = np.abs(like - mean).max(initial=0)
    return ((vectors - mean) / (most if most > 0 else 1.0)).astype(np.float32)


def _squares(v: np.ndarray) -> np.ndarray:
    return np.einsum("nd,nd->n", v, v)


def _diverse(near: np.ndarray, dist: np.ndarray, v: np.ndarray, sq: np.ndarray, most: int) -> np.ndarray:
    """Rows of candidate positions (sorted by distance, -1 for none) -> chosen mask: a candidate is taken if it is nearer to the row's vector than to any taken before."""
    rows, width = near.shape
    x, s = v[near], sq[near]
    between = s[:, :, None] + s[:, None, :] - 2 * (x @ x.transpose(0, 2, 1))
    taken = np.zeros((rows, width), bool)
    gap = np.full((rows, width), np.inf, np.float32)
    count = np.zeros(rows, np.int64)
    for c in range(width):
        ok = (near[:, c] >= 0) & (gap[:, c] > dist[:, c]) & (count < most)
        taken[:, c] = ok
        count += ok
        np.minimum(gap, np.where(ok[:, None], between[:, c], np.inf), out=gap)
        if not c % 8 and (count >= most).all():
            break
    return taken


def _layer(every: np.ndarray, nodes: np.ndarray, most: int, candidates: int) -> np.ndarray:
    """Neighbour table [len(nodes), most] of positions (padded by -1) for nodes in insertion order."""
    n = len(nodes)
    v = every[nodes]
    sq = _squares(v)
    src, dst, gaps = [], [], []
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        part = sq[None, :hi] + sq[lo:hi, None] - 2 * (v[lo:hi] @ v[:hi].T)
        part[:, lo:][np.triu_indices(hi - lo)] = np.inf  # earlier ones only
        width = min(candidates, hi)
        near = np.argpartition(part, width - 1, axis=1)[:, :width]
        dist = np.take_along_axis(part, near, axis=1)
        order = np.argsort(dist, axis=1, kind="stable")
        near, dist = np.take_along_axis(near, order, axis=1), np.take_along_axis(dist, order, axis=1)
        near[~np.isfinite(dist)] = -1
        r, c = np.nonzero(_diverse(near, dist, v, sq, most))
        src.append(r + lo)
        dst.append(near[r, c])
        gaps.append(dist[r, c])
    src, dst, gap = np.concatenate(src), np.concatenate(dst), np.concatenate(gaps)
    a, b, gap = np.concatenate((src, dst)), np.concatenate((dst, src)), np.concatenate((gap, gap))
    order = np.lexsort((gap, a))
    a, b, gap = a[order], b[order], gap[order]
    counts = np.bincount(a, minlength=n)
    start = np.cumsum(counts) - counts
    place = np.arange(len(a)) - start[a]
    out = np.full((n, most), -1, np.int32)
    few = counts[a] <= most
    out[a[few], place[few]] = b[few]
    rows = np.flatnonzero(counts > most)
    rows = rows[np.argsort(counts[rows], kind="stable")]
    for lo in range(0, len(rows), BLOCK):
        many = rows[lo : lo + BLOCK]
        lens = np.minimum(counts[many], 2 * candidates)
        at = start[many][:, None] + np.minimum(np.arange(lens.max()), lens[:, None] - 1)
        inside = np.arange(lens.max()) < lens[:, None]
        near, dist = np.where(inside, b[at], -1), np.where(inside, gap[at], np.inf)
        r, c = np.nonzero(_diverse(near, dist, v, sq, most))
        first = np.searchsorted(r, np.arange(len(many)))
        out[many[r], np.arange(len(r)) - first[r]] = near[r, c]
    return np.where(out >= 0, nodes[out], -1).astype(np.int32)


def build(ids: np.ndarray, vectors: np.ndarray, links: int = LINKS, candidates: int = CANDIDATES) -> dict:
    """The flat index of one shard. Equal vectors are one node with several ids."""
    vectors, which = np.unique(vectors, axis=0, return_inverse=True)
    which = which.reshape(-1)
    order = np.lexsort((ids, which))
    ids, counts = ids[order], np.bincount(which, minlength=len(vectors))
    n = len(vectors)
    rng = np.random.default_rng(n)
    shuffle = rng.permutation(n)  # insertion order
    levels = np.zeros(n, np.int64)
    levels[shuffle] = np.floor(-np.log(1 - rng.random(n)) / math.log(links)).astype(np.int64)
    every = _scaled(vectors, vectors)
    graphs, members = [], []
    for level in range(int(levels.max()) + 1):
        nodes = shuffle[levels[shuffle] >= level]
        rows = _layer(every, nodes, 2 * links if level == 0 else links, candidates)
        sort = np.argsort(nodes)
        graphs.append(rows[sort])
        members.append(nodes[sort].astype(np.int32) if level else np.zeros(0, np.int32))
    top = shuffle[levels[shuffle] == levels.max()][:1].astype(np.int32)
    return {"n": n, "ids": ids.astype(np.int64), "counts": counts.astype(np.int64), "vectors": np.ascontiguousarray(vectors, np.float64), "tops": top, "graphs": graphs, "members": members}


def _beam(v: np.ndarray, sq: np.ndarray, q: np.ndarray, entry: np.ndarray, neighbours, width: int) -> np.ndarray:
    """Best `width` nodes per query, nearest first, -1 for none, from entry nodes [Q, 1]; all queries step together."""
    rows = len(q)

    def gap(at: np.ndarray, live: np.ndarray) -> np.ndarray:
        return sq[at] - 2 * np.einsum("qed,qd->qe", v[at], q[live])  # the query's own square changes no order

    seen = np.zeros((rows, len(v)), bool)
    ids = np.full((rows, width), -1, np.int64)
    dist = np.full((rows, width), np.inf, np.float32)
    done = np.zeros((rows, width), bool)
    ids[:, :1], dist[:, :1] = entry, gap(entry, np.arange(rows))
    np.put_along_axis(seen, entry, True, axis=1)
    while True:
        open_ = ~done & (ids >= 0)
        live = np.flatnonzero(open_.any(axis=1))
        if not len(live):
            return ids
        at = open_[live].argmax(axis=1)
        done[live, at] = True
        near = neighbours(ids[live, at])
        safe = np.maximum(near, 0)
        fresh = (near >= 0) & ~seen[live[:, None], safe]
        seen[live[:, None], safe] |= fresh
        all_d = np.concatenate((dist[live], np.where(fresh, gap(safe, live), np.inf)), axis=1)
        all_i = np.concatenate((ids[live], np.where(fresh, near, -1)), axis=1)
        all_done = np.concatenate((done[live], np.zeros_like(fresh)), axis=1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :width]
        dist[live], ids[live], done[live] = (np.take_along_axis(x, order, 1) for x in (all_d, all_i, all_done))


def search(index: dict, query_ids: np.ndarray, queries: np.ndarray, k: int, beam: int = BEAM) -> pd.DataFrame:
    """(query_id, vec_id, score): up to k ids per query vector, its own id left out, by exact Euclidean distance in doubles."""
    v, graphs, members = index["vectors"], index["graphs"], index["members"]
    flat = _scaled(v, v)
    sq = _squares(flat)
    off = np.concatenate(([0], np.cumsum(index["counts"])))
    out: list[tuple[int, int, float]] = []
    for lo in range(0, len(queries), BLOCK):
        asked, q = query_ids[lo : lo + BLOCK], queries[lo : lo + BLOCK]
        near = _scaled(q, v)
        entry = np.repeat(index["tops"][None, :1].astype(np.int64), len(q), axis=0)
        for graph, nodes in list(zip(graphs, members, strict=True))[:0:-1]:
            entry = _beam(flat, sq, near, entry, lambda x, g=graph, m=nodes: g[np.searchsorted(m, x)], 1)
        found = _beam(flat, sq, near, entry, lambda x: graphs[0][x], beam)
        score = np.where(found >= 0, np.sqrt(((v[np.maximum(found, 0)] - q[:, None, :]) ** 2).sum(axis=2)), np.inf)
        order = np.argsort(score, axis=1, kind="stable")
        for qid, nodes, scores in zip(asked.tolist(), np.take_along_axis(found, order, 1).tolist(), np.take_along_axis(score, order, 1).tolist(), strict=True):
            best: list[tuple[float, int]] = []
            for node, s in zip(nodes, scores, strict=True):
                if node < 0 or len(best) >= k and s > best[k - 1][0]:
                    break
                best += [(s, i) for i in index["ids"][off[node] : off[node + 1]][: 2 * k + 1].tolist() if i != qid]  # ids are sorted: no more of equal vectors can be among the k nearest
            out += [(qid, i, s) for s, i in sorted(best)[: 2 * k]]  # an id with two vectors may stand twice
    found = pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": np.int64, "vec_id": np.int64, "score": np.float64})
    return found.sort_values(["score", "vec_id"], kind="stable").drop_duplicates(["query_id", "vec_id"]).groupby("query_id").head(k)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec, dim) of rows with an id whose vector is not null, empty or zero and has finite components only; equal rows once."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull())
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return rows.where(fine).dropDuplicates(["id", "vec"]).withColumn("dim", F.size("vec"))


def shard_counts(rows: DataFrame, shard_rows: int, every: int) -> DataFrame:
    """(dim, shards, slices), one row per dimension: how many shards its vectors and how many slices its queries are dealt into."""
    fit = F.greatest(F.lit(1), F.least(F.lit(shard_rows), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim")))))
    counts = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("asked"))
    return counts.select("dim", F.ceil(F.col("n") / fit).cast("int").alias("shards"), F.greatest(F.lit(1), F.ceil(F.col("asked") / SLICE)).cast("int").alias("slices"))


def index_shards(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """INDEX_SCHEMA, one row per shard of vectors of one dimension, dealt out by hash of the id."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = build(rows["id"].to_numpy(np.int64), np.stack(rows["vec"].to_numpy()))
        pack = {k: x[k].tobytes() for k in ("ids", "counts", "vectors", "tops")}
        return pd.DataFrame([{"dim": key[0], "shard": key[1], "n": x["n"], **pack, "graphs": [g.astype(np.int32).tobytes() for g in x["graphs"]], "members": [m.tobytes() for m in x["members"]]}])

    dealt = rows.join(F.broadcast(sizes), "dim").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))  # sizes: one row per dimension
    return dealt.groupBy("dim", "shard").applyInPandas(one, INDEX_SCHEMA)


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, shard_rows: int = 16_384) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): up to k nearest rows found for each row whose id is divisible by `every`.

    Nearest is the smallest Euclidean distance, ties to the smaller id; a row's own id is left out. Null, empty, zero
    or non-finite vectors and null ids take no part; vectors of another length are never compared; equal rows count
    once; an id with several vectors asks with each and answers once, with the nearest; a query without candidates has
    no row; an empty table gives an empty result; other columns are not read.

    A shard is read once per slice of queries, which is once up to SLICE queries; queries go to all shards of their length.
    """
    ship(vectors.sparkSession)
    rows = usable(vectors, id_col, vector_col)
    sizes = checkpointed(shard_counts(rows, shard_rows, every))
    index = checkpointed(index_shards(rows, sizes))
    sliced = index.join(F.broadcast(sizes), "dim").select(*index.columns, F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    asked = rows.where(F.col("id") % every == 0).join(F.broadcast(sizes), "dim")
    asked = asked.select("dim", "id", "vec", F.pmod(F.xxhash64("id", F.lit(3)), F.col("slices")).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))

    def run(key: tuple, shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        row = shard.iloc[0]
        n, dim = int(row["n"]), int(row["dim"])
        members = [np.frombuffer(m, np.int32) for m in row["members"]]
        graphs = [np.frombuffer(g, np.int32) for g in row["graphs"]]
        x = {
            "ids": np.frombuffer(row["ids"], np.int64), "counts": np.frombuffer(row["counts"], np.int64), "tops": np.frombuffer(row["tops"], np.int32),
            "vectors": np.frombuffer(row["vectors"], np.float64).reshape(n, dim), "members": members,
            "graphs": [g.reshape(n if i == 0 else len(members[i]), -1) for i, g in enumerate(graphs)],
        }
        return search(x, queries["id"].to_numpy(np.int64), np.stack(queries["vec"].to_numpy()), k)

    met = ["dim", "shard", "slice"]
    found = sliced.groupBy(*met).cogroup(asked.groupBy(*met)).applyInPandas(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
