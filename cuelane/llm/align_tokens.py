"""Alignment of two tokenizers over the same bytes: lockstep merging of token ends, many documents at a time.

All documents of a block advance together: one state vector holds the place in tokens A and B of every lane, each step
compares all ends at once, and lanes that are through leave the vector. A long document is several lanes, cut at token
ends of A, so that the number of steps is bounded. Counts of linked id pairs are summed over the table from one row per
block and pair, and come back to the blocks the same way.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelane.llm.byte_bpe import coded, flat_strings, packed, pieces_of, unpacked
from cuelane.llm.common import SLICE_BYTES, byte_slices, checkpointed, ragged_take, ship, texts_of

#: Tokens of A in a lane, and pieces of a row that A encodes at once.
LANE, ROW_PIECES = 1024, 4096
#: Bytes of text whose ids are lists at one time.
STEP_BYTES = 1 << 20
_A: dict[str, "ByteTokenizer"] = {}
_B: dict[str, "PieceTokenizer"] = {}


class ByteTokenizer:
    """A byte-level tokenizers file: ids of texts, and the bytes of each id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.tok.encode_special_tokens = True
        # Byte-level files write a byte that has a visible character as this character and the others as those from U+0100 on.
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(seen)]
        byte = {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}
        n = self.tok.get_vocab_size()
        entries = [self.tok.id_to_token(i) or "" for i in range(n)]
        raw = [bytes(byte[c] for c in e) if all(c in byte for c in e) else e.encode() for e in entries]
        self.raw, self.size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(b) for b in raw], np.int64)
        self.begin = np.cumsum(self.size) - self.size

    def _ids(self, texts: list[str]) -> np.ndarray:
        ids = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids)))

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and offsets. Texts are cut where no token crosses and different pieces are encoded once.

        A piece that begins with one space may follow any other, so such pieces are told to the library in long rows;
        as they tile a row, their ends in bytes say how many ids each has.
        """
        starts = pieces_of(raw, off)
        pieces, use = coded(raw, starts)
        texts = pieces.to_pylist()
        apart = np.fromiter((len(p) < 2 or p[0] != " " or p[1].isspace() for p in texts), bool, len(texts))
        order = np.argsort(apart, kind="stable")
        joined = len(texts) - int(apart.sum())
        rows = ["".join(texts[i] for i in order[lo : min(joined, lo + ROW_PIECES)]) for lo in range(0, joined, ROW_PIECES)] + [texts[i] for i in order[joined:]]
        flat = np.concatenate([np.zeros(0, np.int64), *(self._ids(rows[i : i + 20_000]) for i in range(0, len(rows), 20_000))])
        ends = np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False)[order].astype(np.int64))
        lens = np.diff(np.searchsorted(np.cumsum(self.size[flat]), ends, side="right"), prepend=0)
        at = np.empty(len(texts), np.int64)
        at[order] = np.arange(len(texts))
        slot = at[use]
        n = lens[slot]
        sums = np.concatenate(([0], np.cumsum(n)))
        return ragged_take(flat, (np.cumsum(lens) - lens)[slot], n), sums[np.searchsorted(starts, off)]


def tokenizer(path: str | None) -> ByteTokenizer:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _A:
        _A[path] = ByteTokenizer(path)
    return _A[path]


class PieceTokenizer:
    """A sentencepiece model: ids without begin and end, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        self.raw, self.size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(b) for b in raw], np.int64)
        self.begin = np.cumsum(self.size) - self.size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and offsets; a part of the texts at a time is a list."""
        flat, lens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in byte_slices(texts, STEP_BYTES):
            ids = self.sp.encode(texts.slice(lo, hi - lo).to_pylist(), num_threads=1)
            lens.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter(chain.from_iterable(ids), np.int64, int(lens[-1].sum())))
        return np.concatenate(flat), np.concatenate(([0], np.cumsum(np.concatenate(lens))))


def piece_tokenizer(path: str | None) -> PieceTokenizer:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    if path not in _B:
        _B[path] = PieceTokenizer(path)
    return _B[path]


def without(ids: np.ndarray, off: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the documents that are kept; the others have none."""
    n = np.diff(off)
    return ids[np.repeat(keep, n)], np.concatenate(([0], np.cumsum(np.where(keep, n, 0))))


def equal_bytes(tok, ids: np.ndarray, off: np.ndarray, raw: np.ndarray, raw_off: np.ndarray) -> np.ndarray:
    """Whether the joined bytes of a document's tokens are those of its text."""
    size = tok.size[ids]
    ends = np.concatenate(([0], np.cumsum(size)))[off]
    ok = np.diff(ends) == np.diff(raw_off)
    same, same_off = without(ids, off, ok)
    joined = ragged_take(tok.raw, tok.begin[same], tok.size[same])
    want = raw if ok.all() else raw[np.repeat(ok, np.diff(raw_off))]
    if np.array_equal(joined, want):
        return ok
    owner = np.repeat(np.arange(len(ok)), np.where(ok, np.diff(raw_off), 0))
    ok[owner[joined != want]] = False
    return ok


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, off_a: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and of B that end together, in order. Ends are cumulative over all documents, whose ends agree.

    The state holds for each lane its place in A and in B. A step compares the ends there, emits those that are equal as
    links and cuts, advances A where its end is not behind and B likewise, and drops lanes that are through.
    """
    n = np.diff(off_a)
    lanes = -(-n // lane)
    first = np.repeat(off_a[:-1], lanes) + lane * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    stop_a = np.append(first[1:], len(ends_a))
    begin_b = np.searchsorted(ends_b, np.where(first > 0, ends_a[first - 1], 0), side="right") if len(first) else first
    stop_b = np.append(begin_b[1:], len(ends_b))
    state, stop = np.stack((first, begin_b)), np.stack((stop_a, stop_b))
    state, stop = state[:, (state < stop).all(0)], stop[:, (state < stop).all(0)]
    linked_a, linked_b = [], []
    while state.shape[1]:
        a, b = ends_a[state[0]], ends_b[state[1]]
        together = a == b
        linked_a.append(state[0][together])
        linked_b.append(state[1][together])
        state[0] += a <= b
        state[1] += b <= a
        live = (state < stop).all(0)
        if not live.all():
            state, stop = state[:, live], stop[:, live]
    if not linked_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    partner = np.full(len(ends_a), -1)
    partner[np.concatenate(linked_a)] = np.concatenate(linked_b)
    ia = np.flatnonzero(partner >= 0)
    return ia, partner[ia]


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    text = [str(i).encode() + b"?" for i in range(n)]
    return np.frombuffer(b"".join(text), np.uint8), np.array([len(t) for t in text], np.int64)


_DIGITS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def written_groups(a: np.ndarray, b: np.ndarray, ia: np.ndarray, ib: np.ndarray, off_a: np.ndarray, off_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """'a1,a2|b1;a3|b2,b3' of all documents as bytes, and offsets. Each id is written with the sign behind it, in order of
    group, side and place; a document's last sign goes."""
    closes_a, closes_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    closes_a[ia] = closes_b[ib] = 1
    group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
    ends_a, ends_b = np.append(ia + 1, len(a)), np.concatenate(([0], ib + 1))
    at_a, at_b = np.arange(len(a)) + ends_b[group_a], np.arange(len(b)) + ends_a[group_b]
    ids, sign = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[at_a], ids[at_b] = a, b
    sign[at_a[ia]], sign[at_b[ib]] = ord("|"), ord(";")
    top = int(ids.max()) + 1 if len(ids) else 1
    size = 1 << top.bit_length()
    if size not in _DIGITS:
        _DIGITS[size] = _decimals(size)
    digits, lens = _DIGITS[size]
    out = ragged_take(digits, (np.cumsum(lens) - lens)[ids], lens[ids]).copy()
    stops = np.cumsum(lens[ids])
    out[stops - 1] = sign
    return out, np.concatenate(([0], stops))[off_a + off_b]


def align_block(texts: pa.Array, ta: ByteTokenizer, tb: PieceTokenizer) -> dict:
    """Per document numbers of tokens and links and the groups; for the links of the block their id pairs."""
    spaced = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
    raw, raw_off = flat_strings(spaced)
    a, off_a = ta.encode(raw, raw_off)
    b, off_b = tb.encode(texts)
    good = equal_bytes(ta, a, off_a, raw, raw_off) & equal_bytes(tb, b, off_b, raw, raw_off) & (np.diff(raw_off) > 0)
    (a, off_a), (b, off_b) = without(a, off_a, good), without(b, off_b, good)
    ia, ib = lockstep(np.cumsum(ta.size[a]), np.cumsum(tb.size[b]), off_a)
    out, out_off = written_groups(a, b, ia, ib, off_a, off_b)
    shas = [hashlib.sha256(out[x : y - 1].tobytes()).hexdigest() if y > x else "" for x, y in zip(out_off[:-1], out_off[1:], strict=True)]
    linked = pa.array(a[ia] << 32 | b[ib]).dictionary_encode()
    pairs, codes = linked.dictionary.to_numpy(), linked.indices.to_numpy().astype(np.int64)
    return {"n_a": np.diff(off_a), "n_b": np.diff(off_b), "n_groups": np.diff(np.searchsorted(ia, off_a)), "sha": shas, "pairs": pairs, "codes": codes, "n": np.bincount(codes, minlength=len(pairs))}


def link_blocks(docs: DataFrame, id_col: str, text_col: str, a_path: str | None, b_path: str | None, block_bytes: int) -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        ta, tb = tokenizer(a_path), piece_tokenizer(b_path)
        for batch in batches:
            texts = texts_of(batch.column(1))
            for lo, hi in byte_slices(texts, block_bytes):
                x = align_block(texts.slice(lo, hi - lo), ta, tb)
                row = [at, batch.column(0).slice(lo, hi - lo).to_pylist(), *(x[k].tolist() for k in ("n_a", "n_b", "n_groups")), x["sha"], packed(x["codes"]), x["pairs"].tolist(), x["n"].tolist()]
                ints = pa.list_(pa.int64())
                types = [pa.int64(), pa.list_(batch.column(0).type), ints, ints, ints, pa.list_(pa.string()), pa.binary(), ints, ints]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["block", "ids", "n_a", "n_b", "n_groups", "sha", "codes", "pairs", "n"])
                at += 1

    counts = "array<long>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"block long, ids array<{id_type}>, n_a {counts}, n_b {counts}, n_groups {counts}, sha array<string>, codes binary, pairs {counts}, n {counts}")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, count, best) of rows (pair, n): links corpus-wide, and whether no other id of A is linked to its id of B more
    often. The highest counts are one row per id of B, so that the vocabulary bounds what is broadcast."""
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.expr("pair & 4294967295"))
    high = F.broadcast(counts.groupBy("b").agg(F.max("count").alias("high")))
    return counts.join(high, "b").select("pair", "count", (F.col("count") == F.col("high")).alias("best"))


def _together(left: pa.Table, right: pa.Table) -> pa.Table:
    k = right["k"].to_numpy().astype(np.int64)
    count, best = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
    count[k], best[k] = right["count"].to_numpy(), right["best"].to_numpy(zero_copy_only=False)
    out: list[list] = [[] for _ in range(8)]
    for row in left.to_pylist():
        n = np.array(row["n_groups"], np.int64)
        codes = unpacked(row["codes"], int(n.sum()))
        off = np.concatenate(([0], np.cumsum(n)))
        sums = [np.diff(np.concatenate(([0], np.cumsum(v[codes])))[off]).tolist() for v in (best, count)]
        for col, values in zip(out, (row["ids"], row["n_a"], row["n_b"], row["n_groups"], row["n_groups"], *sums, row["sha"]), strict=True):
            col += values
    types = [left.schema.field("ids").type.value_type, *[pa.int64()] * 6, pa.string()]
    return pa.table([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, block_bytes: int = SLICE_BYTES) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per input row.

    A is a byte-level tokenizers file over space and text, B a sentencepiece model over the text. Texts that are null,
    empty or not given back by the tokens of either have no tokens: zeros and ''. Texts of any length are aligned whole,
    repeated rows count as often as they are there, ids may be null, an empty table gives an empty one, other columns are not read.
    """
    ship(docs.sparkSession)
    blocks = checkpointed(link_blocks(docs, id_col, text_col, a_path, b_path, block_bytes))
    places = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "n")).alias("k", "x")).select("block", "k", "x.pairs", "x.n").withColumnRenamed("pairs", "pair")
    back = places.join(pair_counts(places.select("pair", "n")), "pair").select(F.col("block").alias("home"), "k", "count", "best")
    id_type = docs.schema[id_col].dataType.simpleString()
    both = blocks.select("block", "ids", "n_a", "n_b", "n_groups", "sha", "codes").groupBy("block").cogroup(back.groupBy("home"))
    return both.applyInArrow(_together, f"id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string").withColumnRenamed("id", id_col)
