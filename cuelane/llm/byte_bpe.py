"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts become pre-tokens with positions. Inside a block of documents equal pre-tokens are one word with all its
positions, so that only words are shuffled: all blocks' rows of a bucket of words meet in one task, each different word
is encoded once, ids are joined back to the blocks, and each block puts its documents together by position and meets
the token-byte table to decode them.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelane.llm.common import SLICE_BYTES, byte_slices, ragged_take, ship, texts_of

_RANKS: dict[str, dict[bytes, int]] = {}
#: Different words whose ids a task remembers.
SEEN_WORDS = 1_000_000
#: Bytes that no white space of any length begins with: a text may be cut before a space that one of them follows.
_SOLID = np.ones(256, bool)
_SOLID[:0x21] = False
_SOLID[[0xC2, 0xE1, 0xE2, 0xE3]] = False
_ASCII = np.zeros(256, bool)
_ASCII[0x21:0x7F] = True


def rank_file(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return path


def ranks(path: str | None) -> dict[bytes, int]:
    """Ranks by token bytes of a rank file: a line holds a token in base 64 and its rank."""
    path = rank_file(path)
    if path not in _RANKS:
        with open(path, "rb") as f:
            _RANKS[path] = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}
    return _RANKS[path]


def flat_strings(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after another, and offsets from 0."""
    texts = texts.cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) else np.zeros(0, np.uint8)
    return raw, off - off[0]


def pieces_of(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where pieces of the texts begin: at each text, before a space that no white space follows, and on both sides of a
    line end between characters. The pattern's matches never cross such a place, and are the same on both sides of it."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    first, last = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    first[off[:-1]] = True
    last[off[1:] - 1] = True  # of an empty text this is the end of the one before, or wraps to the spare place
    last, first = last[:n], first[:n]
    before_solid = np.zeros(n, bool)
    before_solid[:-1] = _SOLID[raw[1:]]
    before_solid &= ~last
    after_ascii = np.zeros(n, bool)
    after_ascii[1:] = _ASCII[raw[:-1]]
    line = (raw == 0x0A) & before_solid & after_ascii & ~first
    begin = first | ((raw == 0x20) & before_solid) | line
    begin[1:] |= line[:-1]
    return np.flatnonzero(begin)


def coded(raw: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Different pieces, and the number of each piece among them."""
    data = pa.py_buffer(np.ascontiguousarray(raw))
    bounds = pa.py_buffer(np.append(starts, len(raw)).astype(np.int64))
    out = pa.Array.from_buffers(pa.large_string(), len(starts), [None, bounds, data]).dictionary_encode()
    return out.dictionary, out.indices.to_numpy(zero_copy_only=False).astype(np.int64)


class Words:
    """Pre-tokens of different pieces, numbered as they come."""

    def __init__(self):
        import public_tokenizers
        import regex

        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.number: dict[str, int] = {}

    def of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pre-tokens of all pieces, flat, and how many each piece has."""
        number, flat, lens = self.number, [], np.empty(len(pieces), np.int64)
        for i, p in enumerate(pieces):
            found = self.split(p)
            lens[i] = len(found)
            flat += [number.setdefault(w, len(number)) for w in found]
        return np.array(flat, np.int64), lens


def merged(word: bytes, table: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: neighbours with the lowest rank of their joined bytes merge first, leftmost among equals. A heap
    holds the pairs, so that a long word takes n log n steps."""
    whole = table.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))  # by the first byte of a part
    alive = [True] * n
    heap = []

    def offer(i: int) -> None:
        j = right[i]
        if j < n:
            r = table.get(word[i : end[j]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or right[i] >= n or end[right[i]] != stop or end[i] == stop:
            continue  # one of the two has been merged since
        j = right[i]
        alive[j] = False
        end[i], right[i] = stop, right[j]
        if right[i] < n:
            left[right[i]] = i
        if left[i] >= 0:
            offer(left[i])
        offer(i)
    out, i = [], 0
    while i < n:
        out.append(table[word[i : end[i]]])
        i = right[i]
    return out


def packed(values: np.ndarray) -> bytes:
    """Whole numbers below 2^32 as compressed bytes, all lowest bytes first, then the next ones."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def _zipped(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unzipped(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


class Block:
    """Pre-tokens of some texts: how many each text has, the different words from the most frequent one on, and for all
    positions the number of the word there. Equal texts make equal blocks; key tells blocks."""

    def __init__(self, texts: pa.Array):
        raw, off = flat_strings(texts)
        starts = pieces_of(raw, off)
        pieces, use = coded(raw, starts)
        words = Words()
        flat, lens = words.of(pieces.to_pylist())
        codes = ragged_take(flat, (np.cumsum(lens) - lens)[use], lens[use])
        sums = np.concatenate(([0], np.cumsum(lens[use])))
        self.counts = np.diff(sums[np.searchsorted(starts, off)])  # pieces tile the texts, so that each begins with a piece of its own
        order = np.argsort(-np.bincount(codes, minlength=len(words.number)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.codes = rank[codes]
        found = [w.encode() for w in words.number]
        self.words = [found[i] for i in order]
        self.key = hashlib.blake2b(off.tobytes() + raw.tobytes(), digest_size=16).digest()

    def buckets(self, n: int) -> np.ndarray:
        return np.fromiter((zlib.crc32(w) % n for w in self.words), np.int64, len(self.words))


def _blocks(docs: DataFrame, block_bytes: int, rows: Callable[[Block, pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            for lo, hi in byte_slices(texts, block_bytes):
                yield rows(Block(texts.slice(lo, hi - lo)), batch.slice(lo, hi - lo))

    return docs.mapInArrow(run, schema)


def word_rows(docs: DataFrame, block_bytes: int, buckets: int) -> DataFrame:
    """(bucket, block, lens, words): the different words of a block that fall into a bucket, in one row."""

    def rows(block: Block, _: pa.RecordBatch) -> pa.RecordBatch:
        bucket = block.buckets(buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        out: list[list] = [[], [], [], []]
        for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=True):
            own = [block.words[i] for i in order[lo:hi]]
            for col, v in zip(out, (int(bucket[order[lo]]), block.key, _zipped(np.array([len(w) for w in own], "<u4").tobytes()), _zipped(b"".join(own))), strict=True):
                col.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int32(), *[pa.binary()] * 3], strict=True)], names=["bucket", "block", "lens", "words"])

    return _blocks(docs, block_bytes, rows, "bucket int, block binary, lens binary, words binary")


def position_rows(docs: DataFrame, block_bytes: int, buckets: int) -> DataFrame:
    """(block, ids, counts, codes, buckets): the documents of a block, their pre-tokens by number, and the bucket of each number."""
    id_type = docs.schema["id"].dataType.simpleString()

    def rows(block: Block, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0)
        data = [[block.key], [ids.to_pylist()], [block.counts.tolist()], [packed(block.codes)], [_zipped(block.buckets(buckets).astype("<u4").tobytes())]]
        types = [pa.binary(), pa.list_(ids.type), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(d, t) for d, t in zip(data, types, strict=True)], names=["block", "ids", "counts", "codes", "buckets"])

    return _blocks(docs, block_bytes, rows, f"block binary, ids array<{id_type}>, counts array<long>, codes binary, buckets binary")


def encode_words(words: DataFrame, path: str | None = None) -> DataFrame:
    """(block, bucket, lens, ids) of word_rows. All rows of a bucket meet in one task, which encodes each different word
    once; beyond SEEN_WORDS different words it begins anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(path)
        seen: dict[bytes, list[int]] = {}
        for batch in batches:
            out_lens, out_ids = [], []
            for lens, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                text, at, ids, n = _unzipped(text), 0, [], []
                for size in np.frombuffer(_unzipped(lens), "<u4").tolist():
                    word = text[at : at + size]
                    at += size
                    own = seen.get(word)
                    if own is None:
                        if len(seen) >= SEEN_WORDS:
                            seen.clear()
                        own = seen[word] = merged(word, table)
                    ids += own
                    n.append(len(own))
                out_lens.append(_zipped(np.array(n, "<u4").tobytes()))
                out_ids.append(_zipped(np.array(ids, "<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(out_lens, pa.binary()), pa.array(out_ids, pa.binary())], names=["block", "bucket", "lens", "ids"])

    return words.repartition("bucket").mapInArrow(run, "block binary, bucket int, lens binary, ids binary")


def token_bytes(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(token int, raw binary): one row per token of the rank file, some 50,000."""
    return spark.createDataFrame(pa.table({"token": pa.array(list(ranks(path).values()), pa.int32()), "raw": pa.array(list(ranks(path)), pa.binary())}))


def decode_ids(rows: DataFrame, key: str, path: str | None = None) -> DataFrame:
    """(key, ids, raw binary) of rows (key, ids array<int>) with different keys and at least one id: ids with their
    positions meet the token-byte table, whose size the vocabulary bounds, and ids and bytes are joined by position."""
    tokens = F.broadcast(token_bytes(rows.sparkSession, path))
    each = rows.select(key, F.posexplode("ids").alias("p", "token")).join(tokens, "token")
    parts = F.array_sort(F.collect_list(F.struct("p", "token", F.hex("raw").alias("h"))))
    one = each.groupBy(key).agg(parts.alias("parts"))
    return one.select(key, F.transform("parts", lambda x: x["token"]).alias("ids"), F.unhex(F.array_join(F.transform("parts", lambda x: x["h"]), "")).alias("raw"))


class TokenBytes:
    """Bytes of all tokens, one after another, with where each begins."""

    def __init__(self, path: str | None):
        table = ranks(path)
        raw = [b""] * (max(table.values()) + 1)
        for token, rank in table.items():
            raw[rank] = token
        self.raw, self.size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(b) for b in raw], np.int64)
        self.begin = np.cumsum(self.size) - self.size


_BYTES: dict[str, TokenBytes] = {}


def _together(left: pa.Table, right: pa.Table, path: str | None, keep: bool) -> pa.Table:
    """Rows of one block's documents from its positions and the ids of its words; bytes of ids from the token-byte table."""
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids", "decoded"] * keep
    cols: list[list] = [[] for _ in names]
    file = rank_file(path)
    if file not in _BYTES:
        _BYTES[file] = TokenBytes(path)
    tokens = _BYTES[file]
    coded_rows = {r["bucket"]: r for r in right.to_pylist()}  # equal blocks have equal rows
    lens = [np.frombuffer(_unzipped(coded_rows[b]["lens"]), "<u4") for b in sorted(coded_rows)]
    ids = np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(_unzipped(coded_rows[b]["ids"]), "<u4") for b in sorted(coded_rows))])
    lens = np.concatenate([np.zeros(0, np.int64), *lens]).astype(np.int64)
    start = np.cumsum(lens) - lens
    id_type = left.schema.field("ids").type.value_type
    for row in left.to_pylist():
        counts = np.array(row["counts"], np.int64)
        bucket = np.frombuffer(_unzipped(row["buckets"]), "<u4")
        if len(bucket) != len(lens):
            raise RuntimeError("the texts were dealt otherwise when they were read again; store the table first")
        place = np.empty(len(bucket), np.int64)
        place[np.argsort(bucket, kind="stable")] = np.arange(len(bucket))
        codes = place[unpacked(row["codes"], int(counts.sum()))]
        out = ragged_take(ids, start[codes], lens[codes])
        n = np.concatenate(([0], np.cumsum(lens[codes])))[np.concatenate(([0], np.cumsum(counts)))]
        cols[0] += row["ids"]
        cols[1] += np.diff(n).tolist()
        for x, y in zip(n[:-1], n[1:], strict=True):
            own = out[x:y]
            text = ragged_take(tokens.raw, tokens.begin[own], tokens.size[own]).tobytes()
            cols[2].append(hashlib.sha256(own.tobytes()).hexdigest())
            cols[3].append(hashlib.sha256(text).hexdigest())
            if keep:
                cols[4].append(own.tolist())
                cols[5].append(text)
    types = [id_type, pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names=names)


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, block_bytes: int = 2 * SLICE_BYTES, keep: bool = False) -> DataFrame:
    """(id, n_tokens long, ids_sha256, decoded_sha256), one row per input row; with keep also token_ids array<int> and decoded binary.

    Ids are those of the rank file for each match of the pattern, without special tokens; ids_sha256 is over them as
    little-endian 32-bit numbers. A null text counts as empty: no tokens. Texts of any length are encoded whole, repeated
    rows stay repeated, ids may be null, an empty table gives an empty one, other columns are not read. The texts are
    read twice, for words and for positions; a table whose rows come in another order each time has to be stored first,
    else the job fails.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    known = encode_words(word_rows(texts, block_bytes, buckets), path).withColumnRenamed("block", "home")
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>, decoded binary" * keep
    both = position_rows(texts, block_bytes, buckets).groupBy("block").cogroup(known.groupBy("home"))
    return both.applyInArrow(lambda left, right: _together(left, right, path, keep), schema).withColumnRenamed("id", id_col)
