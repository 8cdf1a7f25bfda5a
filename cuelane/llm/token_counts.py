"""Token counts: batch encoding inside Arrow functions that return lengths only."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelane.llm.common import SLICE_BYTES, byte_slices, list_offsets, ship, sums_by_row, texts_of

_LOADED: dict[str, object] = {}
_SEEN: dict[str, dict[str, int]] = {}
#: Pieces whose lengths a worker remembers between batches.
SEEN_PIECES = 400_000


def _tokenizer(path: str | None):
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _LOADED[path] = tok
        _SEEN[path] = {}
    return _LOADED[path], _SEEN[path]


def piece_lengths(pieces: list[str], path: str | None) -> np.ndarray:
    """Tokens of each piece, encoded in one batch call; lengths of pieces seen before come from the worker's table."""
    tok, seen = _tokenizer(path)
    new = [p for p in pieces if p not in seen]
    if len(seen) + len(new) > SEEN_PIECES:
        seen.clear()
        new = pieces
    fresh = {}
    for i in range(0, len(new), 20_000):  # lengths only: encodings of one call are let go before the next
        part = new[i : i + 20_000]
        fresh.update(zip(part, map(len, tok.encode_batch_fast(part, add_special_tokens=False)), strict=True))
    if len(fresh) <= SEEN_PIECES:
        seen.update((k, v) for k, v in fresh.items() if len(k) <= 64)
    return np.fromiter((fresh[p] if p in fresh else seen[p] for p in pieces), dtype=np.int64, count=len(pieces))


def count_slice(texts: pa.Array, path: str | None) -> np.ndarray:
    """Tokens of each text. White space is dropped by this vocabulary and no rule looks across it, so texts are cut there; equal pieces are encoded once."""
    lists = pc.ascii_split_whitespace(texts)
    pieces = lists.flatten().dictionary_encode()
    lengths = piece_lengths(pieces.dictionary.to_pylist(), path)
    return sums_by_row(lengths[pieces.indices.to_numpy()] if len(lengths) else np.zeros(0, np.int64), list_offsets(lists))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, batch_bytes: int = SLICE_BYTES) -> DataFrame:
    """(id, n_bytes long, n_tokens long), one row per input row, in tokens of a word-level tokenizers file.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows stay repeated, a null id stays null, an empty
    table gives an empty one, and other columns are not read. Only lengths leave the workers. Work is cut into
    slices of `batch_bytes` of text, of batches that spark.sql.execution.arrow.maxBytesPerBatch (16 MB unless set) bounds; inside, each text of any length is cut at white space, where no token crosses.
    """
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            for lo, hi in byte_slices(texts, batch_bytes):
                part = texts.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pc.binary_length(part).cast(pa.int64()), pa.array(count_slice(part, tokenizer_path))],
                    names=["id", "n_bytes", "n_tokens"],
                )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
