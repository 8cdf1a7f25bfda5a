"""SentencePiece (merge type) encoding by a prefix table, and decoding.

For every prefix of a text the encoding of that prefix ends in one token only. That token is the one match of the
vocabulary automaton ending there whose predecessor's last token it may follow: two tokens may stand side by side
if their joined text, merged alone, gives just these two. The table of last tokens is filled from left to right and
the ids are read off it from the end. No token crosses the start of a space run or a character outside the
vocabulary, so texts are cut there and each different piece is encoded once per slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelane.llm.common import SLICE_BYTES, byte_slices, list_offsets, ragged_take, ship, sums_by_row, texts_of

SPACE = "▁"
_MODELS: dict[str, "PieceModel"] = {}
#: Characters encoded in one step, pieces and their characters whose ids a worker remembers between slices, and places of pairs that are found at once.
STEP_CHARS, SEEN_PIECES, SEEN_CHARS, PAIR_PLACES = 200_000, 400_000, 8_000_000, 1 << 20


class PieceModel:
    """Vocabulary, automaton and pair table of one model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.path = path
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        for text in ("a  b ", "\ufb01 \u00bd e\u0301\u3000\t\u200b"):  # texts that any normaliser would change
            if sp.decode(sp.encode(text)) != text:
                raise ValueError("the model normalises texts; only models that leave them as they are can be encoded here")
        self.size = n = sp.get_piece_size()
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.score = {p: sp.get_score(i) for i, p in enumerate(pieces) if not special[i]}
        self.ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        self.text = pieces
        self.chars = {p for p in self.ids if len(p) == 1}
        self.byte_id = np.zeros(256, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_id[int(pieces[i][3:5], 16)] = i
        self.length = np.array([len(p) for p in pieces], np.int32)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if self.merge(p) == [p]:  # a token that merging never yields is no last token of anything
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        out = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.out_flat = np.frombuffer(b"".join(out), np.uint8)
        self.out_len = np.array([len(b) for b in out], np.int64)
        self.out_off = np.concatenate(([0], np.cumsum(self.out_len)))
        self.pair_codes, self.pair_ok = np.zeros(0, np.int64), np.zeros(0, bool)
        self.near_code, self.near_ok = np.full(PAIR_PLACES, -1), np.zeros(PAIR_PLACES, bool)
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.seen_chars = 0
        self.seen_ids, self.seen_len = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def merge(self, text: str) -> list[str]:
        """Merging by score, leftmost first among equals: the definition, used for single tokens and pairs only."""
        score, parts = self.score, list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether right may follow left; answers are kept in a sorted table, and the latest for each place of a smaller one that is looked into first. Ids from `size` on are characters outside the vocabulary, which nothing merges with."""
        ok = (left >= self.size) | (right >= self.size)
        ask = np.flatnonzero(~ok)
        codes = left[ask].astype(np.int64) * self.size + right[ask]
        place = (codes ^ codes >> 17) * 0x9E3779B1 >> 12 & PAIR_PLACES - 1
        near = self.near_code[place] == codes
        ok[ask[near]] = self.near_ok[place[near]]
        ask, codes, place = ask[~near], codes[~near], place[~near]
        if len(codes):
            known = self._find(codes)
            miss = np.unique(codes[known < 0])
            if len(miss):
                fresh = np.fromiter((self._pair(c // self.size, c % self.size) for c in miss.tolist()), bool, len(miss))
                codes_all = np.concatenate((self.pair_codes, miss))
                order = np.argsort(codes_all, kind="stable")
                self.pair_codes, self.pair_ok = codes_all[order], np.concatenate((self.pair_ok, fresh))[order]
                known = self._find(codes)
            ok[ask] = self.pair_ok[known]
            self.near_code[place] = codes
            self.near_ok[place] = ok[ask]
        return ok

    def _find(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.pair_codes):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.pair_codes, codes), len(self.pair_codes) - 1)
        return np.where(self.pair_codes[at] == codes, at, -1)

    def _pair(self, a: int, b: int) -> bool:
        return self.merge(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]

    def piece_table(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, counts): the ids of piece i are ids[starts[i] : starts[i] + counts[i]]. Pieces seen before are looked up."""
        if len(self.seen) > SEEN_PIECES or self.seen_chars > SEEN_CHARS:
            self.forget()
        seen, new, held = self.seen, [], 0
        flat, lens = [self.seen_ids], [self.seen_len]

        def step() -> None:
            ids, counts = self.encode_pieces(new)
            flat.append(ids)
            lens.append(counts)

        for p in pieces:
            if p not in seen:
                seen[p] = len(seen)
                new.append(p)
                held += len(p)
                self.seen_chars += len(p)
                if held > STEP_CHARS:
                    step()
                    new, held = [], 0
        step()
        self.seen_ids, self.seen_len = np.concatenate(flat), np.concatenate(lens)
        slot = np.fromiter(map(seen.__getitem__, pieces), np.int64, len(pieces))
        return self.seen_ids, (np.cumsum(self.seen_len) - self.seen_len)[slot], self.seen_len[slot]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each piece, flat, and how many each has."""
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        joined = "".join(pieces)
        total = len(joined)
        if not total:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(n), sizes)
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int32).reshape(-1, 2)
        end, tok = found[:, 0] + 1, found[:, 1]
        start = end - self.length[tok]
        inside = start >= begin[owner[end - 1]]
        end, tok, start = end[inside], tok[inside], start[inside]
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        odd = [c for c in set(joined) if c not in self.chars]
        if odd:  # one made-up token per character outside the vocabulary
            codes = np.sort(np.array([ord(c) for c in odd], np.uint32))
            at = np.flatnonzero(np.isin(points, codes))
            end = np.concatenate((end, at + 1))
            start = np.concatenate((start, at))
            tok = np.concatenate((tok, self.size + np.searchsorted(codes, points[at])))
        level = end - begin[owner[end - 1]]
        order = np.argsort(level, kind="stable")
        start, end, tok, level = start[order], end[order], tok[order], level[order]
        first = start == begin[owner[end - 1]]
        last = np.full(total + 1, -1, np.int64)  # by end: the last token of the prefix
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(level)) + 1, [len(level)]))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            s, t, e = start[lo:hi], tok[lo:hi], end[lo:hi]
            ok = first[lo:hi].copy()
            rest = np.flatnonzero(~ok)
            if len(rest):
                ok[rest] = self.compatible(last[s[rest]], t[rest])
            last[e[ok]] = t[ok]
        extra = np.ones(len(odd), np.int32)
        length = np.concatenate((self.length, extra))
        at, live, back_tok, back_own = begin + sizes, np.flatnonzero(sizes > 0), [], []
        while len(live):  # ids from the end to the start, for all pieces at once
            t = last[at[live]]
            back_tok.append(t)
            back_own.append(live)
            at[live] -= length[t]
            live = live[at[live] > begin[live]]
        tokens, owners = np.concatenate(back_tok[::-1]), np.concatenate(back_own[::-1])
        order = np.argsort(owners, kind="stable")
        tokens, owners = tokens[order], owners[order]
        if odd:  # bytes stand for characters outside the vocabulary
            raw = [chr(c).encode() for c in codes.tolist()]
            flat = np.concatenate([self.byte_id[list(b)] for b in raw])
            table = np.concatenate((np.arange(self.size, dtype=np.int32), flat))
            lens = np.concatenate((np.ones(self.size, np.int64), [len(b) for b in raw]))
            off = np.cumsum(lens) - lens
            take = lens[tokens]
            counts = np.bincount(owners, weights=take, minlength=n).astype(np.int64)
            return ragged_take(table, off[tokens], take).astype(np.int32), counts
        return tokens.astype(np.int32), np.bincount(owners, minlength=n)

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text with begin and end, flat, and offsets."""
        sep = separator(texts)
        full = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(SPACE, pc.replace_substring(texts, " ", SPACE), ""))
        cut = pc.replace_substring_regex(full, f"([^{SPACE}]){SPACE}", f"\\1{sep}{SPACE}")
        lists = pc.split_pattern(pc.replace_substring(cut, "\n", f"{sep}\n{sep}"), sep)
        pieces = lists.flatten().dictionary_encode()
        ids, off, counts = self.piece_table(pieces.dictionary.to_pylist())
        use = pieces.indices.to_numpy().astype(np.int64)
        n = sums_by_row(counts[use], list_offsets(lists))
        flat = ragged_take(ids, off[use], counts[use])
        out = np.empty(len(flat) + 2 * len(n), np.int32)
        offsets = np.concatenate(([0], np.cumsum(n + 2)))
        inner = np.ones(len(out), bool)
        inner[offsets[:-1]] = inner[offsets[1:] - 1] = False
        out[inner] = flat
        out[offsets[:-1]], out[offsets[1:] - 1] = self.bos, self.eos
        return out, offsets

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 text of the ids: control ids vanish, the space that the encoder put in front goes, runs of bytes are joined, and bytes that form no character become U+FFFD."""
        raw = ragged_take(self.out_flat, self.out_off[ids], self.out_len[ids]).tobytes()
        real = ids[self.out_len[ids] > 0]
        if len(real) and self.text[real[0]].startswith(SPACE):
            raw = raw[1:]
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return b"".join(b"\xef\xbf\xbd" if c in range(0xDC80, 0xDD00) else chr(c).encode() for c in map(ord, raw.decode("utf-8", "surrogateescape")))


def separator(texts: pa.Array) -> str:
    """A string that no text holds: one private-use character, or, where all are in use, a run of one between two of another that is longer than any in the texts."""

    def held(x: str) -> bool:
        return bool(pc.any(pc.match_substring(texts, x)).as_py())

    for c in map(chr, range(0xE000, 0xF900)):
        if not held(c):
            return c
    k = 1
    while held("\ue000" + "\ue001" * k):
        k += 1
    return "\ue000" + "\ue001" * k + "\ue000"


def model(path: str | None) -> PieceModel:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, batch_bytes: int = SLICE_BYTES, keep: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), and with keep also ids array<int> and decoded string.

    Ids carry begin and end. A null text counts as empty (begin and end only, decoded to the empty text); repeated
    rows stay, ids may be null, an empty table gives an empty one, other columns are not read. Texts of any length
    are encoded whole, in slices of `batch_bytes`.
    """
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for batch in batches:
            texts = texts_of(batch.column(1))
            for lo, hi in byte_slices(texts, batch_bytes):
                ids, off = m.encode_texts(texts.slice(lo, hi - lo))
                rows = [ids[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
                decoded = [m.decode(r) for r in rows]
                cols = [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array(np.diff(off)),
                    pa.array([hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in rows], pa.string()),
                    pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
                ]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep:
                    cols += [pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids)), pa.array([d.decode() for d in decoded], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
