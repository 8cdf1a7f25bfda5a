"""Byte-level BPE, alignment of two tokenizers and importance resampling against the libraries and brute force."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cuelane.llm import align_tokens, byte_bpe, resample

RNG = random.Random(7)
SIGNS = [*"ab the ing\n\t\r  é日　  x's'll12.,!?\x1c\x00\x85ñß", "'re", " the", "\n\n", " ", "한", "😀", "<|endoftext|>", "</s>", " naïve", ".\n"]


def mixed(n):
    return "".join(RNG.choice(SIGNS) for _ in range(n))


TEXTS = [None, "", " ", "a", "\n", "one line\nand another\n\nlast  ", "it's <|endoftext|> <s> é 12", "▁ odd", "word and others " * 3000, "x" * 20000, "日本語" * 500, *(mixed(RNG.randint(1, 90)) for _ in range(60))]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5]), (None, "null id here"), (90, TEXTS[5]), (91, TEXTS[6])]


def docs_of(spark, rows=ROWS, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS id", "'q' AS block", "2 AS k", "3 AS n", "'z' AS word", "4 AS rank", "5 AS ids").repartition(parts)


@pytest.fixture(scope="module")
def tik():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merges_equal_the_library(tik):
    table = byte_bpe.ranks(None)
    for text in ["a" * 3000, "ab" * 1500, *("".join(RNG.choice("abehinrst") for _ in range(RNG.randint(1, 60))) for _ in range(500))]:
        assert byte_bpe.merged(text.encode(), table) == tik.encode_ordinary(text)


def test_pieces_hold_whole_matches(tik):
    texts = [mixed(RNG.randint(0, 60)) for _ in range(2000)]
    raw, off = byte_bpe.flat_strings(pa.array(texts))
    starts = byte_bpe.pieces_of(raw, off)
    pieces, use = byte_bpe.coded(raw, starts)
    pieces = pieces.to_pylist()
    bounds = np.searchsorted(starts, off)
    for t, lo, hi in zip(texts, bounds[:-1], bounds[1:], strict=True):
        cut = [pieces[u] for u in use[lo:hi]]
        assert "".join(cut) == t and [x for p in cut for x in tik.encode_ordinary(p)] == tik.encode_ordinary(t)


@pytest.mark.parametrize("block_bytes", [200, 1 << 22])
def test_byte_bpe(spark, tik, block_bytes):
    def row(i, t):
        ids = tik.encode_ordinary(t or "")
        return str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tik.decode_bytes(ids)).hexdigest(), str(ids), (t or "").encode()

    got = byte_bpe.encode_decode(docs_of(spark), block_bytes=block_bytes, keep=True).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, str(list(r.token_ids)), bytes(r.decoded)) for r in got) == sorted(row(*r) for r in ROWS)
    assert byte_bpe.encode_decode(docs_of(spark, [])).count() == 0


def test_decode_ids_joins_the_token_table(spark, tik):
    ids = [tik.encode_ordinary(t) for t in ("one two", "日本 ü", "x")]
    got = byte_bpe.decode_ids(spark.createDataFrame(list(enumerate(ids)), "n int, ids array<int>"), "n").collect()
    assert {r.n: (list(r.ids), bytes(r.raw)) for r in got} == {n: (x, tik.decode_bytes(x)) for n, x in enumerate(ids)}


def brute_tokens(text, _made={}):
    """(ids of A, their bytes, ids of B, their bytes), or nothing where the bytes are not those of the text."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    if not _made:
        _made["a"] = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        _made["a"].encode_special_tokens = True
        _made["b"] = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    if not text:
        return [], [], [], []
    a, sp = _made["a"], _made["b"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    raw_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
    raw_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    want = (" " + text).encode()
    return (ids_a, raw_a, ids_b, raw_b) if b"".join(raw_a) == want == b"".join(raw_b) else ([], [], [], [])


def brute_alignment(rows):
    each = []
    for i, t in rows:
        a, raw_a, b, raw_b = brute_tokens(t)
        end_a, end_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        links = [(x, y) for x, ex in zip(a, end_a, strict=True) for y, ey in zip(b, end_b, strict=True) if ex == ey] if len(a) < 3000 else [(a[end_a.index(e)], b[end_b.index(e)]) for e in sorted(set(end_a) & set(end_b))]
        groups, lo = [], 0
        for e in sorted(set(end_a) & set(end_b)):
            groups.append(",".join(str(x) for x, s in zip(a, end_a, strict=True) if lo < s <= e) + "|" + ",".join(str(x) for x, s in zip(b, end_b, strict=True) if lo < s <= e) if len(a) < 3000 else None)
            lo = e
        each.append((i, len(a), len(b), groups, links))
    count = Counter(x for *_, links in each for x in links)
    high = {}
    for (_, b), n in count.items():
        high[b] = max(n, high.get(b, 0))
    sha = lambda g: "long" if None in g else hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return sorted((str(i), na, nb, len(g), len(links), sum(count[x] == high[x[1]] for x in links), sum(count[x] for x in links), sha(g)) for i, na, nb, g, links in each)


@pytest.mark.parametrize("block_bytes", [300, 1 << 22])
def test_alignment(spark, block_bytes):
    want = brute_alignment(ROWS)
    got = sorted(tuple(str(v) if k == 0 else v for k, v in enumerate(r)) for r in align_tokens.align(docs_of(spark), block_bytes=block_bytes).collect())
    assert [g[:7] for g in got] == [w[:7] for w in want]
    assert all(g[7] == w[7] for g, w in zip(got, want, strict=True) if w[7] != "long")
    assert align_tokens.align(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("lane", [1, 2, 7, 1024])
def test_lockstep_equals_common_ends(lane):
    r = np.random.default_rng(lane)
    docs = [int(n) for n in r.integers(0, 60, 40)]
    ends_a, ends_b, off = [], [], [0]
    for n in docs:
        base = ends_a[-1] if ends_a else 0
        for ends in (ends_a, ends_b):
            inner = np.flatnonzero(r.random(max(n - 1, 0)) < 0.5) + 1
            ends += [base + int(x) for x in inner] + ([base + n] if n else [])
        off.append(len(ends_a))
    ia, ib = align_tokens.lockstep(np.array(ends_a, np.int64), np.array(ends_b, np.int64), np.array(off), lane)
    both = sorted(set(ends_a) & set(ends_b))
    assert [ends_a[i] for i in ia] == both == [ends_b[i] for i in ib]


def brute_resample(rows, target, pairs, buckets, seed, percent, least):
    def feats(t):
        ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return ws + ([f"{a} {b}" for a, b in zip(ws[:-1], ws[1:], strict=True)] if pairs else []), len(ws)

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in rows for f in feats(x)[0]), Counter(bucket(f) for x in target for f in feats(x)[0])
    S, T = s.total(), t.total()
    out = []
    for i, x in rows:
        fs, n = feats(x)
        w = sum(math.floor(1000 * math.log((t[b] + 1.0) * (S + float(buckets)) / ((s[b] + 1.0) * (T + float(buckets))))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    drawn = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(drawn[: percent * len(drawn) // 100], 1):
        r[4] = k
    return sorted(str(tuple(r[:5])) for r in out)


@pytest.mark.parametrize("pairs", [False, True])
@pytest.mark.parametrize("head", [None, resample.Head([], []), resample.Head(["the", "and"], [("the", "and"), ("and", "gone")])])
def test_resample(spark, pairs, head):
    vocab = ["the", "and", "Stone", "river", "Über", "naïve", "日本", "x9", "it's", "w" * 100]
    rows = [(i, " ".join(RNG.choice(vocab) for _ in range(RNG.randint(0, 60)))) for i in range(120)] + [(200, None), (201, ""), (202, "the " * 5000), (203, "Z" * 30000), (None, "the and " * 20), (7, "the stone " * 15), (7, "the stone " * 15)]
    target = ["the river and the stone", None, "", "日本 the the"]
    docs = docs_of(spark, rows)
    goal = spark.createDataFrame([(t,) for t in target], "text string").selectExpr("text", "1 AS id")
    got = resample.resample(docs, goal, pairs=pairs, buckets=50, percent=30, least_words=5, head=head).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_resample(rows, target, pairs, 50, 2024, 30, 5)
    assert resample.resample(docs_of(spark, []), goal, pairs=pairs, head=head).count() == 0


def test_ranks_are_gapless_over_ranges(spark):
    from pyspark.sql import functions as F

    rows = spark.range(500).selectExpr("id", "id % 7 AS score", "id % 3 > 0 AS ok").union(spark.range(300).selectExpr("9L", "3L", "true"))  # many equal rows
    got, n = resample.ranked(rows, F.col("ok"), F.desc("score"), F.asc("id"))
    got = got.collect()
    assert n == 633 and sorted(r["rank"] for r in got if r.ok) == list(range(1, 634)) and all(r["rank"] is None for r in got if not r.ok)
    at = [(-r.score, r.id) for r in sorted((r for r in got if r.ok), key=lambda r: r["rank"])]
    assert at == sorted(at)


def test_head_is_the_most_frequent(spark):
    docs = spark.createDataFrame([("b a b c",), ("A b",), (None,)], "text string")
    h = resample.head_of(docs, "text", True, 2, 1)
    assert h.words.to_pylist() == ["a", "b"] and len(h.pair) == 1


def test_the_session_keeps_its_own_batch_size(spark):
    from cuelane.llm.common import ship

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    ship(spark)
    assert spark.conf.get(name) == f"{16 << 20}b"
    own = spark.newSession()
    own.conf.set(name, "67108864b")
    ship(own)
    assert own.conf.get(name) == "67108864b"


def test_pairs_and_pieces_seen_before_are_not_worked_out_again(monkeypatch):
    import random

    import pyarrow as pa

    from cuelane.llm import sentencepiece_bpe as sb

    rng = random.Random(11)
    syllables = ["ka", "men", "to", "rí", "la", "ción", "ez", "über"]
    texts = pa.array([" ".join("".join(rng.choices(syllables, k=rng.randrange(1, 6))) for _ in range(300)) for _ in range(20)])
    m = sb.PieceModel(sb.model(None).path)
    want, offsets = m.encode_texts(texts)
    asked = []
    monkeypatch.setattr(m, "_find", lambda codes, find=m._find: asked.append(len(codes)) or find(codes))
    m.forget()  # pieces are encoded again, from pairs that are known
    got, again = m.encode_texts(texts)
    assert (got == want).all() and (again == offsets).all() and sum(asked) < len(m.pair_codes) / 2
    monkeypatch.setattr(sb, "SEEN_CHARS", 100)
    m.encode_texts(texts)
    assert m.seen_chars < 20 * 300 * 30 and (m.encode_texts(texts)[0] == want).all()
