"""Operators against brute force and libraries on small tables with nulls, empty and very long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cuelane.llm import decontaminate, hnsw, html_extract, langid, line_dedup, quality, sentencepiece_bpe, sharding, simhash, token_counts

RNG = random.Random(5)
VOCAB = ["the", "and", "Stone", "river", "walks", "über", "naïve", "日本", "x", "###", "it's", "running", "hills"]


def prose(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


TEXTS = [None, "", " ", "a", "one line\nand another line\n\nand another line", "tab\tand\x0bvt\x1fus", prose(30), prose(30), "word " * 9000, "x" * 30000, "<|endoftext|> it's 12 é", "▁▁ odd  ▁", "ΑΒΓΣ ς", prose(400)]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(6, TEXTS[6]), (None, "null id here"), (20, TEXTS[6])]


def docs_of(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n_tokens", "'q' AS fingerprint", "2 AS fp", "3 AS h1", "4 AS keep", "5 AS id", "'z' AS item_ids")


def test_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = token_counts.count_tokens(docs_of(spark), batch_bytes=1000).collect()
    want = sorted((str(i), len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert token_counts.count_tokens(docs_of(spark, [])).count() == 0


def test_sentencepiece(spark):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def row(i, t):
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        return str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()

    got = sentencepiece_bpe.encode_decode(docs_of(spark)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(row(*r) for r in ROWS)
    kept = sentencepiece_bpe.encode_decode(docs_of(spark), keep=True).where("doc_id = 6").first()
    assert kept.decoded == TEXTS[6]
    m = sentencepiece_bpe.model(None)
    texts = ["".join(RNG.choice("ab the ing▁\n\tαβ日x  ,.") for _ in range(RNG.randint(0, 50))) for _ in range(300)]
    ids, off = m.encode_texts(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [[1, *x, 2] for x in sp.encode(texts)]
    every = "".join(map(chr, range(0xE000, 0xF900))) + " a \ue000\ue001 b\nc\ue000\ue001\ue001"
    sep = sentencepiece_bpe.separator(pa.array([every]))
    assert len(sep) > 1 and sep not in every
    ids, off = m.encode_texts(pa.array([every, "x y"]))
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [[1, *x, 2] for x in sp.encode([every, "x y"])]
    odd = [300, 200, 130, 131, 132, 500]  # bytes that form no character
    assert m.decode(np.array(odd)).decode() == sp.decode(odd)


def reference_print(text):
    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hs = [xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(spark):
    base = prose(60).split()
    rows = list(ROWS)
    for i in range(40):
        w = list(base)
        for _ in range(i % 4):
            w[RNG.randrange(len(w))] = RNG.choice(VOCAB)
        rows.append((100 + i, " ".join(w)))
    fps = [reference_print(t) for _, t in rows]
    comp = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    low = {}
    for (i, _), c in zip(rows, comp, strict=True):
        if i is not None:
            low[c] = min(i, low.get(c, i))
    want = sorted((str(i), f"{f:016x}", low.get(c)) for (i, _), f, c in zip(rows, fps, comp, strict=True))
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("radius", [3, 4, 5])
def test_links_are_whole(spark, radius):
    r = np.random.default_rng(radius)
    seeds = r.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = {int(s) for s in seeds}
    for s in seeds.tolist():
        for _ in range(15):
            x = s
            for b in r.choice(64, r.integers(0, radius + 3), replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), radius).collect()]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius}
    assert len(got) == len(set(got)) and set(got) == want


def test_index_of_fingerprints_is_not_broadcast(spark):
    """The planner sizes it like the fingerprints, of which it has 64 rows each."""
    plan = simhash.links(spark.range(1000).selectExpr("id AS fp"), 4)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("radius", [3, 4, 5])
def test_connected_equals_all_pairs(spark, radius):
    """Chains of near fingerprints, a dense group and lone ones against components over all pairs."""
    r = np.random.default_rng(radius)
    fps = set(r.integers(0, 1 << 63, 40, dtype=np.uint64).tolist())
    for s in r.integers(0, 1 << 63, 8, dtype=np.uint64).tolist():
        x = s
        for _ in range(40):
            fps.add(x)
            x = (x if r.random() < 0.5 else s) ^ sum(1 << b for b in r.choice(64, r.integers(1, radius + 4), replace=False).tolist())
    fps = [x - (1 << 64) if x >> 63 else x for x in fps]
    comp = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= radius])
    low = {}
    for f, c in zip(fps, comp, strict=True):
        low[c] = min(f, low.get(c, f))
    got = {x.node: x.root for x in simhash.connected(spark.createDataFrame([(x,) for x in fps], "fp long"), radius).collect()}
    assert {f: got.get(f, f) for f in fps} == {f: low[c] for f, c in zip(fps, comp, strict=True)}
    assert len({low[c] for c in comp}) > 40


def test_similar_groups(spark):
    base = [f"term{i}" for i in range(200)]
    near = list(base)
    near[100] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, prose(50)), (5, None), (6, ""), (None, " ".join(base)), (7, " ".join(base[::-1]))]
    got = {r.id: r.component_id for r in simhash.similar_groups(docs_of(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, None: 1, 7: 7}
    assert {r.doc_id for r in simhash.drop_similar(docs_of(spark, rows)).collect()} == {1, 4, 5, None, 7}


def five_word_jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_similar_groups_beyond_the_radius(spark):
    """Pairs of similarity 0.8 and more stay one group where their fingerprints differ in more bits than the radius."""
    r = random.Random(11)
    rows = []
    while len(rows) < 60:
        text = [f"w{r.randrange(10**6)}" for _ in range(60)]
        near = [*text[:-5], *(f"internationalisation{r.randrange(10**6)}" for _ in range(5))]
        pair = " ".join(text), " ".join(near)
        a, b = simhash.fingerprint_texts([t.encode() for t in pair], 5, "words").tolist()
        if (a ^ b).bit_count() > 5:
            assert five_word_jaccard(*pair) >= 0.8
            rows += [(len(rows), pair[0]), (len(rows) + 1, pair[1])]
    got = {x.id: x.component_id for x in simhash.similar_groups(docs_of(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_similar_groups_equal_all_pairs(spark):
    """Texts of one fingerprint (words of up to three bytes count nothing beside longer ones) in several groups, edits of
    edits, and texts between 0.5 and 0.8, against all pairs."""
    r = random.Random(3)
    head = "measured values follow below"
    rows = []
    for _ in range(6):
        text = [f"{r.randrange(100)}" for _ in range(200)]
        for _ in range(6):
            rows.append((len(rows), f"{head} {' '.join(text)}"))
            for _ in range(r.randrange(1, 7)):
                text[r.randrange(200)] = f"{r.randrange(100)}"
    texts = [t for _, t in rows]
    assert len(set(simhash.fingerprint_texts([t.encode() for t in texts], 5, "words").tolist())) == 1
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if five_word_jaccard(texts[i], texts[j]) >= 0.8]
    comp = roots(len(rows), edges)
    low = {}
    for (i, _), c in zip(rows, comp, strict=True):
        low[c] = min(i, low.get(c, i))
    got = {x.id: x.component_id for x in simhash.similar_groups(docs_of(spark, rows)).collect()}
    assert len(edges) > 20 and got == {i: low[c] for (i, _), c in zip(rows, comp, strict=True)}


@pytest.mark.parametrize("chunk", [1, 3, 256])
def test_unmet_pairs(spark, monkeypatch, chunk):
    """All similar pairs of a key's texts with different roots are found, whatever the chunks, and no other."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    r = random.Random(chunk)
    sets = {t: {*range(t % 4 * 3, t % 4 * 3 + 9), *([100 + t] if t % 3 else [])} for t in range(30)} | {30: set(), 31: set()}
    root = {t: 0 if t % 4 == 0 and t < 20 else t for t in sets}
    bands = {t: [r.randrange(2) * 7 + j * 100 for j in range(4)] for t in sets}
    several = [(b, t) for t in sets for b in bands[t]]
    want = set()
    for x in sets:
        for y in sets:
            u = len(sets[x] | sets[y])
            if x < y and root[x] != root[y] and set(bands[x]) & set(bands[y]) and len(sets[x] & sets[y]) >= 0.8 * u:
                want.add((x, y))
    shared = spark.createDataFrame([(b, t, 0) for b, t in several], "band long, th long, rep long")
    roots_ = spark.createDataFrame([(t, 0) for t in sets if root[t] == 0], "node long, root long")
    prints = spark.createDataFrame([(t, bands[t]) for t in sets], "th long, bands array<long>")
    packed = spark.createDataFrame([(t, bytearray(np.array(sorted(v), np.uint32).tobytes())) for t, v in sets.items()], "th long, s binary")
    got = [tuple(sorted((x.a, x.b))) for x in simhash._unmet(shared, roots_, prints, packed, 0.8).collect()]
    assert len(want) > 20 and len(got) == len(set(got)) and set(got) == want


def test_two_hashes_tell_texts(spark):
    """Texts that share the first hash and differ in the second are different texts."""
    prints = spark.createDataFrame([(1, 5, 8), (2, 5, 8), (3, 5, 9), (4, 6, 1)], "id long, h long, h2 long")
    th = {r.id: r.th for r in simhash._numbered(prints).collect()}
    assert th[1] == th[2] == 5 and th[3] not in (5, 6) and th[4] == 6


def test_drop_similar_repeated_id(spark):
    """An id with two texts goes only with the text whose group has a smaller id."""
    x, y = (" ".join(f"{c}{i}" for i in range(40)) for c in ("left", "right"))
    kept = simhash.drop_similar(docs_of(spark, [(5, x), (9, x), (5, y), (2, y)])).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(2, y), (5, x)]


def test_line_dedup(spark):
    rows = [(1, "Shared line here\nown one of 1"), (2, "  SHARED line HERE \r\nshort\nshort"), (3, "Shared line here"), (3, "Shared line here"), (4, None), (5, ""), (6, "short\nÉcole des lignes"), (7, "école des lignes"), (None, "Shared line here\nnull own line")]
    got = sorted((str(r.doc_id), r.kept_text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect())
    assert got == sorted([("1", "Shared line here\nown one of 1", 2, 0), ("2", "short\nshort", 3, 1), ("3", "", 1, 1), ("3", "", 1, 1), ("4", "", 1, 0), ("5", "", 1, 0), ("6", "short\nÉcole des lignes", 2, 0), ("7", "école des lignes", 1, 0), ("None", "null own line", 2, 1)])
    named = spark.createDataFrame([("b", "a shared line\nx"), ("a", "a shared line"), (None, "A shared LINE ")], "doc_id string, text string")
    assert sorted((str(r.doc_id), r.kept_text) for r in line_dedup.dedup_lines(named).collect()) == [("None", ""), ("a", "a shared line"), ("b", "x")]
    three = line_dedup.dedup_lines(docs_of(spark, rows), min_docs=5)
    assert three.agg({"n_dropped": "sum"}).first()[0] == 0
    assert line_dedup.dedup_lines(docs_of(spark, [])).count() == 0


def test_sharding(spark):
    rows = [(i % 500, prose(RNG.randint(0, 30))) for i in range(1500)] + [(9, "same text")] * 700 + [(None, None)]
    got = sharding.shard_rows(docs_of(spark, rows)).collect()
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    for s in range(24):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    sizes = [sum(r["size"] for r in got if r.shard == s) for s in range(24)]
    assert max(sizes) <= 1.02 * sum(sizes) / 24
    loads = [(i, 10 + i % 7, 1) for i in range(400)]
    old = sharding.first_map(loads, 8)
    new = sharding.rebalanced_map(old, loads, 9)
    moved = sum(a[3] for a, b in zip(old, new, strict=True) if a[2] != b[2])
    assert new[0][0] == 2 and moved <= 1.05 * sum(r[3] for r in new) / 9 and {r[2] for r in new} == set(range(9))
    assert sharding.shard_rows(docs_of(spark, [])).count() == 0


def test_sharding_with_a_stored_map(spark, tmp_path):
    """The second run edits the first one's map: most rows stay, shards stay even, versions are kept side by side."""
    folder = f"file://{tmp_path}/map"
    rows = [(i, "w" * (i % 90)) for i in range(3000)] + [(5000, "long " * 4000)]
    first = {r.doc_id: r for r in sharding.shard_rows(docs_of(spark, rows), shards=6, map_folder=folder).collect()}
    more = rows + [(6000 + i, "new words " * 9) for i in range(600)]
    second = {r.doc_id: r for r in sharding.shard_rows(docs_of(spark, more), shards=7, map_folder=folder).collect()}
    assert {r.map_version for r in first.values()} == {1} and {r.map_version for r in second.values()} == {2}
    moved = sum(first[i].shard != second[i].shard for i in first)
    assert moved < 0.35 * len(first)
    sizes = [sum(r["size"] for r in second.values() if r.shard == s) for s in range(7)]
    assert max(sizes) <= 1.1 * sum(sizes) / 7
    assert [r[0] for r in sharding.stored_map(spark, folder)][:1] == [2]


def weighted(a, b):
    return sum(min(a.count(x), b.count(x)) for x in set(a)) / len(b)


def test_decontamination(spark):
    items = [(1, prose(20)), (2, " ".join(f"q{i}" for i in range(25))), (3, "too short item"), (4, None), (None, prose(9)), (5, " ".join(f"r{i}" for i in range(30)))]
    edited = [f"q{i}" for i in range(25)]
    edited[24] = "other"
    rows = [*ROWS, (50, "before it " + items[0][1].upper() + ", after"), (51, "lead " + " ".join(edited) + " tail words"), (52, " ".join(f"r{i}" for i in range(14)) + " then something else"), (53, "!".join(f"r{i}" for i in range(30)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs_of(spark, rows), bench).collect()}
    assert set(got) == {i for i, _ in rows if i is not None}

    def shingles(t):
        w = [x for x in re.split(r"[^\w]+|_", (t or "").lower()) if x]
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    for i, t in rows:
        if i is None or i == 6:
            continue
        want = set()
        for k, item in items:
            b, d = shingles(item), shingles(t)
            if k is not None and b and any(weighted(d[s : s + len(b)], b) >= 0.8 for s in range(max(1, len(d) - len(b) + 1))):
                want.add(k)
        assert set(got[i].item_ids) == want, i
    assert got[50].item_ids == [1] and got[51].item_ids == [2] and not got[52].contaminated and got[53].item_ids == [5]
    left = {r.doc_id for r in decontaminate.clean(docs_of(spark, rows), bench).collect()}
    assert None in left and not left & {50, 51, 53} and 52 in left
    empty = spark.createDataFrame([], "item_id long, text string")
    assert not decontaminate.contamination(docs_of(spark), empty).where("contaminated").count()


def best_window(text, item):
    """Highest weighted similarity of all item-sized windows of the text."""
    b, d = ([tuple(w[i : i + 5]) for i in range(len(w) - 4)] for w in (item.split(), text.split()))
    return max((weighted(d[s : s + len(b)], b) for s in range(max(1, len(d) - len(b) + 1))), default=0)


def test_decontamination_of_edited_copies(spark):
    """Moved, swapped, inserted, deleted and replaced words against all windows; recall by brute force over both sides of 0.8."""
    r = random.Random(8)
    items = [(i, " ".join(f"v{r.randrange(400)}" for _ in range(r.choice([14, 20, 33, 50])))) for i in range(30)] + [(98, items_repeat := "tick tock " * 12), (99, "short one")]
    rows = []
    for i, text in items[:30]:
        w = text.split()
        half = len(w) // 2
        at = r.randrange(1, len(w) - 2)
        edits = [w[half:] + w[:half], [*w[:at], "new", *w[at:]], [*w[:at], "new", "words", *w[at:]], w[:at] + w[at + 1 :], [*w[:at], "other", *w[at + 1 :]], [*w[1:at], w[0], *w[at:]], w[: int(len(w) * 0.85)], w[: int(len(w) * 0.7)]]
        for e in edits:
            rows.append((len(rows), " ".join([f"p{r.randrange(99)}" for _ in range(r.randrange(60))] + e + [f"s{r.randrange(99)}" for _ in range(r.randrange(60))])))
    rows += [(900, "lead " + items_repeat + "trail"), (901, "a short one, indeed"), (902, "short and one"), (None, items[0][1]), (903, items[0][1]), (903, "another text"), (904, None), (905, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, rows)
    got = {x.doc_id: x for x in decontaminate.contamination(docs, bench).collect()}
    want = {(d, k) for d, t in rows[:-8] for k, item in items[:30] if best_window(t, item) >= 0.8 - 1e-9}
    found = {(d, k) for d, t in rows[:-8] for k in got[d].item_ids}
    assert len(want) > 120 and found <= want and len(found) >= 0.99 * len(want)
    swapped = [d for d, t in rows[:240] if d % 8 == 0 and len(items[d // 8][1].split()) == 50]
    assert swapped and all(got[d].item_ids == [d // 8] and got[d].similarity > 0.9 for d in swapped)
    assert got[900].item_ids == [98] and got[901].item_ids == [99] and not got[902].contaminated
    left = sorted((str(x.doc_id), x.text) for x in decontaminate.clean(docs, bench).where("doc_id > 890 or doc_id is null").collect())
    assert left == [("902", "short and one"), ("903", "another text"), ("904", None), ("905", "")]


def test_near_contents_are_whole(spark):
    """All pairs of one length within the radius, and no others."""
    r = np.random.default_rng(4)
    seeds = r.integers(0, 1 << 63, 12, dtype=np.uint64).tolist()
    near = [x ^ sum(1 << b for b in r.choice(63, d, replace=False).tolist()) for x in seeds for d in range(15, 30)]
    windows = spark.createDataFrame([(5, i % 2, i, 0, x) for i, x in enumerate(near)], "k int, n int, c1 long, c2 long, fp long")
    items = spark.createDataFrame([(i, 5, i % 2, x) for i, x in enumerate(seeds)], "item long, k int, n int, ifp long")
    got = [(x.c1, x.item) for x in decontaminate.near_contents(windows, items).collect()]
    want = {(i, j) for i, x in enumerate(near) for j, y in enumerate(seeds) if i % 2 == j % 2 and (x ^ y).bit_count() <= decontaminate.RADIUS}
    assert len(got) == len(want) and set(got) == want
    with pytest.raises(ValueError):
        decontaminate.near_contents(windows, items, 24)


def test_vector_search(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(1200, 8)).astype(np.float32)
    x[100:500] = x[100]  # one very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist()), (5000, None), (5100, [0.0] * 8), (5200, [float("nan")] * 8), (5300, [1.0, 2.0]), (None, x[0].tolist()), (5400, [None] + [1.0] * 7)]
    got = hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shard_rows=400).collect()
    by = {}
    for g in got:
        by.setdefault(g.query_id, []).append((g.rank, g.vec_id, g.score))
    assert set(by) == set(range(0, 1200, 100))
    hits = 0
    for q, found in by.items():
        found.sort()
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(1200), d)).tolist() if i != q][:10]
        assert [k for k, _, _ in found] == list(range(1, 11))
        assert all(abs(s - d[i]) < 1e-12 for _, i, s in found)
        assert [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        hits += len(set(order) & {i for _, i, _ in found})
    assert hits >= 0.9 * 10 * len(by)
    assert hnsw.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vector_search_in_doubles(spark):
    """Differences below single precision are kept; clashing columns are not read; an id with two vectors answers once."""
    rows = [(0, [1e8, 1.0]), (1, [1e8, 1.5]), (2, [1e8 + 1, 1.0]), (3, [-5.0, 3.0]), (3, [1e8, 1.25]), (4, [1e300, 1.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS dim", "2 AS shard", "3 AS slice", "4 AS score")
    got = hnsw.nearest(docs).orderBy("rank").collect()
    assert [(g.query_id, g.vec_id, g.score) for g in got][:3] == [(0, 3, 0.25), (0, 1, 0.5), (0, 2, 1.0)] and len(got) == 4


def test_vector_recall(spark):
    """All queries of one shard and of several against brute force."""
    r = np.random.default_rng(6)
    x = np.concatenate((r.normal(size=(3000, 24)), r.normal(size=(40, 24))[r.integers(0, 40, 2000)] + 0.05 * r.normal(size=(2000, 24))))
    d = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    for size in (16_384, 1000):
        got = hnsw.nearest(d, every=20, shard_rows=size).collect()
        by = {}
        for g in got:
            by.setdefault(g.query_id, set()).add(g.vec_id)
        hits = sum(len(by[q] & set(np.argsort(((x - x[q]) ** 2).sum(1))[1:11].tolist())) for q in range(0, 5000, 20))
        assert len(got) == 2500 and hits >= 0.9 * 2500


PAGE = """<html><head><title>T</title><script>if(a<b){x="</p>"}</script></head><body><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies a lot on this page and tell you so at length.</div>
<article><h1>Head &amp; line</h1><p>First <b>bold</b>  text<br>goes on.<p>Second &eacute; one</article><section id="comments"><p>A long reader comment that should not be kept in any case at all.</p></section><footer>&copy; x</footer></body>"""


def test_html(spark):
    assert html_extract.main_text(PAGE) == "Head & line\n\nFirst bold text goes on.\n\nSecond é one"
    plain = "<body><div><a href=x>Menu</a></div><div>" + "A long running text of the page without an article element. " * 3 + "</div><div class=footer>foot</div></body>"
    assert html_extract.main_text(plain) == ("A long running text of the page without an article element. " * 3).strip()
    assert html_extract.main_text("<article><p>cut of") == "cut of" and html_extract.main_text('<article><p>done</p><p class="x') == "done"
    assert html_extract.main_text(None) == "" and html_extract.main_text("<nav>only</nav>") == ""
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' AS text")).collect()
    assert sorted((str(r.page_id), len(r.text), r.n_chars) for r in got) == sorted([("1", 51, 51), ("1", 51, 51), ("2", 0, 0), ("None", 0, 0)]) or all(len(r.text) == r.n_chars for r in got)


def test_html_markup():
    main = html_extract.main_text
    assert main("<article><p data-x=it's>Hello there</p><p>and here</article>") == "Hello there\n\nand here"
    assert main("<article><p title='a > b' x=\"1\" / y = z>one</p></article>") == "one"
    assert main("<article><p>zero\u200bwidth \ufeff mark&nbsp; and\u2003blank</p></article>") == "zero\u200bwidth \ufeff mark and blank"
    assert main("<p>Short text only</p>") == "Short text only"
    long = "<article>" + "<p>Some words of a long page.</p>" * 40_000 + "</article>"
    assert main(long).count("Some words") == 40_000


def test_html_window_step():
    """Text dives where three lines in a row hold links only, with and without an article element; doubtful names weigh but do not decide."""
    main = html_extract.main_text
    links = "".join(f"<li><a href=/{i}>More of the same kind {i}</a></li>" for i in range(4))
    for head, foot in (("<article>", "</article>"), ("<div>", "</div>")):
        body = "<p>" + "The first part runs on for a while here. " * 3 + f"</p><p><a href=/x>One linked line</a></p><p>Sh is.</p><p>{'It goes on. ' * 9}</p>"
        got = main(f"<body>{head}{body}<ul>{links}</ul>{foot}</body>").split("\n\n")
        assert got[1:3] == ["One linked line", "Sh is."] and len(got) == 4 and "More of the same" not in " ".join(got)
    cards = "<article><h2><a href=/1>Title of a card</a></h2></article>" * 5
    assert main(f"<body>{cards}<article><h1>Story</h1><p>Told at length.</p></article></body>") == "Story\n\nTold at length."
    prose = "A paragraph about how people share things with one another, and what that does to the things and to the people."
    assert main(f'<article><p>Lead.</p><p class="share">{prose}</p><p class="share">Share this</p><p class=comment>{prose}</p></article>') == f"Lead.\n\n{prose}"
    assert main(f'<body><div class="notice">{prose}</div><p>{prose}</p></body>') == prose


def test_html_linked_ends_class_words_and_formulas():
    main = html_extract.main_text
    text = "Some text of the article that goes on for long enough. " * 2
    text = text.strip()
    linked = main(f"<article><h1><a href=/x>Linked headline of it</a></h1><p>{text}</p><p><a href=/y>The last paragraph is one link.</a></p></article>")
    assert linked == f"Linked headline of it\n\n{text}\n\nThe last paragraph is one link."
    colonel = "On his promotion to colonel he was given a regiment in the south, and he took the banner with him wherever he went after that day."
    for name in ("promotion", "banner", "overlay", "replies", "skip", "subscription"):
        assert main(f"<article><p>{text}</p><p class='{name}'>{colonel}</p></article>") == f"{text}\n\n{colonel}"
        assert main(f"<article><p>{text}</p><div class='{name}'>{colonel}</div></article>") == text
    assert main(f"<article><p>{text} <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p></article>") == f"{text} x=2"
    assert main(f"<body><main><p>{text}</p></main><div>{colonel}</div><div class=sidebar>{colonel}</div></body>") == f"{text}\n\n{colonel}"


def test_html_unclosed_elements_take_linear_time():
    import time

    def took(n):
        begin = time.perf_counter()
        assert html_extract.main_text("<article>" + "<div>word</p>" * n + "</article>").count("word") == n
        return time.perf_counter() - begin

    took(1000)
    assert took(32_000) < 8 * took(8_000) + 1


def plain_extraction(page):
    """The whole extraction by its definition: lines weigh plain^2 / size, ten times as much in articles; a line stays if it
    lies between two weighing lines of one run of windows with weight, or is a linked prose line of the same article beside a line that stays."""
    lines = html_extract.lines_of(page)
    w = [0.0 if x.out else max(0.0, x.plain**2 / len(x.text) - 100) if x.doubtful else x.plain**2 / len(x.text) * (10 if x.article else 1) for x in lines]
    n, size = len(w), html_extract.WINDOW
    sums = [sum(w[i : i + size]) for i in range(n)]
    least = min(html_extract.SURGE, max(sums, default=0))
    stay = []
    for x in range(n):
        i = j = x
        if sums[x] <= 0:
            stay.append(False)
            continue
        while i > 0 and sums[i - 1] > 0:
            i -= 1
        while j < n and sums[j] > 0:
            j += 1
        stay.append(max(sums[i:j]) >= least and any(w[i : x + 1]) and any(w[x:j]))
    while True:
        more = [k for k in range(n) if not stay[k] and lines[k].prose and not lines[k].out and not lines[k].doubtful and lines[k].plain == 0 and any(0 <= m < n and stay[m] and lines[m].home == lines[k].home for m in (k - 1, k + 1))]
        if not more:
            break
        for k in more:
            stay[k] = True
    return "\n\n".join(x.text for x, v, s in zip(lines, w, stay, strict=True) if s and not x.out and (v or not x.doubtful))


def test_html_equals_its_definition():
    """Made-up pages with and without articles, and how many of them the window step changes."""
    r = random.Random(8)
    block = lambda: r.choice(["p", "div", "li", "h2"])
    words = lambda n: " ".join(r.choice(VOCAB) for _ in range(n))
    changed = 0
    for _ in range(400):
        parts = []
        for _ in range(r.randrange(1, 14)):
            t, kind = block(), r.randrange(6)
            name = r.choice(["", " class=share", " class=promotion", " class=sidebar"])
            parts.append(f"<{t}{name}>{words(r.randrange(1, 30))}</{t}>" if kind < 3 else f"<{t}><a href=x>{words(3)}</a></{t}>" if kind < 5 else f"<{t}>{words(2)} <a href=x>{words(4)}</a></{t}>")
        body = "".join(parts)
        cut = r.randrange(len(parts) + 1)
        page = r.choice([f"<body>{body}</body>", f"<body><article>{body}</article></body>", f"<body>{''.join(parts[:cut])}<main>{''.join(parts[cut:])}</main></body>"])
        got = html_extract.main_text(page)
        assert got == plain_extraction(page), page
        changed += got != html_extract.main_text(page, window=1)
    assert changed > 40


def test_surges_by_definition():
    r = random.Random(2)
    for _ in range(400):
        w = [r.choice([0, 0, 0, 5, 30, 70]) for _ in range(r.randrange(0, 25))]
        n, size, surge = len(w), r.choice([1, 2, 3, 4]), r.choice([20, 60, 100])
        sums = [sum(w[i : i + size]) for i in range(n)]
        least = min(surge, max(sums, default=0))
        want = []
        for x in range(n):
            runs = [(i, j) for i in range(n) for j in range(i + 1, n + 1) if i <= x < j and all(sums[i:j]) and max(sums[i:j]) >= least]
            want.append(any(any(w[i : x + 1]) and any(w[x:j]) for i, j in runs))
        assert html_extract.surges(w, size, surge) == want, w


def test_quality(spark):
    good, junk, rude = "river hill stone walk light".split(), "$$ %% !! ##".split(), "blorgo blorga blorgu".split()
    rows, grades = [], []
    for i in range(600):
        kind = i % 3
        words = [RNG.choice(good) for _ in range(40)]
        if kind == 0:
            words = [w + " " + RNG.choice(junk) for w in words]
        if kind == 1:
            words[RNG.randrange(40)] = RNG.choice(rude)
        rows.append((i, " ".join(words)))
        grades.append((i, 0 if kind == 0 else 1, 1 if kind == 1 else 0))
    labels = spark.createDataFrame(grades[:400], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, [*rows, (None, "river"), (900, None), (901, "")])
    model = quality.learn(docs, quality.grades_of(labels))
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(got) == 603
    held = [(i, got[i].keep) for i in range(400, 600)]
    assert sum(k == (i % 3 == 2) for i, k in held) >= 0.97 * len(held)
    cuts = sorted(w for f, w in model.values.tolist() if f < 0)
    assert cuts == sorted(cuts) and all(0 <= r.p_top <= 1 and 0 <= r.expected_grade <= 2 for r in got.values())
    assert quality.learn(docs, quality.grades_of(labels.limit(0))) is None
    assert quality.learn(docs, quality.grades_of(labels.selectExpr("doc_id + 100000 AS doc_id", "quality", "toxic"))) is None
    assert quality.learn(docs.limit(0), quality.grades_of(labels)) is None
    wide = quality.score(docs.limit(3).selectExpr("*", "'x' AS p_top", "2 AS expected_grade"), model, extra=True)
    assert wide.count() == 3 and dict(wide.dtypes)["p_top"] == "double" and "text" in wide.columns
    assert quality.score(docs, None).where("keep").count() == 603


def test_language(spark):
    from pyspark.sql import functions as F

    words = {"en": "the of and with house water light running".split(), "de": "der und nicht häuser wasser straße gehen schön".split(), "ru": "и не дом вода свет улица идти хорошо".split()}
    rows = [(i, " ".join(RNG.choice(words[lang]) for _ in range(25)), lang) for i, lang in enumerate(["en", "de", "ru"] * 60)]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "123 !!", "en"), (902, "the house of light", None), (None, "der und nicht", "de")], "doc_id long, text string, lang string")
    model = langid.learn(docs.where(F.coalesce("doc_id", F.lit(0)) % 3 != 100), "doc_id", "text", "lang")
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0 and got[902].lang_pred == "en" and got[None].lang_pred == "de"
    marks = spark.createDataFrame([(1, "\u0301\u0302 \u0308"), (2, "e\u0301"), (2, "e\u0301"), (3, "the house " * 30_000)], "doc_id long, text string").selectExpr("*", "'u' AS lang_pred", "9 AS score")
    assert sorted((r.doc_id, r.lang_pred == "und", r.score) for r in langid.predict(marks, model).where("doc_id < 3").select("doc_id", "lang_pred", "score").collect())[0] == (1, True, 0.0)
    assert langid.predict(marks, model).where("doc_id = 3 and lang_pred = 'en'").count() == 1 and langid.predict(marks, model).where("doc_id = 2").count() == 2
    mixed = " ".join(words["en"] * 3) + " " + " ".join(words["ru"] * 3)
    assert [s[0] for s in langid.spans(mixed, model)] == ["en", "ru"]
    scores = np.random.default_rng(1).normal(size=(60, 3)) * 3
    off = np.array([0, 0, 20, 21, 60])
    got = langid.viterbi(scores, off, 2.0)
    for a, b in zip(off[:-1], off[1:], strict=True):
        value = sum(scores[i, got[i]] for i in range(a, b)) - 2.0 * sum(got[i] != got[i - 1] for i in range(a + 1, b))
        best = scores[a] if b > a else np.zeros(1)
        for i in range(a + 1, b):
            best = scores[i] + np.maximum(best, best.max() - 2.0)
        assert abs(value - (best.max() if b > a else 0)) < 1e-9
    none = langid.learn(docs.limit(0), "doc_id", "text", "lang")
    assert langid.predict(docs, none).where("lang_pred = 'und'").count() == docs.count()
