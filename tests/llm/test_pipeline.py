"""Every stage of the pipeline, and all in a row, against brute force on small tables with nulls, repeats, copies, edits and clashing columns."""

import hashlib
import random
import re

import corpus_pipeline
import numpy as np
import pytest

from cuelane.llm import quality

R = random.Random()
WORDS = [f"{a}{b}" for a in ("river", "stone", "light", "walk", "house", "green", "table", "cloud") for b in ("s", "ed", "ing", "", "er")]
ITEM = " ".join(f"bench{i}" for i in range(24))


def prose(n):
    return " ".join(R.choice(WORDS) + str(R.randrange(40)) for _ in range(n))


def documents():
    R.seed(21)
    rows = [[i, prose(R.randrange(60 if i < 12 else 20, 90))] for i in range(60)]
    for i in range(0, 12):  # exact copies, edits, edits of edits
        w = rows[i][1].split()
        rows.append([100 + i, rows[i][1]])
        w[len(w) // 2] = "edited"
        rows.append([200 + i, " ".join(w)])
        w[len(w) // 3] = "twice"
        rows.append([300 + i, " ".join(w)])
    rows += [[400 + i, f"A passage that many documents share, word for word.\n{prose(30)}"] for i in range(8)]
    rows += [[500 + i, f"{prose(12)} {ITEM if i % 2 else ' '.join(ITEM.split()[12:] + ITEM.split()[:12])} {prose(12)}"] for i in range(6)]
    rows += [[600 + i, " ".join(w + " $$$" for w in prose(30).split())] for i in range(30)] + [[700 + i, prose(30) + " blorgo"] for i in range(30)]
    rows += [[800, None], [801, ""], [802, " "], [803, "one word " * 5000], [5, "a second text under one id " + prose(20)], rows[3], [None, prose(25)], [None, rows[7][1]]]
    return [(i, t, "en", "s", None if t is None else len(t), 7, "k", 0.5) for i, t in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, keep string, p_top double"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('tables')}"
    docs = documents()
    labels = [(i, int(not 600 <= i < 700), int(700 <= i < 800)) for i, *_ in docs if i is not None and i % 3]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(sorted(set(labels)), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def stage(spark, tables, name, rows):
    out = dict(corpus_pipeline.STAGES)[name](spark, spark.createDataFrame(rows, SCHEMA), tables)
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def good_rows(spark, tables, rows):
    """The model's cumulative link worked out text by text."""
    from xxhash import xxh64_intdigest as h

    model = quality.learn(spark.createDataFrame(rows, SCHEMA), quality.grades_of(spark.read.parquet(f"{tables}/labels.parquet")))
    weight = dict(zip(model["feature"].tolist(), model["weight"].tolist(), strict=True))
    top = max(w for f, w in weight.items() if f < 0)
    kept = []
    for row in rows:
        tokens = re.sub(r"((?:[^\w\s]|_)+)", r" \1 ", (row[1] or "").lower()).split()
        kinds = set(tokens)
        features = [h(t, 5) >> 1 | 1 << 40 for t in kinds]
        features += [h(t[:4], 6) >> 1 | 1 << 40 for t in kinds if len(t) > 4 and t[0].isalpha()] + [h(t[:5], 7) >> 1 | 1 << 40 for t in kinds if len(t) > 5 and t[0].isalpha()]
        features.append(1 + min(quality.SHARES - 1, int(quality.SHARES * len(kinds) / max(len(tokens), 1) ** 0.9)))
        total = sum(weight.get(f, 0) for f in features)
        if 1 / (1 + np.exp(-(-quality.DAMP * np.log1p(-total) - top))) >= 0.5:
            kept.append(row)
    return kept


def without_lines(rows):
    """Keys of 10 code points and more stay in the smallest id only."""
    last = 1 << 62
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(last if i is None else i)
    out = []
    for i, t, *rest in rows:
        own = last if i is None else i
        text = "\n".join(x for x in (t or "").split("\n") if len(key(x)) < 10 or min(holders[key(x)]) == own)
        out.append((i, t if t is None else text, rest[0], rest[1], None if t is None else len(text), *rest[3:]))
    return out


def runs(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def one_of_each_group(rows):
    """All pairs of texts by the Jaccard similarity of their runs of five words, chained."""
    texts = sorted({t or "" for _, t, *_ in rows})
    sets = [runs(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= 0.8 * len(a | sets[j]):  # texts without words are alike
                parent[find(i)] = find(j)
    group = {t: find(i) for i, t in enumerate(texts)}
    low = {}
    for i, t, *_ in rows:
        if i is not None:
            low[group[t or ""]] = min(i, low.get(group[t or ""], i))
    return [r for r in rows if r[0] is None or r[0] == low[group[r[1] or ""]]]


def uncontaminated(rows):
    def shingles(t):
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    item = shingles(ITEM)

    def best(t):
        d = shingles(t)
        return max((sum(min(d[s : s + len(item)].count(x), item.count(x)) for x in set(item)) / len(item) for s in range(max(1, len(d) - len(item) + 1))), default=0)

    return [r for r in rows if best(r[1]) < 0.8]


def encoded(rows):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = []
    for i, t, *_ in rows:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    return out


def by_repr(rows):
    return sorted(map(tuple, rows), key=repr)


def test_stages_one_by_one(spark, tables):
    rows = documents()
    for name, brute in [("quality_classifier", lambda r: good_rows(spark, tables, r)), ("line_dedup", without_lines), ("simhash_near_dedup", one_of_each_group), ("benchmark_decontamination", uncontaminated), ("sentencepiece", encoded)]:
        out = stage(spark, tables, name, rows)
        if name != "sentencepiece":
            assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in spark.createDataFrame([], SCHEMA).schema], name
        want = by_repr(brute(rows))
        assert rows_of(out) == want, name
        if name != "sentencepiece":
            rows = want
    left = {i for i, *_ in rows}
    assert not left & set(range(500, 506)) and not left & set(range(600, 630)) and len(left & set(range(700, 730))) <= 3
    assert set(range(12, 60)) <= left and set(range(12)) <= left and not left & set(range(200, 212))


def test_run(spark, tables):
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    want = encoded(uncontaminated(one_of_each_group(without_lines(good_rows(spark, tables, rows)))))
    assert rows_of(corpus_pipeline.run(spark, tables)) == by_repr(want)


def test_stages_on_empty_tables(spark, tmp_path):
    folder = f"file://{tmp_path}"
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    rows = documents()
    for name, run in corpus_pipeline.STAGES:
        assert run(spark, spark.createDataFrame([], SCHEMA), folder).count() == 0, name
    for name in ("quality_classifier", "benchmark_decontamination"):  # no labels, no items: all stay
        assert rows_of(dict(corpus_pipeline.STAGES)[name](spark, spark.createDataFrame(rows, SCHEMA), folder)) == by_repr(rows)
