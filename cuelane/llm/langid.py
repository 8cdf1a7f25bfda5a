"""Language identification: script ranges narrow the candidates, word scores from letter n-grams are labelled by
Viterbi with a switching penalty, so that texts of several languages fall into spans."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelane.llm.common import byte_slices, list_offsets, ship, texts_of

#: Hashed n-gram buckets per language, the most documents learned from per language, and the penalty of a switch (nats).
BUCKETS, LEARN_DOCS, SWITCH = 1 << 16, 1500, 12.0
#: The most evidence one word gives for or against a language (nats).
WORD_CAP = 12.0

#: First code point of script ranges and their names; what lies between is 'Other'.
SCRIPTS = [
    (0x0041, "Latin"), (0x0250, "Other"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "Other"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Other"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1380, "Other"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"), (0x32000, "Other"),
]
SCRIPT_NAMES = sorted({n for _, n in SCRIPTS})
_STARTS = [s for s, _ in SCRIPTS]


def script_of(point: int) -> str:
    at = bisect.bisect_right(_STARTS, point) - 1
    return SCRIPTS[at][1] if at >= 0 else "Other"


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of letters, lower-cased, as a dictionary array over all texts, and offsets of the texts."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL\pM]+", " ")
    lists = pc.split_pattern(pc.utf8_trim(spaced, " "), " ")
    return lists.flatten().dictionary_encode(), list_offsets(lists)


def _grams(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 2- to 4-letter runs of each word between its ends, flat, and their owners."""
    joined = "".join(f"\x02{w}\x03" for w in words)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    h, found, own = points.copy(), [], []
    for n in range(2, 5):
        if len(points) < n:
            break
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :]
        whole = owner[: len(h)] == owner[n - 1 :]
        mixed = (h[whole] ^ (h[whole] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        found.append(((mixed >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64))
        own.append(owner[: len(h)][whole])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(own)


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, buckets: int = BUCKETS, most: int = LEARN_DOCS) -> dict:
    """The model: languages, log-probabilities [buckets, languages] and which scripts each language uses.

    Learns from the rows given, at most about `most` per language, chosen by a hash of the text; whole texts count.
    What comes to the driver is bounded by buckets times languages.
    """
    ship(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r.lang: r.n for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "scores": np.zeros((buckets, 0), np.float32), "scripts": np.zeros((len(SCRIPT_NAMES), 0), bool)}
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, most / sizes[lang]))])
    sample = rows.where(F.pmod(F.xxhash64(text_col, F.lit(11)), F.lit(1_000_000)) < share[F.col(lang_col)] * 1_000_000)
    at = {lang: i for i, lang in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[int, np.ndarray] = {}
        scripts = np.zeros((len(langs), len(SCRIPT_NAMES)), np.int64)
        for batch in batches:
            own = np.array([at[x] for x in batch.column(0).to_pylist()], np.int64)
            texts = texts_of(batch.column(1))
            for lo, hi in byte_slices(texts, 4 << 20):
                words, off = _words(texts.slice(lo, hi - lo))
                uniq = words.dictionary.to_pylist()
                use = words.indices.to_numpy()
                per = np.zeros((len(langs), len(uniq)), np.int64)
                np.add.at(per, (np.repeat(own[lo:hi], np.diff(off)), use), 1)
                bucket, owner = _grams(uniq, buckets)
                for i in np.flatnonzero(per.any(axis=1)).tolist():
                    grams[i] = grams.get(i, 0) + np.bincount(bucket, weights=per[i][owner], minlength=buckets)
                kinds = np.array([SCRIPT_NAMES.index(script_of(ord(w[0]))) if w else 0 for w in uniq], np.int64)
                for i in range(len(langs)):
                    scripts[i] += np.bincount(kinds, weights=per[i] * np.array([bool(w) for w in uniq]), minlength=len(SCRIPT_NAMES)).astype(np.int64)
        for i, x in grams.items():
            b = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), i, np.int32)), pa.array(b.astype(np.int32)), pa.array(x[b].astype(np.int64))], names=["lang", "bucket", "n"])
            s = np.flatnonzero(scripts[i])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i, np.int32)), pa.array((-1 - s).astype(np.int32)), pa.array(scripts[i][s])], names=["lang", "bucket", "n"])

    got = sample.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    lang, bucket, n = (got.column(c).to_numpy() for c in ("lang", "bucket", "n"))
    counts = np.full((buckets, len(langs)), 0.5)
    real = bucket >= 0
    np.add.at(counts, (bucket[real], lang[real]), n[real])
    scripts = np.zeros((len(SCRIPT_NAMES), len(langs)))
    np.add.at(scripts, (-1 - bucket[~real], lang[~real]), n[~real])
    used = scripts >= 0.01 * np.maximum(scripts.sum(axis=0), 1)
    return {"langs": langs, "scores": np.log(counts / counts.sum(axis=0)).astype(np.float32), "scripts": used}


def _word_scores(words: list[str], model: dict) -> np.ndarray:
    """[words, languages]: evidence relative to the best language, 0 for it; languages whose scripts exclude the word get the cap. Words without letters, or of a script nobody uses, are neutral."""
    scores = model["scores"]
    out = np.zeros((len(words), scores.shape[1]))
    bucket, owner = _grams(words, len(scores))
    for j in range(scores.shape[1]):
        out[:, j] = np.bincount(owner, weights=scores[bucket, j], minlength=len(words))
    fits = model["scripts"][np.array([SCRIPT_NAMES.index(script_of(ord(w[0]))) if w else 0 for w in words], np.int64)] if words else np.zeros((0, scores.shape[1]), bool)
    some = fits.any(axis=1)
    out = np.where(fits | ~some[:, None], out, -np.inf)
    out = np.maximum(out - out.max(axis=1, initial=-np.inf, keepdims=True), -WORD_CAP)
    out[~some | np.array([not w for w in words], bool)] = 0
    return out


def viterbi(scores: np.ndarray, offsets: np.ndarray, switch: float) -> np.ndarray:
    """The best label of every word, texts side by side: step t treats the t-th word of all texts that have one."""
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = offsets[:-1][order], sizes[order]
    steps, k = int(sizes.max(initial=0)), scores.shape[1]
    live = np.searchsorted(-sizes, -np.arange(steps), side="left")  # texts longer than t
    best = np.zeros((len(sizes), k))
    back: list[np.ndarray] = []
    every = np.arange(k)
    for t in range(steps):
        n = live[t]
        v = best[:n]
        if t:
            top = v.argmax(axis=1)
            high = v[np.arange(n), top] - switch
            move = high[:, None] > v
            back.append(np.where(move, top[:, None], every).astype(np.int8 if k < 128 else np.int16))
            v = np.where(move, high[:, None], v)
        best[:n] = v + scores[starts[:n] + t]
    labels = np.zeros(len(scores), np.int64)
    state = np.zeros(len(sizes), np.int64)
    for t in range(steps - 1, -1, -1):
        n = live[t]
        ends = sizes[:n] == t + 1
        state[:n][ends] = best[:n][ends].argmax(axis=1)
        labels[starts[:n] + t] = state[:n]
        if t:
            state[:n] = back[t - 1][np.arange(n), state[:n]]
    return labels


def label_words(texts: pa.Array, model: dict, switch: float) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    words, off = _words(texts)
    scores = _word_scores(words.dictionary.to_pylist(), model)
    use = words.indices.to_numpy()
    return words, off, viterbi(scores[use], off, switch)


def spans(text: str, model: dict, switch: float = SWITCH) -> list[tuple[str, int, int]]:
    """(language, first word, words) of each span of one text, words being its runs of letters."""
    words, _, labels = label_words(pa.array([text or ""]), model, switch)
    if not model["langs"] or not words.dictionary.to_pylist() or words.dictionary.to_pylist() == [""]:
        return []
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(labels)) + 1, [len(labels)]))
    return [(model["langs"][labels[a]], int(a), int(b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """(id, lang_pred, score, n_spans): the language that most letters of the whole text are labelled with, and its
    share of the letters (0 to 1); ties go to the language first in order. A text that is null or has no letter, or
    a model without languages, gives 'und' and score 0. Repeated rows stay, an empty table gives an empty one; no
    other column is read."""
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    langs = np.array([*model["langs"], "und"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(langs) - 1
        for batch in batches:
            texts = texts_of(batch.column(1))
            for lo, hi in byte_slices(texts, 8 << 20):
                n = hi - lo
                pred, score, count = np.full(n, k), np.zeros(n), np.zeros(n, np.int64)
                if k:
                    words, off, labels = label_words(texts.slice(lo, n), model, switch)
                    letters = pc.utf8_length(words.dictionary).to_numpy(zero_copy_only=False)[words.indices.to_numpy()]
                    owner = np.repeat(np.arange(n), np.diff(off))
                    share = np.bincount(owner * k + labels, weights=letters, minlength=n * k).reshape(n, k)
                    total = share.sum(axis=1)
                    some = (total > 0) & pc.match_substring_regex(texts.slice(lo, n), r"\pL").to_numpy(zero_copy_only=False)
                    pred[some] = share[some].argmax(axis=1)
                    score[some] = share[some].max(axis=1) / total[some]
                    turn = np.concatenate(([True], (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1]))) if len(labels) else np.zeros(0, bool)
                    count = np.where(some, np.bincount(owner[turn], minlength=n), 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(langs[pred].tolist(), pa.string()), pa.array(score), pa.array(count)], names=["id", "lang_pred", "score", "n_spans"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, lang_pred string, score double, n_spans long").withColumnRenamed("id", id_col)
