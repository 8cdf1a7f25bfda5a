"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade > j) = sigmoid(score - threshold_j): one score from hashed-text weights shared by all grades, thresholds in
order. Features are the different words of a text, their beginnings (inflected forms share them), its symbol runs, and
how often its words repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelane.llm.common import byte_slices, list_offsets, ship, texts_of

#: The most labelled documents learned from, in how many of them a feature must be, passes over them, L1 strength, step size.
FIT_DOCS, LEAST_DOCS, PASSES, LASSO, RATE = 10_000, 4, 40, 1e-3, 1.0
#: How fast further evidence against a text counts for less.
DAMP = 3.0
MODEL_SCHEMA = "feature long, weight double"
#: Features 1 to SHARES stand for the share of different words, 0 for none, tokens hash above.
SHARES = 20


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes [entries, 3] of each different token and its first four and five letters, 0 for none; entry of each token; offsets). Words are lower-cased, symbol runs stand apart."""
    from xxhash import xxh64_intdigest as h

    spaced = pc.replace_substring_regex(pc.utf8_lower(texts), r"([^\pL\pM\pN\s]+)", r" \1 ")
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(spaced))
    tokens = lists.flatten().dictionary_encode()
    hashes = np.zeros((len(tokens.dictionary), 3), np.int64)
    for i, x in enumerate(tokens.dictionary.to_pylist()):
        hashes[i, 0] = h(x, 5) >> 1 | 1 << 40
        if len(x) > 4 and x[0].isalpha():
            hashes[i, 1] = h(x[:4], 6) >> 1 | 1 << 40
            if len(x) > 5:
                hashes[i, 2] = h(x[:5], 7) >> 1 | 1 << 40
    return hashes, tokens.indices.to_numpy().astype(np.int64), list_offsets(lists)


def _distinct(use: np.ndarray, off: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, entry) of the different tokens of each document."""
    code = np.unique(np.repeat(np.arange(len(off) - 1), np.diff(off)) * max(entries, 1) + use)
    return code // max(entries, 1), code % max(entries, 1)


def _share(kinds: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Which of SHARES steps the share of different tokens falls into; long texts repeat more, so counts go by their roots."""
    return 1 + np.minimum(SHARES - 1, (SHARES * kinds / np.maximum(tokens, 1) ** 0.9).astype(np.int64))


def damped(found: np.ndarray) -> np.ndarray:
    """Score from summed evidence: each further piece of evidence against a text says less, so that ten bad words do not push it out of the grade that one puts it in."""
    return -DAMP * np.log1p(-found)


def fit(grades: np.ndarray, cells: list[np.ndarray], levels: int, least: int = LEAST_DOCS, passes: int = PASSES, lasso: float = LASSO, rate: float = RATE) -> pd.DataFrame:
    """Weights and thresholds from the features of each rated text: mini-batches, per-weight step sizes, soft thresholding; no weight is positive. Thresholds come as features -1, -2, ..."""
    flat = np.concatenate(cells)
    flat.sort()
    first = np.flatnonzero(np.concatenate((flat[:1] == flat[:1], flat[1:] != flat[:-1])))
    names = flat[first[np.diff(np.append(first, len(flat))) >= least]]
    del flat, first
    n, m = len(grades), len(names)
    known = []
    for x in cells:  # features that are frequent enough, by number
        at = np.minimum(np.searchsorted(names, x), max(m - 1, 0))
        known.append(at[names[at] == x].astype(np.int32) if m else np.zeros(0, np.int32))
    start = np.concatenate(([0], np.cumsum([len(x) for x in known])))
    use = np.concatenate(known)
    above = np.array([(grades > j).mean() for j in range(levels - 1)]).clip(1e-3, 1 - 1e-3)
    cuts = -np.log(above / (1 - above))
    w, seen = np.zeros(m), np.full(m, 1e-8)
    rng = np.random.default_rng(1)
    for p in range(passes):
        for lo in range(0, n, 128):
            if lo == 0:
                mix = rng.permutation(n)
            part = mix[lo : lo + 128]
            lens = start[part + 1] - start[part]
            at = np.repeat(start[part] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
            f, own = use[at], np.repeat(np.arange(len(part)), lens)
            found = np.bincount(own, weights=w[f], minlength=len(part))
            score = damped(found)
            high = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -30, 30)))  # P(grade > j)
            g = grades[part]
            # log-likelihood of the cumulative link: P(g) = P(> g-1) - P(> g)
            pad = np.concatenate((np.ones((len(part), 1)), high, np.zeros((len(part), 1))), axis=1)
            slope = pad * (1 - pad)
            r = np.arange(len(part))
            prob = np.maximum(pad[r, g] - pad[r, g + 1], 1e-9)
            up = (slope[r, g] - slope[r, g + 1]) / prob
            up *= DAMP / (1 - found)  # the slope of damped
            grad = -np.bincount(f, weights=up[own], minlength=m) / len(part)
            hit = np.flatnonzero(grad)
            seen[hit] += grad[hit] ** 2
            step = rate / np.sqrt(seen[hit])
            w[hit] = np.minimum(w[hit] - step * grad[hit] + step * lasso, 0)  # weights speak against a text only: else long texts gather credit from common words
            for j in range(levels - 1):
                d = np.where(g == j, slope[:, j + 1], 0) / prob - np.where(g == j + 1, slope[:, j + 1], 0) / prob
                cuts[j] += rate * d.mean()
            cuts = np.maximum.accumulate(cuts + np.arange(levels - 1) * 1e-6)
    some = np.flatnonzero(np.abs(w) > 1e-4)
    return pd.DataFrame({"feature": np.concatenate((names[some], -1 - np.arange(levels - 1))), "weight": np.concatenate((w[some], cuts))})


def learn(docs: DataFrame, grades: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = FIT_DOCS) -> pd.DataFrame | None:
    """The model from documents joined to grades (id, grade int from 0), or None where no two grades are rated
    or no document is.

    At most about `most` rated documents are learned from, chosen by a hash of the id; their features are made where
    the texts are, and one task fits. What comes to the driver is the model: at most the features of that sample.
    """
    ship(docs.sparkSession)
    rated = grades.where("grade is not null").groupBy(F.col(id_col).alias("__id")).agg(F.min("grade").cast("int").alias("grade"))
    found = rated.agg(F.count("*").alias("n"), F.max("grade").alias("top"), F.min("grade").alias("low")).first()
    if not found.n or found.top == found.low:
        return None
    levels = found.top + 1
    share = min(1.0, most / found.n)
    sample = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).where(F.pmod(F.xxhash64("__id", F.lit(17)), F.lit(1_000_000)) < share * 1_000_000)
    sample = sample.join(rated, "__id").select("grade", "text")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            for lo, hi in byte_slices(texts, 2 << 20):
                hashes, use, off = _features(texts.slice(lo, hi - lo))
                doc, entry = _distinct(use, off, len(hashes))
                kinds = np.bincount(doc, minlength=hi - lo)
                cells = [np.sort(np.append(hashes[e][hashes[e] > 0], s)).tobytes() for e, s in zip(np.split(entry, np.cumsum(kinds)[:-1]), _share(kinds, np.diff(off)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([0] * (hi - lo), pa.int32()), batch.column(0).slice(lo, hi - lo), pa.array(cells, pa.binary())], names=["one", "grade", "features"])

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.iloc[np.lexsort((rows["features"].map(hash_bytes), rows["grade"]))]  # the same order whatever the partitions
        return fit(rows["grade"].to_numpy(np.int64), [np.frombuffer(x, np.int64) for x in rows["features"]], levels)

    model = sample.mapInArrow(tokens, "one int, grade int, features binary").groupBy("one").applyInPandas(train, MODEL_SCHEMA).toPandas()
    return model if (model["feature"] < 0).any() else None


def hash_bytes(x: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(x, 1) >> 1


def score(docs: DataFrame, model: pd.DataFrame | None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, extra: bool = False) -> DataFrame:
    """(id, expected_grade double, p_top double, keep boolean), with extra all columns of docs instead of the id.

    p_top is the chance of the highest grade, keep says whether it reaches `least`. A null text is empty. Without a
    model (None) every document is kept and both figures are null. Repeated rows stay, an empty table stays empty;
    columns of docs named like the results are replaced.
    """
    ship(docs.sparkSession)
    names = ["expected_grade", "p_top", "keep"]
    rows = docs.drop(*names) if extra else docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    if model is None:
        return (rows if extra else rows.drop("__text")).select("*", F.lit(None).cast("double").alias(names[0]), F.lit(None).cast("double").alias(names[1]), F.lit(True).alias(names[2]))
    rows = rows.withColumn("__text", F.col(text_col)) if extra else rows
    low = model["feature"].to_numpy() < 0
    cuts = np.sort(model["weight"].to_numpy()[low])
    order = np.argsort(model["feature"].to_numpy()[~low])
    known, weights = model["feature"].to_numpy()[~low][order], model["weight"].to_numpy()[~low][order]

    def weigh(features: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(features.shape)
        at = np.minimum(np.searchsorted(known, features), len(known) - 1)
        return np.where(known[at] == features, weights[at], 0)

    keep_cols = [c for c in rows.columns if c != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(batch.schema.get_field_index("__text")))
            for lo, hi in byte_slices(texts, 3 << 20):
                hashes, use, off = _features(texts.slice(lo, hi - lo))
                doc, entry = _distinct(use, off, len(hashes))
                total = np.bincount(doc, weights=weigh(hashes).sum(axis=1)[entry], minlength=hi - lo) + weigh(_share(np.bincount(doc, minlength=hi - lo), np.diff(off)))
                high = 1 / (1 + np.exp(-np.clip(damped(total)[:, None] - cuts, -50, 50)))
                cols = [batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo) for c in keep_cols]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(high.sum(axis=1)), pa.array(high[:, -1]), pa.array(high[:, -1] >= least)], names=[*keep_cols, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__text") + ", expected_grade double, p_top double, keep boolean"
    return rows.mapInArrow(run, schema)


def grades_of(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, grade): one point for good quality and one for text that is not toxic, so 2 is good and clean; null where quality is. A null toxic mark counts as clean."""
    return labels.select(id_col, (F.when(F.col("quality") > 0, 1).when(F.col("quality").isNotNull(), 0) + F.when(F.col("toxic") != 0, 0).otherwise(1)).alias("grade"))
