"""Cuts of long segments and comma breaks against literal models, one recording after another."""

import random
import time

import pytest

from cuelane.operators import segment

RNG = random.Random(11)
SCHEMA = "media_id string, seg_idx int, input_pos int, word string, start_ms long, end_ms long, score double, speaker string"


def some_words(n, nested):
    t, out = 0, []
    for _ in range(n):
        t += RNG.choice([0, 40, 300, 301, 900])
        d = RNG.randint(20, 900)
        out.append((RNG.choice(["a", "b.", "c,", "d!", "e", "f", "g"]), t, t + d + RNG.choice([0, 0, 0, 2500, 9000]) * nested))
        t += d // (3 if nested else 1)
    return out


def mark_cut(ws, cap, marks):
    best = None
    for i, (word, _, end) in enumerate(ws[:-1]):
        if word[-1] in marks and end - ws[0][1] <= cap:
            best = i + 1
    return best


def model(ws, cap, rule):
    """Pieces in order, with a stack in place of recursion."""
    todo, out = [ws], []
    while todo:
        part = todo.pop()
        total = part[-1][2] - part[0][1]
        if len(part) < 2 or total <= cap:
            out.append(part)
            continue
        if rule == "max_gap":
            inside = [i for i in range(1, len(part)) if part[i - 1][2] - part[0][1] <= cap] or [1]
            at = max(inside, key=lambda i: (part[i][1] - part[i - 1][2], i))
            groups = [part[:at], part[at:]]
        else:
            at = mark_cut(part, cap, ".!?") or mark_cut(part, cap, ",") or (len(part) // 2 if rule == "halving" else None)
            if at:
                groups = [part[:at], part[at:]]
            else:
                n = max(2, -(-total // cap))
                groups = [[w for w in part if min(n - 1, (w[1] - part[0][1]) * n // total) == g] for g in range(n)]
                groups = [g for g in groups if g]
                if len(groups) == 1:
                    groups = [part[: len(part) // 2], part[len(part) // 2 :]]
        todo += reversed(groups)
    return out


def cut(spark, recordings, rule, cap, local):
    rows = [(m, 0, i, *w, 0.5, "S") for m, ws in recordings.items() for i, w in enumerate(ws)]
    got = {}
    for r in segment.split_words(spark.createDataFrame(rows, SCHEMA), rule, cap, local).collect():
        got.setdefault(r.media_id, {}).setdefault(r.seg_idx, []).append((r.input_pos, r.word, r.start_ms, r.end_ms))
    return {m: [[w[1:] for w in sorted(parts[k])] for k in sorted(parts)] for m, parts in got.items()}


@pytest.mark.parametrize("local", [1, 100, 4096])
@pytest.mark.parametrize("nested", [False, True])
@pytest.mark.parametrize("rule", segment.RULES)
def test_split_words(spark, rule, nested, local):
    recordings = {f"m{i}": some_words(RNG.choice([1, 2, 5, 20, 60, 300]), nested) for i in range(60)}
    recordings["same"] = [("a", 0, 100 * i) for i in range(1, 80)]
    recordings["plain"] = [("a", 500 * i, 500 * i + 400) for i in range(900)]
    recordings["long words"] = [("a.", 90_000 * i, 90_000 * i + 80_000) for i in range(5)]
    got = cut(spark, recordings, rule, 3000, local)
    for m, ws in recordings.items():
        assert got[m] == model(ws, 3000, rule), m
    assert segment.split_words(spark.createDataFrame([], SCHEMA), rule).count() == 0


@pytest.mark.parametrize("rule", segment.RULES)
def test_hundred_thousand_words_without_a_pause(spark, rule):
    """No recursion, and about the same time per word."""

    def took(n):
        w = spark.range(n).selectExpr("'m' AS media_id", "0 AS seg_idx", "cast(id AS int) AS input_pos", "CASE WHEN id % 37 = 5 THEN 'b.' WHEN id % 11 = 3 THEN 'c,' ELSE 'a' END AS word", "id * 1000 AS start_ms", "id * 1000 + 1000 AS end_ms", "0.5D AS score", "'S' AS speaker")
        t = time.perf_counter()
        s = segment.segment_rows(segment.split_words(w, rule)).selectExpr("end_ms - start_ms AS d", "size(words) AS n").collect()
        assert sum(r.n for r in s) == n and max(r.d for r in s) <= 11500
        return time.perf_counter() - t

    took(2000)
    small, large = took(10_000), took(100_000)
    assert large < 10 * small + 5


def comma_model(ws, max_pause, max_ms):
    out, seg, first = [], 0, 0
    for i in range(len(ws)):
        if i:
            word, _, end = ws[i - 1]
            if ws[i][1] - end > max_pause or word[-1] in ".!?" or word[-1] == "," and end - ws[first][1] >= max_ms:
                seg, first = seg + 1, i
        out.append(seg)
    return out


@pytest.mark.parametrize("nested", [False, True])
def test_comma_breaks(spark, nested):
    recordings = {f"m{i}": [(w if w[-1] not in ".!" or RNG.random() < 0.1 else "h,", a, b) for w, a, b in some_words(RNG.choice([1, 2, 20, 200]), nested)] for i in range(50)}
    recordings["no pause"] = [("c," if i % 5 == 0 else "a", 200 * i, 200 * i + 200) for i in range(9000)]
    rows = [(m, 0, i, *w, 0.5, "S") for m, ws in recordings.items() for i, w in enumerate(ws)]
    got = {}
    for r in segment.punct_comma_segments(spark.createDataFrame(rows, SCHEMA).drop("seg_idx"), 500, 2000).collect():
        got.setdefault(r.media_id, []).append((r.input_pos, r.seg_idx))
    for m, ws in recordings.items():
        assert [s for _, s in sorted(got[m])] == comma_model(ws, 500, 2000), m
