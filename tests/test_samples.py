"""Work on samples in blocks, and marks of speakers, against literal scans."""

import random
import re

import numpy as np
import pytest

from cuelane.operators import signals, words


def _chunks(x, rate, longest, quiet, level=1e-3):
    """Scan by definition."""
    most, need, lo, out = int(longest * rate), int(quiet * rate), 0, []
    while lo < len(x):
        hi = min(len(x), lo + most)
        if hi < len(x):
            fit = [r for r in range(max(lo, hi - rate), hi - need + 1) if all(abs(v) <= level for v in x[r : r + need])]
            hi = fit[-1] + need // 2 if fit else hi
        if any(abs(v) >= 1e-4 for v in x[lo:hi]):
            out.append((lo, hi))
        lo = max(hi, lo + 1)
    return [(i, *c) for i, c in enumerate(out)]


def _sounds(seed):
    """Recordings of stretches of quiet, silence and sound, some on and over the edges of blocks."""
    r, out = random.Random(seed), {}
    for m in range(12):
        x = []
        for _ in range(r.randrange(1, 30)):
            x += [r.choice((0.0, 0.0, 5e-4, -1e-3, 0.5, -0.7))] * r.randrange(1, 40)
        out[f"m{m}"] = [v if r.random() < 0.97 else 0.3 for v in x]
    return out | {"silent": [0.0] * 200, "loud": [0.5] * 333, "one": [0.2], "flat": [5e-4] * 150}


def _rows(spark, sounds, name, kind, scale=1):
    return spark.createDataFrame([(m, i, int(v * scale) if kind == "int" else v) for m, x in sounds.items() for i, v in enumerate(x)], f"media_id string, pos int, {name} {kind}")


@pytest.mark.parametrize("block", [7, 64, 65_536])
def test_silence_chunks_is_the_scan(spark, block):
    for rate, longest, quiet in ((16, 1.5, 0.2), (20, 4.0, 0.5), (10, 0.6, 0.1)):
        sounds = _sounds(block + rate)
        got = {}
        for r in signals.silence_chunks(_rows(spark, sounds, "x", "double"), rate, longest, quiet, block=block).orderBy("media_id", "chunk").collect():
            got.setdefault(r.media_id, []).append((r.chunk, r.start, r.end))
        want = {m: c for m, x in sounds.items() if (c := _chunks(x, rate, longest, quiet))}
        assert got == want
    assert signals.silence_chunks(_rows(spark, {"a": [0.5]}, "x", "double").limit(0), 16).count() == 0
    odd = spark.createDataFrame([("a", 0, None), ("a", 1, 0.5), (None, 0, 0.5), ("b", None, 0.5)], "media_id string, pos int, x double")
    assert [tuple(r) for r in signals.silence_chunks(odd, 16).collect()] == [("a", 0, 0, 2)]


def test_silence_chunks_where_small_partitions_are_put_together(spark):
    """Recordings and their quiet runs are of different size, so that Spark joins partitions of the two differently."""
    pcm = spark.range(9000).selectExpr("concat('v', id div 3) AS media_id", "explode(sequence(0, 29)) AS i", "id").selectExpr("media_id", "CAST((id % 3) * 30 + i AS INT) AS pos", "CASE WHEN i % 10 < 5 THEN 0.0D ELSE 0.5D END AS x")
    conf = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = signals.silence_chunks(pcm, 16, 1.5).groupBy("start", "end").count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(tuple(r) for r in got) == [(a, b, 3000) for _, a, b in _chunks([0.0 if i % 10 < 5 else 0.5 for i in range(90)], 16, 1.5, 0.2)]


def test_long_silence_and_sound_are_cut_in_one_pass():
    n, rate = 4_000_000, 16
    assert len(list(signals.cuts_between([], n, rate, 480, 3))) == -(-n // 480)
    cuts = list(signals.cuts_between([(0, n)], n, rate, 480, 3))
    assert cuts[0] == (0, 478) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:], strict=False)) and cuts[-1][1] == n


@pytest.mark.parametrize("block", [5, 65_536])
def test_prepare_and_end_are_the_scan(spark, block):
    sounds = _sounds(3)
    pcm = _rows(spark, sounds, "sample", "int", 30000)
    got = {(r.media_id, r.pos): r.x for r in signals.signal_prepare(pcm, block).collect()}
    ends = {r.media_id: r.end for r in signals.nonsilent_end(pcm, 8, 3.0, block).collect()}
    for m, x in sounds.items():
        v = np.array([int(y * 30000) for y in x], float)
        c = v - v.mean()
        want = c / np.abs(c).max() if np.abs(c).max() > 0 else c * 0
        assert np.allclose([got[m, i] for i in range(len(v))], want)
        p, level = v * v, (v * v).mean() * 10 ** (-0.3)
        loud = [i for i in range(7, len(v)) if p[i - 7 : i + 1].mean() > level * (1 + 1e-12)]
        assert ends[m] == (loud[-1] + 1 if loud else len(v))
    odd = spark.createDataFrame([("a", 0, None), ("a", 1, 4), ("a", 2, 8), (None, 0, 5)], "media_id string, pos int, sample int")
    assert {r.pos: r.x for r in signals.signal_prepare(odd).collect()} == {0: None, 1: -1.0, 2: 1.0}
    assert signals.signal_prepare(pcm.limit(0)).count() == signals.nonsilent_end(pcm.limit(0)).count() == 0


def test_loop_is_the_modulo(spark):
    sounds = {"a": [1.0, 2.0, 3.0], "b": [4.0], "c": [5.0] * 20, "d": [6.0, 7.0]}
    bg = _rows(spark, sounds, "x", "double")
    lengths = spark.createDataFrame([("a", 10), ("b", 5000), ("c", 7), ("d", 0), ("d", None), ("e", 4)], "media_id string, n long")
    for block, turns in ((2, 3), (65_536, 1024)):
        got = {(r.media_id, r.pos): r.x for r in signals.loop_background(bg, lengths, 50, block, turns).collect()}
        assert got == {(m, i): sounds[m][i % len(sounds[m])] / 2 for m, n in (("a", 10), ("b", 5000), ("c", 7)) for i in range(n)}


def _stripped(tokens):
    """Token by token: a run that is open takes tokens until one holds '>'."""
    out, run = [], []
    for i, t in enumerate(tokens):
        x = "".join((t or "").split())
        if not run and x != "<" and not x.startswith("<spk"):
            out.append(i)
            continue
        run.append(i)
        if ">" in x:
            text = "".join("".join((tokens[j] or "").split()) for j in run)
            out += [] if re.fullmatch(r"<spk:\d+>", text.split(">")[0] + ">") else run
            run = []
    return out + run


def test_speaker_marks_are_the_scan(spark):
    r = random.Random(9)
    pieces = ["<", "<spk", "spk", ":", "1", "23", ">", "> hello", "<spk:4>", "<spk:5>tail", " <", "a", "<b>", None, "", "<spk:", "k:7>", "<s"]
    lists = {f"m{i}": [r.choice(pieces) for _ in range(r.randrange(1, 25))] for i in range(300)}
    lists |= {"x": ["<", "spk", ":1", ">", "hi", "<b>"], "y": ["<spk:", "1"], "z": ["<", "spk:", "1", ">on"], "long": ["<", *["word"] * 500, "<spk:1>"], "tail": ["<spk:1>" + "é" * 200, "b"]}
    df = spark.createDataFrame([(m, i, t, 1.5) for m, ts in lists.items() for i, t in enumerate(ts)], "media_id string, input_pos int, text string, __extra double")
    out = words.strip_speaker_tags(df)
    assert out.columns == df.columns
    got = {m: [] for m in lists}
    for row in out.collect():
        got[row.media_id].append(row.input_pos)
    assert {m: sorted(v) for m, v in got.items()} == {m: _stripped(t) for m, t in lists.items()}
    assert words.strip_speaker_tags(df.limit(0)).count() == 0
