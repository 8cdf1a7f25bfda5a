"""Rules that depend on earlier cuts, and edge cases, against literal models and invariants."""

import itertools
import random

import numpy as np
import pytest

from cuelane.functions import normalise as nm
from cuelane.operators import intervals, segment, signals, timeline, words

RNG = random.Random(11)


def test_number_words():
    assert [nm.cardinal_hu(n) for n in (0, 2, 11, 21, 100, 200, 1984, 2000, 2001, 1_000_000)] == ["nulla", "kettő", "tizenegy", "huszonegy", "száz", "kétszáz", "ezerkilencszáznyolcvannégy", "kétezer", "kétezer-egy", "egymillió"]
    assert [nm.cardinal_en(n) for n in (0, 13, 42, 115, 2001)] == ["zero", "thirteen", "forty-two", "one hundred and fifteen", "two thousand and one"]
    assert [nm.roman_value(x) for x in ("IV", "XIX", "MCMLXXXIV")] == [4, 19, 1984]


def test_signals():
    t = np.arange(1024) / 8000
    assert abs(signals.pitch_of(np.sin(2 * np.pi * 200 * t), 8000) - 200) < 3
    assert signals.pitch_of(np.zeros(1024), 8000) == 0


def test_edges(spark):
    cols = "media_id string, input_pos int, word string, start_ms long, end_ms long, score double, speaker string"
    w = spark.createDataFrame([("m", 0, "one", 0, 100, 0.5, "A"), ("m", 1, "two", 400, 500, 0.5, None), ("m", 2, "three", 400, 800, 0.5, "B"), ("m", 3, "[x]", 1101, 1200, 0.5, "B"), ("n", 0, "alone", 5, 9, None, None)], cols)
    idx = {(r.media_id, r.input_pos): r.seg_idx for r in segment.pause_segments(w).collect()}
    assert idx == {("m", 0): 0, ("m", 1): 0, ("m", 2): 0, ("m", 3): 1, ("n", 0): 0}  # a gap of just 300 does not break
    assert max(r.seg_idx for r in segment.pause_speaker_segments(w).collect()) == 1  # null speakers do not break
    rows = {(r.media_id, r.seg_idx): r for r in segment.segment_rows(segment.pause_segments(w)).collect()}
    assert rows["m", 0].speaker == "A" and rows["m", 0].mixed_speakers and rows["n", 0].speaker is None
    assert segment.drop_bracketed(segment.segment_rows(segment.pause_segments(w))).count() == 2
    pad = {r.input_pos: (r.start_ms, r.end_ms) for r in words.pad_words(w).where("media_id = 'm'").collect()}
    assert pad == {0: (0, 200), 1: (300, 500), 2: (400, 900), 3: (1001, 1300)}
    assert segment.segment_rows(segment.pause_segments(w.limit(0))).count() == 0


def test_sequential_plan_is_the_loop(spark):
    rows = []
    for m in range(30):
        t = 0
        for i in range(RNG.randint(1, 12)):
            t += RNG.randint(1, 900)
            rows.append((f"m{m}", i, t, t + 500, RNG.randint(1, 1500)))
    got = {(r.media_id, r.i): (r.length_ms, r.place_ms) for r in timeline.sequential_plan(spark.createDataFrame(rows, "media_id string, i int, start_ms long, end_ms long, actual_ms long")).collect()}
    for m in {r[0] for r in rows}:
        cursor = 0
        for _, i, start, _, actual in sorted(r for r in rows if r[0] == m):
            length, place = actual * 100 // 110, max(start, cursor)
            cursor = place + length
            assert got[m, i] == (length, place)


def test_review_cases(spark):
    from cuelane.operators import review

    seg = spark.createDataFrame([("t", 0, 0, 1000, "a"), ("t", 1, 1500, 2500, "b")], "media_id string, seg_idx int, start_ms long, end_ms long, text string")
    edits = spark.createDataFrame([("t", 0, "update", 100, 1100, "x"), ("t", 1, "update", 500, 2000, "x"), ("t", 7, "delete", None, None, None), ("t", 8, "insert", 1100, 1400, "mid"), ("t", 9, "insert", 800, 1200, "bad")], "media_id string, seg_idx int, op string, start_ms long, end_ms long, text string")
    up = {r.seg_idx: r for r in review.apply_updates(seg, edits).collect()}
    assert up[0].reason is None and up[0].changed and up[1].reason == "overlaps previous"
    worded = seg.selectExpr("*", "upper(text) AS translated_text", "array(text) AS words").unionByName(seg.selectExpr("'u' AS media_id", "seg_idx", "start_ms", "end_ms", "text", "NULL AS translated_text", "array(text) AS words"))
    checked = review.apply_updates(worded, edits)
    new = {(r.media_id, r.seg_idx): (r.start_ms, r.end_ms, r.text, r.translated_text, r.words) for r in review.updated_segments(worded, checked).collect()}
    assert new == {("t", 0): (100, 1100, "x", "A", None), ("t", 1): (1500, 2500, "b", "B", None), ("u", 0): (0, 1000, "a", None, ["a"]), ("u", 1): (1500, 2500, "b", None, ["b"])}
    schema = "media_id string, seg_idx int, op string, start_ms long, end_ms long, text string, translated_text string"
    texts = spark.createDataFrame([("t", 0, "update", 0, 1000, None, "neu"), ("t", 1, "update", 1500, 2500, "b", None), ("u", 0, "update", 0, None, "x", None), ("u", 9, "update", 0, 1, "x", None), ("u", 1, "update", 1500, 2500, "c", None)], schema)
    assert {(r.media_id, r.seg_idx): (r.reason, r.changed) for r in review.apply_updates(worded, texts).collect()} == {("t", 0): (None, True), ("t", 1): (None, False), ("u", 0): ("no times", False), ("u", 9): ("no such segment", False), ("u", 1): (None, True)}
    deletes = spark.createDataFrame([("t", 0, "delete"), ("t", 0, "delete"), ("t", 2, "delete"), ("t", -1, "delete")], "media_id string, seg_idx int, op string")
    assert sorted((r.seg_idx, r.reason or "") for r in review.check_deletes(seg, deletes).collect()) == [(-1, "no such segment"), (0, ""), (0, "duplicate"), (2, "no such segment")]
    assert [(r.seg_idx, r.old_idx) for r in review.apply_deletes(seg, deletes).collect()] == [(0, 1)]
    strange = spark.createDataFrame([("t", 1, "insert", -5, -1, "x"), ("t", 2, "insert", None, 3, "x")], "media_id string, seg_idx int, op string, start_ms long, end_ms long, text string")
    assert {r.seg_idx: r.reason for r in review.apply_inserts(seg, strange).collect()} == {1: "negative", 2: "no times"}
    ins = review.apply_inserts(seg, edits)
    assert {r.seg_idx: r.reason for r in ins.collect()} == {8: None, 9: "start overlaps"}
    assert [r.start_ms for r in review.inserted_segments(seg, ins, edits).orderBy("seg_idx").collect()] == [0, 1100, 1500]
    assert review.apply_deletes(seg, edits).count() == 2


def test_long_recording_takes_half(spark):
    """One recording with half of all rows gives the same intervals as bucket-free logic."""
    turns = [("big", i * 700, i * 700 + 900, f"S{i % 3}") for i in range(600)] + [(f"m{i}", 0, 5000, "S0") for i in range(600)]
    seg = [("big", i, i * 5000, i * 5000 + 4000) for i in range(80)] + [(f"m{i}", 0, 1000, 9000) for i in range(600)]
    t = spark.createDataFrame(turns, "media_id string, start_ms long, end_ms long, speaker string")
    s = spark.createDataFrame(seg, "media_id string, seg_idx int, start_ms long, end_ms long")
    want = {(m, i, max(a, x), min(b, y), sp) for m, i, a, b in seg for n, x, y, sp in turns if m == n and x < b and y > a}
    got = [tuple(r) for r in intervals.crop_turns(s, t).select("media_id", "seg_idx", "start_ms", "end_ms", "speaker").collect()]
    assert len(got) == len(want) and set(got) == want


def test_align_helpers():
    from cuelane.operators import align

    assert align.cut_text_at_ratio("One two. Three four five six.", 0.3) == ("One two.", "Three four five six.")
    assert align.cut_text_at_ratio("abcdef ghijkl mnopqr", 0.0) == ("", "abcdef ghijkl mnopqr") and align.cut_text_at_ratio("short", 0.95) == ("short", "")
    assert align.cut_text_at_ratio("some words here a longer tail", 0.6)[0][-2:] != " a"
    for _ in range(200):
        entries, segs, t = [], [], 0
        for i in range(RNG.randint(1, 8)):
            entries.append((t, t + RNG.randint(200, 3000), " ".join(f"w{i}x{j}" for j in range(RNG.randint(1, 12)))))
            t = entries[-1][1] + RNG.choice([0, 200])
        cut = sorted(RNG.sample(range(1, t + 1), min(t, RNG.randint(1, 6))))
        segs = list(zip([0, *cut], [*cut, t + 1], strict=True))
        words = [w for _, _, x in entries for w in x.split()]
        got = align.lay_by_time(segs, entries)
        said = "".join("".join(got).split())
        assert len(got) == len(segs) and "".join(words).startswith(said[:5])
        parts = align.share_by_durations([b - a for a, b in segs], [x for _, _, x in entries])
        assert len(parts) == len(segs) and "".join("".join(parts).split()) == "".join(words)
    assert align.lay_by_time([(0, 1000)], [(0, 1000, "all of it")]) == ["all of it"] and align.share_by_durations([], ["x"]) == []
    assert align.lay_by_time([(0, 500), (500, 1000)], []) == ["", ""]
    assert align.best_place(10, [([7, 13], 5), ([10], 5)]) == 13 and align.best_place(10, [([2], 5), ([9, 11], 5)]) == 11 and align.best_place(10, [([2], 5)]) is None
    assert align.blank_place("abc def", 1) == 3 and align.blank_place("abc def", 5) == 4 and align.blank_place("abcdef", 3) == 6
    word = "x" * 52
    assert align.cut_text_at_ratio(word, 0.4) == (f"{'x' * 51} x", "")  # no blank: all but one letter, which is too short to be left
    assert align.cut_text_at_ratio("She said a, then left the room", 0.3) == ("She said", "a then left the room")
    assert align.share_by_durations([1, 1, 1], ["abc"]) == ["a", "b", "c"]
    assert align.share_by_durations([100, 100], ["First part here.", "Second part here."]) == ["First part here.", "Second part here."]


def test_suffixes_and_characters(spark):
    from pyspark.sql import functions as F

    from cuelane.functions import normalise as nm
    from cuelane.operators import qc

    words = {"házként": "ház", "HÁZBAN": "HÁZ", "Google-ról": "Google", "Google-RÓL": "Google", "ban": "ba", "n": "n", "alma": "alma", "x-y": "x-y", "olvasásban": "olvas"}
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", nm.strip_suffix(F.col("w")).alias("s")).collect()}
    assert got == words
    texts = {"egy-egy al-ma": "egy egy alma", "öt-öt": "öt öt", "tíz-egy-egyes": "tízegyegyes", "(a) 'b'  #c": "a b c"}
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in texts], "w string").select("w", nm.clean_chars(F.col("w")).alias("s")).collect()}
    assert got == texts
    said = spark.createDataFrame([("twelve men", "12 men"), ("one two three", None), ("aaa", "bbbbbbb")], "gen_text string, transcribed string")
    assert [(r.distance, r.text_ok) for r in qc.text_check(said, lang="en").orderBy("gen_text").collect()] == [(-1, False), (-1, False), (0, True)]


def test_hungarian():
    from cuelane.functions import hungarian as hu

    assert hu.times_hu("8:00-kor") == "nyolc órakor" and hu.times_hu("7:30:05") == "hét óra harminc perc öt másodperc"
    assert hu.times_hu("7:30") in ("hét óra harminc perc", "hét harminc")
    assert hu.alphanumeric_hu("A123B") == "a százhuszonhárom bé" and hu.alphanumeric_hu("K-9 és 5-ös alma") == "ká kilenc és 5-ös alma"
    assert [hu.ordinal_hu(n) for n in (1, 2, 3, 11, 12, 20, 21, 100, 1000)] == ["első", "második", "harmadik", "tizenegyedik", "tizenkettedik", "huszadik", "huszonegyedik", "századik", "ezredik"]
    assert hu.ordinals_hu("a 3. nap 2024. végén 5.") == "a harmadik nap 2024. végén 5."
    assert hu.dates_hu("2024.03.01. volt, 2024-13-01 nem") == "kétezer-huszonnégy március elseje volt, 2024-13-01 nem"
    assert hu.normalise_text("A IV. nap: 12 (alma)") == "A negyedik nap tizenkettő alma"


def test_diarization_error_counts_everything(spark):
    """Many speakers, turns after the first minute, overlaps and crossed names, against a literal scan and all maps."""
    r = random.Random(4)
    sides = {}
    for side in "rh":
        sides[side] = [(m, f"{side}{r.randrange(6)}", t := r.randrange(0, 150000), t + r.randrange(0, 9000)) for m in "ab" for _ in range(30)]
    want = {}
    for m in "ab":
        ref, hyp = ([x[1:] for x in sides[s] if x[0] == m] for s in "rh")
        borders = [y for x in ref for y in x[1:]]
        cuts = sorted({y for x in ref + hyp for y in x[1:]} | {y + d for y in borders for d in (-250, 250)})
        miss = false = total = both = 0
        pair = {}
        for a, b in itertools.pairwise(cuts):
            mid = (a + b) / 2
            if any(abs(mid - x) < 250 for x in borders):
                continue
            on = [{s for s, x, y in side if x <= mid < y} for side in (ref, hyp)]
            n, k = len(on[0]), len(on[1])
            miss, false, total, both = miss + max(0, n - k) * (b - a), false + max(0, k - n) * (b - a), total + n * (b - a), both + min(n, k) * (b - a)
            for p in itertools.product(*on):
                pair[p] = pair.get(p, 0) + b - a
        best = max(sum(pair.get((f"r{i}", f"h{j}"), 0) for i, j in enumerate(c)) for c in itertools.permutations(range(6)))
        want[m] = (miss, false, both - best, total)
    frames = [spark.createDataFrame(sides[s], "media_id string, speaker string, start_ms long, end_ms long") for s in "rh"]
    got = {x.media_id: (x.missed, x.false_alarm, x.confusion, x.total) for x in intervals.diarization_error(*frames).collect()}
    assert got == want
    odd = [spark.createDataFrame(x, "media_id string, speaker string, start_ms long, end_ms long") for x in ([("a", None, 0, 2000), ("b", "s", 5, 5), (None, "s", 0, 9)], [("a", "t", 0, 2000), ("c", "t", 7, 7), ("d", "t", 100, 400), ("d", "t", None, 9)])]
    got = {x.media_id: (x.missed, x.false_alarm, x.confusion, x.total, x.der) for x in intervals.diarization_error(*odd).collect()}
    assert got == {"a": (0, 0, 0, 1500, 0.0), "b": (0, 0, 0, 0, 0.0), "c": (0, 0, 0, 0, 0.0), "d": (0, 300, 0, 0, 0.0)}
    assert intervals.diarization_error(*[x.limit(0) for x in odd]).count() == 0


def test_dates_hu_nine_shapes(spark):
    from cuelane.functions import hungarian as hu
    from cuelane.plans import q_hungarian

    want = "kétezer-huszonöt június elseje"
    for text in ("2025. június 1.", "2025. 06. 01.", "2025.06.01.", "2025. jún. 1.", "2025.jún.1.", "2025. VI. 1.", "2025.VI.1.", "2025-06-01"):
        assert hu.dates_hu(f"a {text} nap") == f"a {want} nap"
        assert hu.normalise_text(f"a {text} nap") == f"a {want.replace("-", "")} nap"
    assert hu.dates_hu("2024. aug. 10-én volt") == "kétezer-huszonnégy augusztus tizedikeén volt"
    assert hu.dates_hu("2025. XV. 1. és 2025. jún. 40.") == "2025. XV. 1. és 2025. június 40."  # the short month alone
    assert hu.dates_hu("dec. 5-én, 12-én és 3-án; szept.ben") == "december ötödikén, tizenkettedikén és harmadikán; szept.ben"
    assert hu.dates_hu("2025/06/01 és 2025.06.01 és 2025-6-1") == "2025/06/01 és 2025.06.01 és 2025-6-1"  # none of the shapes
    assert hu.ordinals_hu("a 10000000000000. nap") == "a tízbilliomodik nap" and hu.ordinals_hu(f"a 1{'0' * 40}. nap") == f"a 1{'0' * 40}. nap"
    assert hu.numbers_hu("1000000000001") == "egybillió-egy" and nm.cardinal_en(10**15 + 1) == "one quadrillion and one"
    assert hu.clean_hu("egy-egy al-ma (x)", [("alma", "körte")]) == "egy egy körte x" and hu.times_hu("7:00:05") == "hét óra  perc öt másodperc"
    rows = spark.sql("SELECT id AS o_orderkey, make_date(2025, CAST(1 + id % 12 AS int), 1) AS o_orderdate FROM range(36)").select("o_orderkey", q_hungarian._stamp().alias("t")).collect()
    assert {r.t for r in rows if r.o_orderkey in (5, 14)} >= {"2025. VI. 1.", "2025. III. 1."}
    assert not any(c.isdigit() for r in rows for c in hu.dates_hu(r.t))


def test_phonemes(spark):
    from pyspark.sql import functions as F

    from cuelane.functions import phonemes as ph

    cases = {"d ʒ ɔː n": "dzsón", "i ə ɹ": "iar", "d ˈ ʒ": "dzs", "ˈ . |": None, "": None, "m j u z i ə m": "muzeum", "ŋ:: Q: aː": "nggqá", "t| ʃ": "cs", "t  ʃ": "ts", "m a n h a n": "manhatán", "z i ʌ m": "zeum", "ɹ: k": "rrk", "a: ɹ k": "ark", "n̩ ?": "an?"}
    rows = spark.createDataFrame([(k,) for k in cases], "k string").select("k", ph.phonemes_to_hu(F.split("k", " ")).alias("v"), ph.phonemes_to_hu(F.lit(None).cast("array<string>")).alias("none")).collect()
    assert {r.k: r.v for r in rows} == cases and all(r.none is None for r in rows)


def test_compressed_files_are_smaller_and_read_the_same(spark, tmp_path):
    from cuelane.sources import transcripts

    rows = spark.createDataFrame([(f"m{i}", '{"words": [' + ", ".join(['{"word": "a\\"b", "start": 1.5}'] * 200) + "]}") for i in range(5)] + [("é/x", "[")], "media_id string, content string")
    size = {}
    for how in ("none", "gzip"):
        at = str(tmp_path / how)
        transcripts.write_files(rows, at, how)
        assert sorted(map(tuple, transcripts.read_files(spark, at).collect())) == sorted(map(tuple, rows.collect()))
        words, bad = transcripts.read_payloads(spark, at)
        assert words.count() == 1000 and [tuple(r) for r in bad.collect()] == [("é/x", "malformed")]
        size[how] = transcripts.list_files(spark, at).agg({"length": "sum"}).first()[0]
    assert size["gzip"] * 5 < size["none"]
