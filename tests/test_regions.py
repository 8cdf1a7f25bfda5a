"""Short regions and change points against literal models."""

import random

from cuelane.operators import intervals

RNG = random.Random(6)
SCHEMA = "media_id string, start_ms long, end_ms long, kind string"


def absorb_model(regions, least):
    r = list(regions)
    while len(r) > 1:
        i = next((i for i, (a, b, _) in enumerate(r) if b - a < least), None)
        if i is None:
            break
        a, b, _ = r[i]
        if i == 0:
            r[0:2] = [(a, r[1][1], r[1][2])]
        elif i == len(r) - 1:
            r[-2:] = [(r[-2][0], b, r[-2][2])]
        elif r[i - 1][2] == r[i + 1][2]:
            r[i - 1 : i + 2] = [(r[i - 1][0], r[i + 1][1], r[i - 1][2])]
        elif r[i - 1][1] - r[i - 1][0] >= r[i + 1][1] - r[i + 1][0]:
            r[i - 1 : i + 1] = [(r[i - 1][0], b, r[i - 1][2])]
        else:
            r[i : i + 2] = [(a, r[i + 1][1], r[i + 1][2])]
    return r


def some_regions(n, short):
    t, out = 0, []
    for _ in range(n):
        t += RNG.choice([0, 0, 40])
        d = RNG.randint(10, 249) if RNG.random() < short else RNG.randint(250, 600)
        out.append((t, t + d, RNG.choice(["single", "overlap"])))
        t += d
    return out


def test_short_regions(spark):
    recordings = {f"m{i}": some_regions(RNG.choice([1, 2, 3, 8, 40]), RNG.choice([0.2, 0.6, 1.0])) for i in range(150)}
    recordings["half of all"] = some_regions(3000, 0.4)
    rows = [(m, *r) for m, rs in recordings.items() for r in rs]
    RNG.shuffle(rows)
    got = {}
    for r in intervals.filter_short_regions(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.media_id, []).append((r.start_ms, r.end_ms, r.kind))
    assert {m: sorted(v) for m, v in got.items()} == {m: absorb_model(v, 250) for m, v in recordings.items()}
    assert intervals.filter_short_regions(spark.createDataFrame([], SCHEMA)).count() == 0


def test_change_points(spark):
    recordings = {f"m{i}": some_regions(RNG.choice([1, 2, 60]), 1.0) for i in range(40)}
    recordings["close"] = [(i * 30, i * 30 + 30, "single") for i in range(200)]

    def model(regions):
        out = []
        for t in sorted(a for a, _, _ in regions[1:]):
            if out and t - out[-1] <= 50:
                out[-1] = round((out[-1] + t) / 2)
            else:
                out.append(t)
        return out

    rows = [(m, *r) for m, rs in recordings.items() for r in rs]
    got = {m: [] for m in recordings}
    for r in intervals.change_points(spark.createDataFrame(rows, SCHEMA)).collect():
        got[r.media_id].append(r.t_ms)
    assert {m: sorted(v) for m, v in got.items()} == {m: model(v) for m, v in recordings.items()}
