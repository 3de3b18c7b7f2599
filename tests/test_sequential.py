"""Dynamic programs and recurrences against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text import LEXICON, tokenize

from cuelake.functions.grammar import Rules
from cuelake.operators import recover, segment, sequence


def test_slice_groups():
    rnd = random.Random(5)
    for _ in range(200):
        n, m = rnd.randint(0, 6), rnd.randint(1, 4)
        w, sl = [rnd.randint(1, 9) for _ in range(n)], [rnd.randint(1, 9) for _ in range(m)]
        got = segment.slice_groups(np.array(w, float), np.array(sl, float))
        if m == 1 or n == 0:
            assert got == [(0, n)]
            continue
        rate = sum(w) / sum(sl)
        ways = [(0, *c, n) for c in itertools.combinations_with_replacement(range(n + 1), m - 1)]
        cost = lambda c: sum(abs(sum(w[a:b]) - s * rate) for a, b, s in zip(c, c[1:], sl))
        mine = (0, *(b for _, b in got))
        assert [a for a, _ in got] == list(mine[:-1])
        assert cost(mine) == pytest.approx(min(map(cost, ways)))


def test_break_lines():
    rnd = random.Random(6)
    for _ in range(150):
        n = rnd.randint(1, 8)
        s = np.cumsum([rnd.randint(1, 40) * 100_000 for _ in range(n)])
        e = s + np.array([rnd.randint(1, 30) * 100_000 for _ in range(n)])
        width = np.array([rnd.randint(1, 6) for _ in range(n)], float)
        cut = np.array([0.0] + [rnd.choice([-1.5, -1.0, 1.0, 4.0]) for _ in range(n - 1)])
        starter = np.array([rnd.random() < 0.3 for _ in range(n)])

        def cost(first):
            total = 0.0
            for i, j in zip(first, [*first[1:], n]):
                d = e[j - 1] - s[i]
                if j - i > 1 and (width[i:j].sum() > 10 or d > segment.LONGEST_LINE):
                    return float("inf")
                total += cut[i] + (6.0 if j < n and starter[j - 1] else 0.0)
                total += 3.0 if d < 350_000 else 1.0 if d < 600_000 else 0.5 * (d - 8e6) / 1e6 if d > 8e6 else 0.0
            return total

        got = segment.break_lines(s, e, width, cut, starter, 10.0).tolist()
        ways = [[0, *c] for k in range(n) for c in itertools.combinations(range(1, n), k)]
        assert cost(got) == pytest.approx(min(map(cost, ways)))


def test_retime_keeps_order():
    rnd = random.Random(7)
    for _ in range(100):
        t, words, ranges = 0, [], []
        for _ in range(rnd.randint(1, 5)):
            group = []
            for _ in range(rnd.randint(1, 6)):
                group.append((t, t + rnd.randint(50_000, 900_000)))
                t = group[-1][1] + rnd.choice([0, 200_000])
            words.append(group)
            ranges.append((group[0][0], group[-1][1]))
        spans = np.array([[a, a + 700_000] for a in range(0, t, 1_000_000)], float)
        out, begins = segment.retime_episode(words, ranges, spans)
        assert len(out) == sum(map(len, words)) and begins == list(np.cumsum([len(g) for g in words])[:-1])
        assert all(a[0] <= b[0] for a, b in zip(out, out[1:])) and all(b > a for a, b in out)


def test_clamps(spark):
    rnd = random.Random(8)
    rows = [(ep, i, rnd.randint(0, 100) * 100_000, 0) for ep in range(5) for i in range(20)]
    df = spark.createDataFrame([(a, b, s, s + rnd.randint(-3, 30) * 100_000) for a, b, s, _ in rows], "ep long, i long, s long, e long")
    by = {}
    for r in sequence.sequential_clamp(df).collect():
        by.setdefault(r["ep"], []).append((r["s"], r["e"]))
    raw = {}
    for r in df.collect():
        raw.setdefault(r["ep"], []).append([r["s"], r["i"], r["e"]])
    for ep, x in raw.items():
        x.sort()
        out = [[s, e] for s, _, e in x]
        for k in range(len(out)):
            if k and out[k][0] < out[k - 1][1] + 50_000:
                out[k][0] = out[k - 1][1] + 50_000
            if k + 1 < len(out) and out[k][1] > out[k + 1][0] - 50_000:
                out[k][1] = max(out[k][0] + 300_000, out[k + 1][0] - 50_000)
        assert sorted(map(tuple, out)) == sorted(by[ep])
    m = sequence.monotone_repair(df).collect()
    assert all(r["e"] >= r["s"] for r in m)


def test_repair_boundaries(spark):
    """A torn word, a phrase before a particle and a word that begins sentences move on; a bound one and one before a silence stay."""
    ms = 1000
    episodes = {
        1: ([("思う", 0, 500), ("ス", 900, 1000)], [("ポーツ", 1000, 1200)], 950, 1),
        2: ([("です", 0, 300), ("か", 300, 500), ("俺", 600, 800)], [("が", 800, 900), ("いや", 900, 1000)], 850, 1),
        3: ([("思う", 0, 500), ("いや", 600, 1000)], [("俺", 1000, 1200)], 800, 1),
        4: ([("思う", 0, 500), ("ね", 900, 1000)], [("が", 1000, 1200)], 950, 0),
        5: ([("思う", 0, 500), ("ス", 900, 1000)], [("ポーツ", 1200, 1300)], 950, 0),
        6: ([("思う", 0, 500), ("いや", 600, 1000)], [("俺", 1000, 1200)], 1100, 0),
    }
    words, timeline = [], []
    for ep, (left, right, cut, _) in episodes.items():
        for i, (w, a, z) in enumerate(left + right):
            words.append((ep, i, a * ms, z * ms, w, 7 + (i >= len(left)), 1 + (i >= len(left))))
        timeline += [(ep, 7, 0, cut * ms), (ep, 8, cut * ms, 5000 * ms)]
    owned = spark.createDataFrame(words, "ep long, i long, s long, e long, text string, owner long, run long")
    got = {}
    for r in segment.repair_boundaries(owned, spark.createDataFrame(timeline, "ep long, j long, cs long, ce long"), Rules(tokenize)).collect():
        got.setdefault(r["ep"], []).append((r["run"], r["i"]))
    for ep, (left, _, _, moves) in episodes.items():
        assert [n for n, _ in sorted(got[ep])].count(1) == len(left) - moves, ep
    late = owned.withColumn("owner", F.lit(None).cast("long"))
    assert late.count() == segment.repair_boundaries(late, spark.createDataFrame(timeline, "ep long, j long, cs long, ce long"), Rules(tokenize)).where("run < 3").count()


def plain_groups(words, slices):
    """Cheapest way to deal words to slices, by trying all; of equal ways the one whose last groups begin earliest."""
    n, m = len(words), len(slices)
    length = [max(50_000, b - a) for a, b in words]
    rate = sum(length) / sum(b - a for a, b in slices)
    ways = [(0, *c, n) for c in itertools.combinations_with_replacement(range(n + 1), m - 1)]
    cost = lambda c: sum(abs(sum(length[a:b]) - (z - y) * rate) for a, b, (y, z) in zip(c, c[1:], slices))
    least = min(map(cost, ways))
    return min((c for c in ways if cost(c) <= least + 1e-6), key=lambda c: c[::-1])


def plain_retime(segments, spans):
    """(start, end) of all words: segments of (snapped start, snapped end, words), by the rules of the survey (D5)."""
    out, trusted, before = [], set(), None
    for lo, hi, words in segments:
        if out:
            trusted.add(len(out))
        s = max(before or 0, min(lo if before is None else max(lo, before), words[0][0]))
        e = max(hi, words[-1][1])
        cut = [(max(a, s), min(b, e)) for a, b in spans]
        cut = [(a, b) for a, b in cut if b - a > 20_000 and b > s]
        if len(cut) > 1:
            way = plain_groups(words, cut)
            for i, j, (a, b) in zip(way, way[1:], cut):
                share = (b - a) / (sum(max(50_000, z - y) for y, z in words[i:j]) or 1)
                at = a
                for q in range(i, j):
                    d = max(20_000, max(50_000, words[q][1] - words[q][0]) * share)
                    out.append((at, max(b if q == j - 1 else min(b, at + d), at + 20_000)))
                    at += d
        else:
            scale = min(1.6, max(0.75, max(50_000, e - s) / (sum(b - a for a, b in words) or 1)))
            for a, b in words:
                out.append((s, s + scale * max(50_000, b - a)))
                s = out[-1][1]
        before = out[-1][1]
    return out, trusted


def test_retime(spark):
    rnd = random.Random(11)
    words, ranges, spans, want = [], [], [], {}
    for ep in range(40):
        t, segs = 0, []
        for g in range(rnd.randint(1, 5)):
            own = []
            for _ in range(rnd.randint(1, 5)):
                own.append((t, t + rnd.randint(1, 9) * 70_001))
                t = own[-1][1] + rnd.choice([0, 130_000, 420_000])
            segs.append((own[0][0] + rnd.randint(-200_000, 200_000), own[-1][1] + rnd.randint(-100_000, 300_000), own))
            words += [(ep, g, k, a, b, f"{g}.{k}") for k, (a, b) in enumerate(own)]
            ranges.append((ep, g, *segs[-1][:2]))
        voice = [(a + 13, a + rnd.randint(1, 11) * 90_007) for a in range(0, t, 1_000_003)] if ep % 5 else []
        spans += [(ep, k, a, b) for k, (a, b) in enumerate(voice)]
        if voice:
            want[ep] = plain_retime(segs, voice)
        else:
            want[ep] = [x for *_, own in segs for x in own], set()
    got = segment.retime(
        spark.createDataFrame(words, "ep long, seg_i long, w_i long, s long, e long, text string").repartition(3),
        spark.createDataFrame(ranges, "ep long, i long, s long, e long"), spark.createDataFrame(spans, "ep long, j long, a long, b long"),
    ).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["ep"], r["n"])):
        by.setdefault(r["ep"], []).append(r)
    for ep, (times, trusted) in want.items():
        assert len(by[ep]) == len(times) and {r["n"] for r in by[ep] if r["trusted"]} == trusted
        for r, (a, b) in zip(by[ep], times):
            assert abs(r["s"] - a) <= 1 and abs(r["e"] - b) <= 1, (ep, r)
        for x, y in zip(by[ep], by[ep][1:]):
            gap = y["s"] - x["e"]
            assert y["gap"] == (gap if gap >= 150_000 else None)


def plain_lines(words, costs, starts, exempt, limit):
    """Cues of one episode by the rules of the survey (D1, then W4): every way to begin a line is tried."""
    n = len(words)
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    for j in range(1, n + 1):
        for i in range(j - 1, -1, -1):
            length = words[j - 1]["e"] - words[i]["s"]
            if i < j - 1 and (sum(w["width"] for w in words[i:j]) > limit or length > 12_000_000):
                break
            text = "".join(w["text"] for w in words[i:j])
            cost = best[i] + costs[i] + (6.0 if j < n and starts[j - 1] and not exempt(text) else 0.0)
            cost += 3.0 if length < 350_000 else 1.0 if length < 600_000 else max(0.0, 0.5 * (length / 1e6 - 8))
            if cost < best[j] - 1e-9:
                best[j], back[j] = cost, i
    cuts, j = [], n
    while j:
        cuts, j = [(back[j], j), *cuts], back[j]
    cues = []
    for i, j in cuts:
        s = max(0, words[i]["s"] - 50_000)
        cues.append([s, max(s + 600_000, words[j - 1]["e"]), "".join(w["text"] for w in words[i:j]).strip()])
    for a, b in zip(cues, cues[1:]):
        a[1] = max(min(a[1], b[0] - 50_000), min(a[0] + 600_000, b[0] - 50_000))
    return [tuple(c) for c in cues if c[2]]


def test_transcript_lines(spark):
    """Words -> cues against the plain version, with the grammar's costs."""
    rnd = random.Random(13)
    rules = Rules(tokenize)
    words, spans, ranges = [], [], []
    for ep in range(25):
        t = 0
        for g in range(4):
            first = t
            for k in range(rnd.randint(1, 7)):
                length = rnd.choice([120_000, 300_000, 650_000, 4_100_000])
                words.append((ep, g, k, t, t + length, rnd.choice(list(LEXICON))))
                t += length + rnd.choice([0, 0, 200_000, 400_000, 1_700_000])
            ranges.append((ep, g, first, t))
        spans += [(ep, k, a, a + 1_300_000) for k, a in enumerate(range(0, t, 2_000_000))]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    w = frame(words, "ep long, seg_i long, w_i long, s long, e long, text string")
    r, v = frame(ranges, "ep long, i long, s long, e long"), frame(spans, "ep long, j long, a long, b long")
    by = {}
    for x in sorted(segment.retime(w, r, v).collect(), key=lambda x: (x["ep"], x["n"])):
        by.setdefault(x["ep"], []).append(x.asDict() | {"width": 60.0 * len(x["text"])})
    want = []
    for ep, x in by.items():
        text = [y["text"] for y in x]
        join = lambda a, z: "".join(text[max(0, a) : z])
        costs = [0.0] + [rules.cut_cost(join(n - 12, n), join(n, n + 6), x[n]["gap"], x[n]["trusted"]) for n in range(1, len(x))]
        starts = [rules.ends_with_starter(join(n - 1, n + 1)) for n in range(len(x))]
        want += [(ep, *c) for c in plain_lines(x, costs, starts, rules.all_starters, 400 * 0.8)]
    got = [(c["ep"], c["s"], c["e"], c["text"]) for c in segment.transcript_lines(w, r, v, rules, width=400).collect()]
    assert sorted(got) == sorted(want) and len({c[0] for c in got}) == 25


def test_transcript_is_one_pass(spark):
    """An episode goes through retiming, costs and line breaks at one go: one Arrow function, and the words are read once."""
    words = spark.createDataFrame([(1, 0, 0, 0, 10**6, "俺"), (None, 0, 0, 0, 10**6, "実は")], "ep long, seg_i long, w_i long, s long, e long, text string")
    ranges = spark.createDataFrame([(1, 0, 0, 10**6)], "ep long, i long, s long, e long").where("s >= 0")
    spans = spark.createDataFrame([(1, 0, 0, 10**6)], "ep long, j long, a long, b long")
    got = segment.transcript_lines(words, ranges, spans, Rules(tokenize))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("LogicalRDD") == 3 and "FlatMapGroups" not in plan and "EvalPython" not in plan
    assert {(r["ep"], r["text"]) for r in got.collect()} == {(1, "俺"), (None, "実は")}


def test_few_and_many_ways(monkeypatch):
    """What is tried one by one and what is an array give the same cuts."""
    rnd = random.Random(5)
    for _ in range(60):
        n = rnd.randint(1, 40)
        at = np.cumsum([rnd.choice([0, 200_000, 900_000, 13_000_000]) for _ in range(n)])
        args = at, at + 300_000, np.array([rnd.choice([0, 0.5, 4]) for _ in at]), np.array([rnd.choice([-1.5, 0, 1]) for _ in at]), np.array([rnd.random() < 0.3 for _ in at])
        exempt = lambda i, j: (i + j) % 3 == 0
        lengths, slices = np.array([rnd.randint(1, 9) * 1e5 for _ in at[:20]]), np.array([rnd.randint(1, 9) * 1e5 for _ in range(rnd.randint(1, 5))])
        both = []
        for few in (0, 64):
            monkeypatch.setattr(segment, "FEW_PLACES", few)
            monkeypatch.setattr(segment, "FEW_WORDS", few)
            both.append((segment.break_lines(*args, 6.0, exempt).tolist(), segment.slice_groups(lengths, slices)))
        assert both[0] == both[1]


def test_recover(spark):
    base = spark.createDataFrame([(1, 0, 0, 2_000_000, "hello there"), (1, 1, 9_000_000, 10_000_000, "good bye")], "ep long, j long, bs long, be long, text string")
    new = spark.createDataFrame(
        [(1, 0, 100_000, 1_900_000, "something else"), (1, 1, 4_000_000, 5_000_000, "brand new"), (1, 2, 8_000_000, 8_900_000, "good bye"), (1, 3, 6_000_000, 7_000_000, "!a")],
        "ep long, i long, s long, e long, text string",
    )
    got = recover.recover(new, base).orderBy("s").collect()
    assert [r["text"] for r in got] == ["hello there", "brand new", "good bye"]
    assert all(b["s"] >= a["e"] + 50_000 for a, b in zip(got, got[1:]))


def test_extensions(spark):
    base = spark.createDataFrame([(1, 0, 0, 2_000_000, "hello there"), (1, 1, 9_000_000, 10_000_000, "good bye")], "ep long, j long, bs long, be long, text string")
    heard = [(1, 0, 100_000, 2_100_000, "oh hello there you"), (1, 1, 0, 1_900_000, "hello!"), (1, 2, 9_000_000, 9_900_000, "other words, and many of them"), (1, 3, 5_000_000, 6_000_000, "brand new")]
    new = spark.createDataFrame(heard, "ep long, i long, s long, e long, text string")
    texts = lambda **more: [(r["s"], r["text"]) for r in recover.recover(new, base, **more).orderBy("s").collect()]
    assert texts() == [(0, "hello there"), (5_000_000, "brand new"), (9_000_000, "good bye")]
    assert texts(apply_extensions=True)[0] == (0, "oh hello there you")
    windows = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "ep long, i long")
    got = {r["ep"]: tuple(r)[1:] for r in recover.report(windows, new, base).collect()}
    assert got == {1: (2, 1, 1), 2: (1, 0, 0)}
