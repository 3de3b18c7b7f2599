"""Sequential operators of an episode: dealing words to speech slices, retiming, optimal line breaks, alignment.

Everything that can be a column is one before the grouped pass; the passes themselves work on arrays of one episode,
which is the unit of state. Times are microseconds.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.functions.grammar import Rules, by_fragment
from cuelake.functions.text import strip, text_em
from cuelake.operators.intervals import SNAP_TOLERANCE, assign_intervals, nearest_pause
from cuelake.operators.sequence import (
    cap_times,
    display_clamp,
    merge_same_interval,
    monotone_repair,
    ordered_text,
    repair_reversed,
    runs,
)

# Microseconds, factors and costs.
SHORTEST_WORD, SHORTEST_PLACED, CUT_GAP = 50_000, 20_000, 150_000
STRETCH = (0.75, 1.6)
LONGEST_LINE, SLOW_LINE, SHORT_A, SHORT_B = 12_000_000, 8_000_000, 350_000, 600_000
COST_A, COST_B, COST_SLOW, COST_STARTER = 3.0, 1.0, 0.5, 6.0
SEAM_GAP, SEAM_SLACK = 150_000, 120_000
LINE_SHARE = 0.80
# Up to so many places a line may begin at, and words of a segment, are tried one by one; rows of a batch that goes back to Spark.
FEW_PLACES, FEW_WORDS, ROWS_A_BATCH = 64, 16, 1 << 16


def slice_groups(durations: np.ndarray, slices: np.ndarray) -> list[tuple[int, int]]:
    """Contiguous groups of words, one a slice, whose durations come nearest to the slices' shares.

    The sum of absolute differences is least; a group may be empty; of equal ways the earliest cut is taken.
    """
    n, m = len(durations), len(slices)
    if m <= 1 or n == 0:
        return [(0, n)]
    upto = np.concatenate([[0.0], np.cumsum(durations)])
    rate = (upto[-1] or 1.0) / (slices.sum() or 1.0)
    want = [x * rate for x in slices.tolist()]
    cuts = (_few_cuts if n <= FEW_WORDS else _cuts)(upto, want)
    out, j = [], n
    for k in reversed(range(m)):
        out.append((int(cuts[k][j]), j))
        j = int(cuts[k][j])
    return out[::-1]


def _cuts(upto: np.ndarray, want: list[float]) -> np.ndarray:
    """Where the group of each slice begins, by the number of words up to its end."""
    n, m = len(upto) - 1, len(want)
    cost = np.where(np.arange(n + 1) == 0, 0.0, np.inf)
    cuts = np.zeros((m, n + 1), np.int64)
    later = np.arange(n + 1)[:, None] > np.arange(n + 1)[None, :]  # a group cannot end before it begins
    for k in range(m):
        way = cost[:, None] + np.abs((upto[None, :] - upto[:, None]) - want[k])
        way[later] = np.inf
        cuts[k] = way.argmin(axis=0)
        cost = way[cuts[k], np.arange(n + 1)]
    return cuts


def _few_cuts(upto: np.ndarray, want: list[float]) -> list[list[int]]:
    """The same for a few words, without arrays."""
    upto = upto.tolist()
    cost, cuts = [0.0] + [math.inf] * (len(upto) - 1), []
    for x in want:
        ways = [min([(cost[i] + abs((end - upto[i]) - x), i) for i in range(j + 1)]) for j, end in enumerate(upto)]
        cuts.append([i for _, i in ways])
        cost = [c for c, _ in ways]
    return cuts


def segment_ranges(
    segments: DataFrame, spans: DataFrame, pauses: DataFrame, tolerance: int = SNAP_TOLERANCE, bucket_us: int = 3_600_000_000
) -> DataFrame:
    """Segments ``ep, i, s, e`` with ends moved to the pauses near them. Replaces ``s, e``.

    A boundary is the middle of one end and the next start; a pause within ``tolerance`` takes it over (its start ends
    one segment, its end starts the next). The outer ends snap to the first and last span. Then starts are made monotone.
    """
    w = W.partitionBy("ep").orderBy("i")
    x = segments.withColumn("t", F.floor((F.col("e") + F.lead("s").over(w)) / 2).cast("bigint"))
    outer = spans.groupBy("ep").agg(F.min("a").alias("first_a"), F.max_by("b", "j").alias("last_b"))
    x = nearest_pause(x, pauses, tolerance, bucket_us).join(outer, "ep", "left")
    x = x.withColumns({"end": F.coalesce("pa", "t"), "start": F.coalesce("pb", "t")}).drop("pause", "pa", "pb")
    first = F.when(F.abs(F.col("s") - F.col("first_a")) <= tolerance, F.col("first_a")).otherwise(F.col("s"))
    last = F.when(F.abs(F.col("e") - F.col("last_b")) <= tolerance, F.col("last_b")).otherwise(F.col("e"))
    x = x.withColumn("_s", F.coalesce(F.lag("start").over(w), first)).withColumn("_e", F.coalesce("end", last))
    x = x.drop("s", "e", "t", "end", "start", "first_a", "last_b").withColumnsRenamed({"_s": "s", "_e": "e"})
    return monotone_repair(x)


def retime_episode(words: list[list[tuple[int, int]]], ranges: list[tuple[int, int]], spans: np.ndarray):
    """New (start, end) of every word, segment by segment, and which words begin a segment after the first.

    A segment spans its snapped range and its own words, but never begins before the one before it ended. Where it holds
    several stretches of speech its words are dealt to them whole and fill them; else they keep their proportions.
    """
    out: list[tuple[float, float]] = []
    begins = []
    before = None
    for group, (lo, hi) in zip(words, ranges):
        if not group:
            continue
        if out:
            begins.append(len(out))
        start = lo if before is None else max(lo, before)
        start = max(before or 0, min(start, group[0][0]))
        hi = max(hi, group[-1][1])
        length = [float(max(SHORTEST_WORD, b - a)) for a, b in group]
        low, high = np.maximum(spans[:, 0], start), np.minimum(spans[:, 1], hi)
        long = high - low > SHORTEST_PLACED
        cut = list(zip(low[long].tolist(), high[long].tolist()))
        if len(cut) > 1:
            for (i, j), (a, b) in zip(slice_groups(np.array(length), np.array([b - a for a, b in cut])), cut):
                if i == j:
                    continue
                share, done = (b - a) / sum(length[i:j]), 0.0
                for k in range(i, j):
                    each = max(float(SHORTEST_PLACED), length[k] * share)
                    end = b if k == j - 1 else min(b, a + done + each)
                    out.append((a + done, max(end, a + done + SHORTEST_PLACED)))
                    done += each
        else:
            total = sum(b - a for a, b in group) or 1.0
            stretch, done = min(STRETCH[1], max(STRETCH[0], max(SHORTEST_WORD, hi - start) / total)), 0.0
            for each in length:
                each *= stretch
                out.append((start + done, start + done + each))
                done += each
        before = out[-1][1]
    return out, begins


def retime(words: DataFrame, ranges: DataFrame, spans: DataFrame) -> DataFrame:
    """words ``ep, seg_i, w_i, s, e, text``, ranges ``ep, i, s, e`` and spans ``ep, j, a, b`` -> ``ep, n, s, e, text, gap, trusted``.

    ``gap`` is the silence before the word where it is a candidate cut, ``trusted`` marks the first word of a later
    segment. An episode without spans keeps its times (sorted by start) and trusts nothing.
    """

    def rows(ep, words_, ranges_, spans_):
        start, end, text, gap, trusted, _ = _retimed(words_, ranges_, spans_)
        return [[ep] * len(start), np.arange(len(start)), start, end, text, pa.array(gap, mask=gap < CUT_GAP), trusted]

    kind = "ep long, n long, s long, e long, text string, gap long, trusted boolean"
    return _episodes(words, ranges, spans).mapInArrow(_by_episode(rows, _RETIMED), kind)


def _episodes(words: DataFrame, ranges: DataFrame, spans: DataFrame, *more: Column) -> DataFrame:
    """One row an episode with words: ``ep, words, ranges, spans``, sorted arrays; ``more`` are further fields of a word."""
    own = F.struct("seg_i", "w_i", "s", "e", "text", *more)
    per = words.groupBy("ep").agg(F.array_sort(F.collect_list(own)).alias("words"))
    r = ranges.groupBy("ep").agg(F.array_sort(F.collect_list(F.struct("i", "s", "e"))).alias("ranges"))
    v = spans.groupBy("ep").agg(F.array_sort(F.collect_list(F.struct("j", "a", "b"))).alias("spans"))
    return per.join(r, "ep", "left").join(v, "ep", "left")


def _by_episode(rows, kinds: dict[str, pa.DataType]):
    """Arrow function over ``_episodes``: the columns that ``rows`` makes of each, many episodes a batch.

    ``rows`` gets the number of the episode and, for words, ranges and spans, the fields by name as arrays.
    """

    def packed(parts):
        columns = [pa.concat_arrays([pa.array(p[k], t) for p in parts]) for k, t in enumerate(kinds.values())]
        return pa.RecordBatch.from_arrays(columns, names=[*kinds])

    def run(batches):
        for batch in batches:
            lists = []
            for column in map(batch.column, ("words", "ranges", "spans")):
                x = column.values
                lists.append((column.offsets.to_numpy(), {f.name: x.field(f.name).to_numpy(zero_copy_only=False) for f in x.type}))
            parts, n = [], 0
            for k, ep in enumerate(batch.column("ep").to_pylist()):
                part = rows(ep, *({c: x[at[k] : at[k + 1]] for c, x in fields.items()} for at, fields in lists))
                parts.append(part)
                n += len(part[1])
                if n >= ROWS_A_BATCH:
                    yield packed(parts)
                    parts, n = [], 0
            if parts:
                yield packed(parts)

    return run


def _retimed(words, ranges, spans):
    """Start, end, text, silence before, trust and place in ``words`` of the retimed words of one episode."""
    seg, s, e, text = (words[c] for c in ("seg_i", "s", "e", "text"))
    a, b = spans["a"], spans["b"]
    trusted, order = np.zeros(len(s), bool), np.arange(len(s))
    if not len(a):
        order = np.argsort(s, kind="stable")
        start, end = s[order].astype(float), e[order].astype(float)
    else:
        first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))  # words come sorted by segment
        to = np.append(first[1:], len(seg))
        known = dict(zip(ranges["i"].tolist(), zip(ranges["s"].tolist(), ranges["e"].tolist())))
        groups = [list(zip(s[i:j].tolist(), e[i:j].tolist())) for i, j in zip(first.tolist(), to.tolist())]
        places = [known.get(g, (own[0][0], own[-1][1])) for g, own in zip(seg[first].tolist(), groups)]
        placed, begins = retime_episode(groups, places, np.column_stack([a, b]).astype(float))
        start, end = np.array(placed, float).reshape(-1, 2).T
        trusted[begins] = True
    start, end = np.rint(start).astype(np.int64), np.rint(end).astype(np.int64)
    gap = np.zeros(len(start), np.int64)
    gap[1:] = start[1:] - end[:-1]
    return start, end, text[order], gap, trusted, order


_LONG = pa.int64()
_RETIMED = {"ep": _LONG, "n": _LONG, "s": _LONG, "e": _LONG, "text": pa.string(), "gap": _LONG, "trusted": pa.bool_()}
_LINES = {"ep": _LONG, "i": _LONG, "s": _LONG, "e": _LONG, "text": pa.string()}


def break_lines(
    start: np.ndarray, end: np.ndarray, width: np.ndarray, cut_cost: np.ndarray, starter: np.ndarray, limit: float, exempt=None
) -> np.ndarray:
    """First word of every line of the cheapest way to break words into lines.

    A line's cost is that of the cut before it, plus what its length asks for, plus ``COST_STARTER`` if it ends in a word
    that only begins sentences (not for the last line, nor where ``exempt(i, j)``). A line of several words is at most ``limit`` wide and
    ``LONGEST_LINE`` long. Of equal ways the latest cut is taken.
    """
    n = len(start)
    upto = np.concatenate([[0.0], np.cumsum(width)])
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    back = [0] * (n + 1)
    widths, begin, stop, costs, ends_so = (np.asarray(x).tolist() for x in (upto, start, end, cut_cost, starter))
    cheapest = best.tolist()
    for j in range(1, n + 1):
        # both limits only get worse to the left, so the places a line may begin at are a run that ends at j - 1
        lo = min(j - 1, bisect_left(widths, widths[j] - limit, 0, j))
        judged = j < n and ends_so[j - 1]
        if j - lo <= FEW_PLACES:
            least, at = math.inf, j - 1
            for i in range(j - 1, lo - 1, -1):
                d = stop[j - 1] - begin[i]
                if i < j - 1 and (d > LONGEST_LINE or widths[j] - widths[i] > limit):
                    break
                length = COST_A if d < SHORT_A else COST_B if d < SHORT_B else COST_SLOW * (d - SLOW_LINE) / 1e6 if d > SLOW_LINE else 0.0
                cost = cheapest[i] + costs[i] + length
                if judged:
                    cost += COST_STARTER * (1 if exempt is None else not exempt(i, j))
                if cost < least:
                    least, at = cost, i
            best[j] = cheapest[j] = least
            back[j] = at
            continue
        i = np.arange(lo, j)
        late = np.flatnonzero((end[j - 1] - start[i] > LONGEST_LINE) & (i < j - 1))
        i = i[late[-1] + 1 :] if len(late) else i
        i = i[(upto[j] - upto[i] <= limit) | (i == j - 1)]
        d = end[j - 1] - start[i]
        cost = best[i] + cut_cost[i] + np.where(
            d < SHORT_A, COST_A, np.where(d < SHORT_B, COST_B, np.where(d > SLOW_LINE, COST_SLOW * (d - SLOW_LINE) / 1e6, 0.0))
        )
        if judged:
            cost = cost + COST_STARTER * (1 if exempt is None else np.array([not exempt(int(k), j) for k in i]))
        k = len(cost) - 1 - int(cost[::-1].argmin())
        best[j], back[j] = cost[k], int(i[k])
        cheapest[j] = float(cost[k])
    cuts, j = [], n
    while j > 0:
        j = back[j]
        cuts.append(j)
    return np.array(cuts[::-1], np.int64)


def segment_lines(words: DataFrame, limit: float, all_starters=None) -> DataFrame:
    """``all_starters``: a rule on texts; a line that it holds for may end in a starter. words ``ep, n, s, e, text, width, cut_cost, starter`` -> cues ``ep, i, s, e, text`` by the cheapest line breaks, times clamped for display."""

    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t["n"].to_numpy(), kind="stable")
        col = lambda c: t[c].to_numpy(zero_copy_only=False)[order]
        s, e = col("s"), col("e")
        text = np.array(t["text"].to_pylist(), object)[order]
        exempt = None if all_starters is None else lambda i, j: len(x := "".join(text[i:j])) <= 12 and all_starters(x)
        first = break_lines(s, e, col("width").astype(float), col("cut_cost").astype(float), col("starter"), limit, exempt)
        to = np.append(first[1:], len(s))
        return pa.table(
            {
                "ep": pa.array([t["ep"][0].as_py()] * len(first), pa.int64()),
                "i": np.arange(len(first)),
                "s": s[first],
                "e": e[to - 1],
                "text": pa.array(["".join(text[a:b]).strip() for a, b in zip(first, to)], pa.string()),
            }
        )

    lines = words.select(
        "ep", "n", "s", "e", "text", "width", "cut_cost", "starter"
    ).groupBy("ep").applyInArrow(run, "ep long, i long, s long, e long, text string")
    return display_clamp(lines).where("text <> ''")


def expand_long(cues: DataFrame, limit: int) -> DataFrame:
    """Cues of more than ``limit`` characters in parts, one after the other, with time in proportion: ``ep, i, part, s, e, text``."""
    from cuelake.functions.kana import split_long_column

    x = cues.select(
        "ep", "i", "s", "e", F.greatest(F.length("text"), F.lit(1)).alias("n"), split_long_column(F.col("text"), limit).alias("p")
    )
    x = x.select("*", F.posexplode("p").alias("part", "text"))
    before = F.aggregate(F.slice("p", 1, F.col("part")), F.lit(0), lambda a, y: a + F.length(y))
    at = lambda n: (F.col("s") + (F.col("e") - F.col("s")) * n / F.col("n")).cast("bigint")
    return x.select("ep", "i", "part", at(before).alias("s"), at(before + F.length("text")).alias("e"), "text")


def seam_costs(text: str, at: list[int], gap: list[int], trusted: list[bool], rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """Cost of a line break before each word of an episode, and whether it and the one before end in a word that only begins sentences.

    ``text`` is all words joined, ``at`` where each begins and the last one ends. A cost is that of up to twelve words
    before and six from the word on; no cost depends on where a line began.
    """
    n = len(at) - 1
    cost, starter = np.zeros(n), np.zeros(n, bool)
    for k in range(n):
        here, to = at[k], at[k + 1]
        if k:
            before, after = text[max(at[max(0, k - 12)], here - 12) : here], text[here : at[min(n, k + 6)]]
            cost[k] = rules.cut_cost(before, after, gap[k] if gap[k] >= CUT_GAP else None, trusted[k])
        starter[k] = rules.ends_with_starter(text[max(at[max(0, k - 1)], to - 8) : to])
    return cost, starter


def transcript_lines(words: DataFrame, ranges: DataFrame, spans: DataFrame, rules: Rules, width: int = 1920, main: int = 60) -> DataFrame:
    """Recognised words -> cues ``ep, i, s, e, text``: words on the time of the speech, grammar costs, cheapest line breaks.

    words ``ep, seg_i, w_i, s, e, text``, snapped ranges ``ep, i, s, e``, speech ``ep, j, a, b``. A line is at most
    ``LINE_SHARE`` of ``width`` pixels wide at ``main`` pixels an em. An episode goes through all steps at one go.
    """
    limit = width * LINE_SHARE

    def lines(ep, words_, ranges_, spans_):
        s, e, text, gap, trusted, order = _retimed(words_, ranges_, spans_)
        text = [t or "" for t in text]
        whole, at = "".join(text), [0, *accumulate(map(len, text))]
        cost, starter = seam_costs(whole, at, gap.tolist(), trusted.tolist(), rules)
        exempt = lambda i, j: at[j] - at[i] <= 12 and rules.all_starters(whole[at[i] : at[j]])
        first = break_lines(s, e, words_["width"][order], cost, starter, limit, exempt)
        to = np.append(first[1:], len(s))
        cues = [whole[at[i] : at[j]].strip() for i, j in zip(first.tolist(), to.tolist())]
        return [[ep] * len(first), np.arange(len(first)), s[first], e[to - 1], cues]

    em = (F.coalesce(text_em(F.col("text")), F.lit(0.0)) * main).alias("width")
    made = _episodes(words, ranges, spans, em).mapInArrow(_by_episode(lines, _LINES), "ep long, i long, s long, e long, text string")
    return display_clamp(made).where("text <> ''")


def repair_boundaries(
    owned: DataFrame, intervals: DataFrame, rules: Rules, max_gap: int = SEAM_GAP, slack: int = SEAM_SLACK
) -> DataFrame:
    """Words ``ep, i, s, e, text, owner, run``: a run's last word that belongs to the next run moves there (``run`` grows).

    It moves from an interval to a later one, over a silence of at most ``max_gap``, if it is not bound to what precedes
    and one of three things holds: the end of its interval lies in it and it begins a sentence by itself; or that end lies
    in it (give or take ``slack``) and it is one word with the next one; or that end lies before the end of the next word
    (and ``slack``) and the next run goes on with a particle. As every run has a word of its own to give and the word it
    looks at is the next run's first as it came, no move depends on another one: all of them are columns.
    """
    word = F.struct("i", "s", "e", "text")
    ends = owned.groupBy("ep", "run", "owner").agg(
        F.max_by(word, "i").alias("last"), F.min_by(word, "i").alias("first"), F.left(ordered_text("text", "i"), F.lit(10)).alias("head")
    )
    w = W.partitionBy("ep").orderBy("run")
    nxt = lambda c: F.lead(c).over(w)
    x = ends.select("ep", "run", "owner", "last", nxt("owner").alias("to"), nxt("first").alias("next"), nxt("head").alias("head"))
    x = x.join(intervals.select("ep", F.col("j").alias("owner"), F.col("ce").alias("cut")), ["ep", "owner"])
    x = x.where((F.col("owner") < F.col("to")) & (F.col("next.s") - F.col("last.e") <= max_gap) & (F.col("cut") >= F.col("last.s")))
    x = x.withColumns({"_a": F.col("last.text"), "_b": F.col("next.text")})

    def judge(a: str, b: str, head: str) -> tuple[bool, bool, bool]:
        free = not rules.bound_tail(a)
        return free and rules.joined_word(a, b), free and rules.next_starts_with_particle(a, head), free and rules.starts_sentence(a)

    x = by_fragment(x, ["_a", "_b", "head"], "_judged", judge, "joined boolean, particle boolean, starts boolean")
    inside = (F.col("cut") > F.col("last.s")) & (F.col("cut") < F.col("last.e"))
    moved = x.where(
        (F.col("_judged.joined") & (F.col("cut") <= F.col("last.e") + slack))
        | (F.col("_judged.particle") & (F.col("cut") <= F.col("next.e") + slack))
        | (F.col("_judged.starts") & inside)
    ).select("ep", F.col("last.i").alias("i"), F.lit(1).alias("_on"))
    return owned.join(moved, ["ep", "i"], "left").withColumn("run", F.col("run") + F.coalesce("_on", F.lit(0))).drop("_on", "owner")


def align_timeline(
    words: DataFrame,
    intervals: DataFrame,
    cap=None,
    tolerance: int = 600_000,
    bucket_us: int = 3_600_000_000,
    rules: Rules | None = None,
    max_gap: int = SEAM_GAP,
    slack: int = SEAM_SLACK,
) -> DataFrame:
    """Words ``ep, i, s, e, text`` on a reference timeline: ``ep, s, e, text``. ``i`` is a word's place in its episode.

    Neighbouring words of one interval make a cue with the interval's times, words of none keep their own; with ``rules``
    a word on the wrong side of a boundary moves over it. Empty cues go, reversed ones are repaired, cues with one time
    (to the millisecond) become one, and then times are capped.
    """
    owned = runs(assign_intervals(words, intervals, tolerance, bucket_us), "owner", "i")
    owner = owned.groupBy("ep", "run").agg(F.first("owner").alias("owner"))
    placed = owned if rules is None else repair_boundaries(owned, intervals, rules, max_gap, slack)
    cues = placed.groupBy("ep", "run").agg(
        F.min_by("s", "i").alias("ws"), F.max_by("e", "i").alias("we"), strip(ordered_text("text", "i")).alias("text")
    )
    timed = cues.where("text <> ''").join(owner, ["ep", "run"]).join(
        intervals.select("ep", F.col("j").alias("owner"), "cs", "ce"), ["ep", "owner"], "left"
    )
    timed = timed.select("ep", F.col("run").alias("i"), F.coalesce("cs", "ws").alias("s"), F.coalesce("ce", "we").alias("e"), "text")
    return cap_times(merge_same_interval(repair_reversed(timed)), F.lit(cap).cast("bigint"))
