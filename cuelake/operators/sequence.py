"""Ordered operators inside one episode: gaps, runs, clamps, prefix sums, context.

All of them partition by ``ep`` and order by ``(s, i)``: the ordinal makes every order total. Recurrences with a closed
form are windows; the one without is a grouped Arrow function with one pass over an episode.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Microseconds, and characters a second.
MIN_GAP, MAX_CHUNK = 800_000, 12_000_000
CUT_GAP, STRONG_GAP = 150_000, 300_000
LEAD_IN, MIN_SHOW, BETWEEN = 50_000, 600_000, 50_000
CLAMP_MIN = 300_000
FAST_CHARS = 10


def _w(*order: str):
    return W.partitionBy("ep").orderBy(*(order or ("s", "i")))


def gaps(spans: DataFrame) -> DataFrame:
    """Silences between consecutive spans: ``ep, i, pa, pb, gap``; only positive ones."""
    return spans.select(
        "ep", "i", F.col("e").alias("pa"), F.lead("s").over(_w()).alias("pb")
    ).withColumn("gap", F.col("pb") - F.col("pa")).where("gap > 0")


def gap_windows(cues: DataFrame, min_gap: int = MIN_GAP, chunk: int = MAX_CHUNK) -> DataFrame:
    """Gaps of ``min_gap`` or more between a cue's end and the next one's start, cut into chunks: ``ep, i, k, w0, w1``.

    A last chunk shorter than ``min_gap`` is dropped; there is no window before the first cue or after the last.
    """
    g = cues.select("ep", "i", F.col("e").alias("a"), F.lead("s").over(_w()).alias("b")).where(F.col("b") - F.col("a") >= min_gap)
    last = F.floor((F.col("b") - F.col("a") - 2) / F.lit(chunk)).cast("bigint")
    k = g.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return k.select(
        "ep",
        "i",
        "k",
        (F.col("a") + F.col("k") * chunk).alias("w0"),
        F.least(F.col("b"), F.col("a") + (F.col("k") + 1) * chunk).alias("w1"),
    ).where(F.col("w1") - F.col("w0") >= min_gap)


def cut_candidates(words: DataFrame, least: int = CUT_GAP, strong: int = STRONG_GAP) -> DataFrame:
    """Words that follow a silence of ``least`` or more: ``ep, i, gap, strong``."""
    return words.select(
        "ep", "i", (F.col("s") - F.lag("e").over(_w())).alias("gap")
    ).where(F.col("gap") >= least).withColumn("strong", F.col("gap") >= strong)


def runs(rows: DataFrame, owner: str, *order: str) -> DataFrame:
    """Adds ``run``, the number of each stretch of consecutive rows with one owner; null equals null."""
    w = _w(*order)
    change = F.when(F.lag(F.lit(1)).over(w).isNull() | ~F.lag(owner).over(w).eqNullSafe(F.col(owner)), 1).otherwise(0)
    return rows.withColumn("_change", change).withColumn(
        "run", F.sum("_change").over(w.rowsBetween(W.unboundedPreceding, 0))
    ).drop("_change")


def ordered_text(text: Column | str, *order: Column | str, sep: str = "") -> Column:
    """Aggregate: texts joined in order."""
    struct = F.struct(
        *[F.col(c) if isinstance(c, str) else c for c in order], (F.col(text) if isinstance(text, str) else text).alias("_text")
    )
    return F.array_join(F.transform(F.array_sort(F.collect_list(struct)), lambda x: x["_text"]), sep)


def run_cues(rows: DataFrame, owner: str, text: str = "text") -> DataFrame:
    """One row a run: ``ep, run, owner, n, s, e, text``."""
    return runs(rows, owner).groupBy("ep", "run").agg(
        F.first(owner).alias("owner"), F.count("*").alias("n"), F.min("s").alias("s"), F.max_by("e", F.struct("s", "i")).alias("e"), ordered_text(text, "s", "i").alias("text")
    )


def merge_same_interval(cues: DataFrame, grain: int = 1000) -> DataFrame:
    """Cues with equal start and end become one, texts in order of the unrounded starts: ``ep, s, e, text``.

    Times are equal, and come out, rounded to ``grain`` microseconds; halves go to the even multiple.
    """
    key = lambda c: (F.rint(F.col(c) / F.lit(grain)).cast("bigint") * grain).alias(f"_{c}")
    merged = cues.select("ep", "i", "s", "text", key("s"), key("e")).groupBy("ep", "_s", "_e").agg(
        ordered_text("text", "s", "i").alias("text")
    )
    return merged.select("ep", F.col("_s").alias("s"), F.col("_e").alias("e"), "text")


def display_clamp(cues: DataFrame, lead_in: int = LEAD_IN, min_show: int = MIN_SHOW, between: int = BETWEEN) -> DataFrame:
    """Times of display: a little early, a least time long, gone before the next. Replaces ``s, e``."""
    x = cues.withColumn("_i", F.col("i")).withColumn("_raw", F.col("s")).withColumn(
        "s", F.greatest(F.lit(0).cast("bigint"), F.col("s") - lead_in)
    )
    x = x.withColumn("e", F.greatest(F.col("s") + min_show, F.col("e")))
    nxt = F.lead("s").over(W.partitionBy("ep").orderBy("_raw", "_i")) - between
    x = x.withColumn("_n", nxt)
    end = F.when(F.col("_n").isNull(), F.greatest(F.col("e"), F.col("s") + min_show)).otherwise(
        F.greatest(F.least(F.col("e"), F.col("_n")), F.least(F.col("s") + min_show, F.col("_n")))
    )
    return x.withColumn("e", end).drop("_n", "_i", "_raw")


def monotone_repair(spans: DataFrame) -> DataFrame:
    """Starts never before the previous end, ends never before their start. Replaces ``s, e``; order is ``i``."""
    w = _w("i")
    top = F.max(F.greatest("s", "e")).over(w.rowsBetween(W.unboundedPreceding, 0))
    x = spans.withColumn("_e", top)
    return x.withColumn("s", F.greatest(F.col("s"), F.coalesce(F.lag("_e").over(w), F.col("s")))).withColumn("e", F.col("_e")).drop("_e")


def sequential_clamp(cues: DataFrame, between: int = BETWEEN, least: int = CLAMP_MIN) -> DataFrame:
    """No two cues at once: each start waits for the previous *changed* end, each end yields to the next start.

    ``ep, i, s, e``. The previous change feeds the next row, so an episode is one pass in one task.
    """

    def run(t: pa.Table) -> pa.Table:
        ep, i, s, e = (t[c].to_numpy() for c in ("ep", "i", "s", "e"))
        order = np.lexsort((i, s))
        s, e = s[order].copy(), e[order].copy()
        raw = s.copy()
        for k in range(len(s)):
            if k and s[k] < e[k - 1] + between:
                s[k] = e[k - 1] + between
            if k + 1 < len(s) and e[k] > raw[k + 1] - between:
                e[k] = max(s[k] + least, raw[k + 1] - between)
        return pa.table({"ep": ep[order], "i": i[order], "s": s, "e": e})

    return cues.select("ep", "i", "s", "e").groupBy("ep").applyInArrow(run, "ep long, i long, s long, e long")


def joined_words(first: int, last: int, *order: str, text: str = "text") -> Column:
    """Texts of the rows from ``first`` to ``last`` places after a row, as one text."""
    return F.array_join(F.collect_list(text).over(_w(*order).rowsBetween(first, last)), "")


def context_strings(words: DataFrame, before: int = 12, after: int = 6, tail: int = 2) -> DataFrame:
    """``ep, i, prev, next, last``: texts of the words before, from this one on, and up to this one."""
    return words.select(
        "ep", "i", joined_words(-before, -1).alias("prev"), joined_words(0, after - 1).alias("next"), joined_words(-tail + 1, 0).alias("last")
    )


def prefix_sums(words: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the running sum of ``value``."""
    return words.withColumn(name, F.sum(value).over(_w().rowsBetween(W.unboundedPreceding, 0)))


def following(rows: DataFrame, keys: list[str], order: str, bucket_rows: int = 1 << 20) -> DataFrame:
    """Adds ``next``: the next greater ``order`` (a whole number, unique in its key) among the rows of the same keys.

    A key may hold any share of the rows: it is cut into ranges of ``order``, ordered range by range, and only the least
    number of each range is ordered over a whole key.
    """
    lo, hi, n = rows.agg(F.min(order), F.max(order), F.count("*")).first()
    ranges = max(1, -(-n // bucket_rows))
    width = max(1, -(-((hi or 0) - (lo or 0) + 1) // ranges))
    x = rows.withColumn("_range", F.floor((F.col(order) - F.lit(lo or 0)) / F.lit(width)).cast("bigint"))
    inside = x.withColumn("next", F.lead(order).over(W.partitionBy(*keys, "_range").orderBy(order)))
    firsts = x.groupBy(*keys, "_range").agg(F.min(order).alias("_first"))
    firsts = firsts.withColumn("_later", F.lead("_first").over(W.partitionBy(*keys).orderBy("_range"))).drop("_first")
    same = reduce(and_, [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in [*keys, "_range"]])
    joined = inside.join(firsts.withColumnsRenamed({c: f"_{c}" for c in [*keys, "_range"]}), same)
    return joined.select(*rows.columns, F.coalesce("next", "_later").alias("next"))


def normalise_words(segments: DataFrame, least: int = 50_000) -> DataFrame:
    """segments ``ep, seg_i, s, e, text, words array<struct<ws,we,w>>`` -> ``ep, seg_i, w_i, s, e, text``.

    Reversed ends are swapped, a word lasts ``least`` at least, a segment without words is one word if it has text.
    """
    some = F.size(F.coalesce("words", F.array())) > 0
    own = F.array(F.struct(F.col("s").alias("ws"), F.col("e").alias("we"), F.col("text").alias("w")))
    flat = segments.where(some | (F.length("text") > 0)).select(
        "ep", "seg_i", some.alias("_some"), F.posexplode(F.when(some, F.col("words")).otherwise(own)).alias("w_i", "x")
    )
    lo = F.when(F.col("_some"), F.least("x.ws", "x.we")).otherwise(F.col("x.ws"))
    hi = F.when(F.col("_some"), F.greatest("x.ws", "x.we")).otherwise(F.col("x.we"))
    return flat.select("ep", "seg_i", "w_i", lo.alias("s"), F.greatest(hi, lo + least).alias("e"), F.col("x.w").alias("text"))


def repair_reversed(cues: DataFrame, least: int = 300_000) -> DataFrame:
    """Empty or reversed cues last ``least``. Replaces ``e``."""
    return cues.withColumn("e", F.when(F.col("e") <= F.col("s"), F.col("s") + least).otherwise(F.col("e")))


def cap_times(cues: DataFrame, cap: Column) -> DataFrame:
    """Both ends are cut at ``cap`` (null or 0: none), which may leave empty cues. Replaces ``s, e``."""
    top = F.nullif(cap, F.lit(0))
    return cues.withColumns({"s": F.least("s", top), "e": F.least("e", top)})


def repair_and_cap(cues: DataFrame, cap: Column, least: int = 300_000) -> DataFrame:
    """Empty or reversed cues last ``least``; both ends are cut at ``cap`` (null or 0: none)."""
    return cap_times(repair_reversed(cues, least), cap)


def qa_stats(cues: DataFrame, fast: int = FAST_CHARS) -> DataFrame:
    """``ep, n, covered, cram``: rows, summed duration, rows read faster than ``fast`` characters a second."""
    d = F.col("e") - F.col("s")
    return cues.groupBy("ep").agg(
        F.count("*").alias("n"), F.sum(d).alias("covered"), F.count_if((d > 0) & (F.length("text") * 1_000_000 > d * fast)).alias("cram")
    )
