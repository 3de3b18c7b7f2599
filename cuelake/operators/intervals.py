"""Joins of points and intervals inside one episode.

Times are microseconds (bigint). Every join has the episode and a time bucket as equality keys, so Spark plans a sort
merge or hash join with a residual instead of a product: both sides list the buckets they touch, and a pair is kept only
in the first bucket that both touch, which makes it appear once without a distinct. ``bucket_us`` should be about the
usual interval length. An interval over more than ``MOST_BUCKETS`` buckets is listed by buckets ``COARSE`` times as long
instead, and meets short ones there; so no interval, however long, becomes many rows, and short ones never meet each other
in a long bucket. Ties are decided by ordinals inside a struct, so results don't depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR = 3_600_000_000
MOST_BUCKETS, COARSE = 64, 4096
# Microseconds, and a share.
GAP_TOLERANCE = 600_000
SNAP_TOLERANCE = 600_000
KEEP_SLICE = 20_000
NEAR_SPEECH, NEAR_OVERLAP = 3_000_000, 150_000
MATCH_RATIO, NEIGHBOURHOOD = 0.6, 2_000_000


def _bucket(us: Column, bucket_us: int) -> Column:
    return F.floor(us / F.lit(bucket_us)).cast("bigint")


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    left_span: tuple[Column, Column],
    right_span: tuple[Column, Column],
    ep: str = "ep",
    bucket_us: int = HOUR,
) -> DataFrame:
    """Pairs of one episode whose closed spans meet. Column names of the sides must differ, but for ``ep``."""
    a, b = left.withColumns({"_lo": left_span[0], "_hi": left_span[1]}), right.withColumns({"_rlo": right_span[0], "_rhi": right_span[1]})
    # 0: short with short; 1: a long left with any right; 2: a short left with a long right
    a = _listed(a, F.col("_lo"), F.col("_hi"), bucket_us, (0, 2), (1,))
    b = _listed(b, F.col("_rlo"), F.col("_rhi"), bucket_us, (0, 1), (1, 2))
    width = F.when(F.col("_role") == 0, F.lit(bucket_us)).otherwise(F.lit(bucket_us * COARSE))
    first = F.floor(F.greatest("_lo", "_rlo") / width).cast("bigint")
    return (
        a.join(b, [ep, "_role", "_at"])
        .where((F.col("_lo") <= F.col("_rhi")) & (F.col("_rlo") <= F.col("_hi")) & (F.col("_at") == first))
        .drop("_lo", "_hi", "_rlo", "_rhi", "_role", "_at")
    )


def _listed(rows: DataFrame, lo: Column, hi: Column, bucket_us: int, short: tuple[int, int], long: tuple[int, ...]) -> DataFrame:
    """A row for each bucket that ``lo .. hi`` touches, as ``_role, _at``: fine ones for the first role of a short
    interval, coarse ones for all others."""

    def places(width: int, role: int) -> Column:
        upto = F.sequence(_bucket(lo, width), F.greatest(_bucket(hi, width), _bucket(lo, width)))
        return F.transform(upto, lambda at: F.struct(F.lit(role).alias("role"), at.alias("at")))

    coarse = bucket_us * COARSE
    many = _bucket(hi, bucket_us) - _bucket(lo, bucket_us) >= MOST_BUCKETS
    of_long = F.concat(*[places(coarse, r) for r in long]) if len(long) > 1 else places(coarse, long[0])
    listed = rows.withColumn(
        "_b", F.explode(F.when(many, of_long).otherwise(F.concat(places(bucket_us, short[0]), places(coarse, short[1]))))
    )
    return listed.withColumns({"_role": F.col("_b.role"), "_at": F.col("_b.at")}).drop("_b")  # plain keys sort fast


def assign_intervals(words: DataFrame, intervals: DataFrame, tolerance: int = GAP_TOLERANCE, bucket_us: int = HOUR) -> DataFrame:
    """words ``ep, i, s, e`` and intervals ``ep, j, cs, ce``: adds ``owner`` (j or null) to each word.

    The word's middle decides: of the intervals that hold it the one with the nearest centre, else the one with the
    nearest edge within ``tolerance``; ties go to the lowest j. Distances are doubled to stay whole numbers.
    """
    double = F.col("s") + F.col("e")
    reach = (F.floor(double / 2) - tolerance - 1, F.ceil(double / 2) + tolerance + 1)
    inside = (2 * F.col("cs") <= double) & (double <= 2 * F.col("ce"))
    edge = F.when(double < 2 * F.col("cs"), 2 * F.col("cs") - double).otherwise(double - 2 * F.col("ce"))
    distance = F.when(inside, F.abs(double - F.col("cs") - F.col("ce"))).otherwise(edge)
    pairs = overlap_join(words.select("ep", "i", "s", "e"), intervals, reach, (F.col("cs"), F.col("ce")), bucket_us=bucket_us)
    best = (
        pairs.where(inside | (edge <= 2 * tolerance))
        .groupBy("ep", "i")
        .agg(F.min(F.struct((~inside).alias("tier"), distance.alias("distance"), F.col("j"))).alias("best"))
        .select("ep", "i", F.col("best.j").alias("owner"))
    )
    return words.join(best, ["ep", "i"], "left")


def nearest_pause(points: DataFrame, pauses: DataFrame, tolerance: int = SNAP_TOLERANCE, bucket_us: int = HOUR) -> DataFrame:
    """points ``ep, i, t`` and pauses ``ep, j, pa, pb``: adds ``pause`` (j), ``pa``, ``pb``; nulls if none is near.

    Inside a pause the distance is 0, else to the nearer end; of equal distances the last pause.
    """
    t = F.col("t")
    d = F.when((F.col("pa") <= t) & (t <= F.col("pb")), F.lit(0)).otherwise(F.least(F.abs(t - F.col("pa")), F.abs(t - F.col("pb"))))
    pairs = overlap_join(
        points.select("ep", "i", "t"), pauses, (t - tolerance, t + tolerance), (F.col("pa"), F.col("pb")), bucket_us=bucket_us
    )
    best = (
        pairs.where(d <= tolerance)
        .groupBy("ep", "i")
        .agg(F.min(F.struct(d.alias("d"), (-F.col("j")).alias("last"), "pa", "pb")).alias("best"))
        .select("ep", "i", (-F.col("best.last")).alias("pause"), "best.pa", "best.pb")
    )
    return points.join(best, ["ep", "i"], "left")


def intersect_spans(windows: DataFrame, spans: DataFrame, least: int = KEEP_SLICE, bucket_us: int = HOUR) -> DataFrame:
    """windows ``ep, i, s, e`` and spans ``ep, j, a, b``: ``ep, i, j, lo, hi`` of each common stretch over ``least``."""
    pairs = overlap_join(
        windows.select("ep", "i", "s", "e"), spans, (F.col("s"), F.col("e")), (F.col("a"), F.col("b")), bucket_us=bucket_us
    )
    return pairs.select(
        "ep", "i", "j", F.greatest("s", "a").alias("lo"), F.least("e", "b").alias("hi")
    ).where(F.col("hi") - F.col("lo") > least)


def near_speech(
    windows: DataFrame, spans: DataFrame, near: int = NEAR_SPEECH, least: int = NEAR_OVERLAP, bucket_us: int = HOUR
) -> DataFrame:
    """Windows ``ep, i, s, e`` that, widened by ``near`` on both sides, share ``least`` with some span of their episode.

    An episode without spans keeps all its windows.
    """
    wide = (F.col("s") - near, F.col("e") + near)
    shared = F.least(wide[1], F.col("b")) - F.greatest(wide[0], F.col("a"))
    hit = overlap_join(
        windows.select("ep", "i", "s", "e"), spans, wide, (F.col("a"), F.col("b")), bucket_us=bucket_us
    ).where(shared >= least).select("ep", "i").distinct()
    heard = windows.join(hit, ["ep", "i"], "left_semi")
    return heard.unionByName(windows.join(spans.select("ep").distinct(), "ep", "left_anti"))


def max_overlap(new: DataFrame, base: DataFrame, ratio: float = MATCH_RATIO, bucket_us: int = HOUR) -> DataFrame:
    """new ``ep, i, s, e`` and base ``ep, j, bs, be``: ``ep, i, match, share`` where some row covers ``ratio`` of the new one.

    The greatest share wins, of equals the lowest j.
    """
    over = F.least("e", "be") - F.greatest("s", "bs")
    share = over / F.greatest(F.lit(10_000), F.col("e") - F.col("s"))
    pairs = overlap_join(
        new.select("ep", "i", "s", "e"),
        base.select("ep", "j", "bs", "be"),
        (F.col("s"), F.col("e")),
        (F.col("bs"), F.col("be")),
        bucket_us=bucket_us,
    )
    return (
        pairs.where(over > 0)
        .groupBy("ep", "i")
        .agg(F.min(F.struct((-share).alias("less"), "j")).alias("best"))
        .select("ep", "i", F.col("best.j").alias("match"), (-F.col("best.less")).alias("share"))
        .where(F.col("share") >= ratio)
    )


def neighbour_text(rows: DataFrame, base: DataFrame, around: int = NEIGHBOURHOOD, bucket_us: int = HOUR) -> DataFrame:
    """rows ``ep, i, s, e`` and base ``ep, j, bs, be, text``: adds ``near_text``, the texts within ``around``, in order of j."""
    pairs = overlap_join(
        rows.select("ep", "i", "s", "e"), base.select("ep", "j", "bs", "be", "text"), (
            F.col("s") - around, F.col("e") + around
        ), (F.col("bs"), F.col("be")), bucket_us=bucket_us
    ).where((F.col("be") > F.col("s") - around) & (F.col("bs") < F.col("e") + around))
    texts = pairs.groupBy("ep", "i").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "text"))), lambda x: x["text"]), "").alias("near_text")
    )
    return rows.join(texts, ["ep", "i"], "left").withColumn("near_text", F.coalesce("near_text", F.lit("")))
