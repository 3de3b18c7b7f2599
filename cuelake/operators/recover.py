"""A second pass over missed regions: what was heard there is matched with the cues that exist and added where new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.functions.text import overlap_ratio, strip_punct
from cuelake.operators.intervals import HOUR, max_overlap, near_speech, neighbour_text
from cuelake.operators.sequence import gap_windows, sequential_clamp

MIN_CHARS, SAME_TEXT = 2, 0.5
SILENT_RMS = 0.004


def recovery_windows(cues: DataFrame, spans: DataFrame, bucket_us: int = HOUR, **gap) -> DataFrame:
    """Gap chunks near speech: ``ep, i, s, e``."""
    w = gap_windows(cues, **gap).select(
        "ep",
        F.row_number().over(W.partitionBy("ep").orderBy("w0")).cast("bigint").alias("i"),
        F.col("w0").alias("s"),
        F.col("w1").alias("e"),
    )
    return near_speech(w, spans, bucket_us=bucket_us)


def new_cues(recovered: DataFrame, base: DataFrame, around: int = 2_000_000, bucket_us: int = HOUR) -> DataFrame:
    """Recovered rows ``ep, i, s, e, text`` that say something new; base ``ep, j, bs, be, text``.

    Too short texts go, then those whose time an existing cue covers, then those whose text the neighbourhood has.
    Only the base as it came is compared, so the result doesn't depend on an order.
    """
    long = recovered.where(F.length(strip_punct(F.col("text"))) >= MIN_CHARS)
    free = long.join(max_overlap(long, base, bucket_us=bucket_us).select("ep", "i"), ["ep", "i"], "left_anti")
    near = neighbour_text(free, base, around, bucket_us)
    return near.where(overlap_ratio(F.col("text"), F.col("near_text")) < SAME_TEXT).drop("near_text")


def extensions(recovered: DataFrame, base: DataFrame, bucket_us: int = HOUR) -> DataFrame:
    """``ep, j, i, s, e, longer``: heard rows that say more than the cue ``j`` that covers most of their time.

    The heard text is longer without punctuation, does not lie within the cue's, and has half of its character pairs.
    Every row is compared with the cue as it came; rows of less than ``MIN_CHARS`` characters are not looked at.
    """
    long = recovered.where(F.length(strip_punct(F.col("text"))) >= MIN_CHARS)
    hit = long.join(max_overlap(long, base, bucket_us=bucket_us).select("ep", "i", "match"), ["ep", "i"])
    both = hit.select(
        "ep", F.col("match").alias("j"), "i", "s", "e", F.col("text").alias("longer")
    ).join(base.select("ep", "j", "text"), ["ep", "j"])
    said, bare = strip_punct(F.col("longer")), strip_punct(F.col("text"))
    more = ~F.contains(bare, said) & (F.length(said) > F.length(bare)) & (overlap_ratio(F.col("text"), F.col("longer")) >= SAME_TEXT)
    return both.where(more).drop("text")


def recover(
    recovered: DataFrame, base: DataFrame, around: int = 2_000_000, bucket_us: int = HOUR, apply_extensions: bool = False
) -> DataFrame:
    """All cues, old and new, without overlaps: ``ep, i, s, e, text``; i counts by start.

    ``apply_extensions``: cues of which a longer text was heard take the longest, and reach over its time; else they are
    counted by ``report`` only.
    """
    added = new_cues(recovered, base, around, bucket_us)
    if apply_extensions:
        most = F.max_by("longer", F.struct(F.length("longer"), -F.col("s"), -F.col("i"))).alias("longer")
        grown = extensions(recovered, base, bucket_us).groupBy("ep", "j").agg(most, F.min("s").alias("_s"), F.max("e").alias("_e"))
        reach = {"text": F.coalesce("longer", "text"), "bs": F.least("bs", "_s"), "be": F.greatest("be", "_e")}
        base = base.join(grown, ["ep", "j"], "left").withColumns(reach).drop("longer", "_s", "_e")
    old = base.select("ep", F.lit(0).alias("src"), F.col("j").alias("k"), F.col("bs").alias("s"), F.col("be").alias("e"), "text")
    both = old.unionByName(added.select("ep", F.lit(1).alias("src"), F.col("i").alias("k"), "s", "e", "text"))
    numbered = both.withColumn("i", F.row_number().over(W.partitionBy("ep").orderBy("s", "src", "k")).cast("bigint"))
    times = sequential_clamp(numbered)
    return numbered.select("ep", "i", "text").join(times, ["ep", "i"]).select("ep", "i", "s", "e", "text")


def report(windows: DataFrame, recovered: DataFrame, base: DataFrame, around: int = 2_000_000, bucket_us: int = HOUR) -> DataFrame:
    """``ep, windows, added, extended``: windows looked at, cues that came of them, cues of which a longer text was heard."""
    counted = lambda df, name: df.groupBy("ep").agg(F.count("*").alias(name))
    parts = [
        counted(windows, "windows"),
        counted(new_cues(recovered, base, around, bucket_us), "added"),
        counted(extensions(recovered, base, bucket_us), "extended"),
    ]
    x = parts[0].join(parts[1], "ep", "full").join(parts[2], "ep", "full")
    return x.select("ep", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("windows", "added", "extended")])


def silent_windows(samples: DataFrame, rms: float = SILENT_RMS) -> DataFrame:
    """samples ``ep, i, x``: the windows whose root mean square is below ``rms``: ``ep, i, n``."""
    return samples.groupBy("ep", "i").agg(
        F.count("*").alias("n"), F.sum(F.col("x") * F.col("x")).alias("power")
    ).where(F.col("power") < F.lit(rms) * F.lit(rms) * F.col("n")).select("ep", "i", "n")
