"""Operators on file, stream, track and settings tables: picks, plans, checks, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.operators.sequence import ordered_text

# Language tags.
JAPANESE = ["jpn", "ja"]
CHINESE = ["chi", "zh", "chs", "cht", "zh-cn", "zh-tw", "zh-hans", "zh-hant"]


def preferred(rows: DataFrame, key: str, order: str, wanted: Column) -> DataFrame:
    """One row a key: the first that is ``wanted``, else the first; ``fallback`` tells which. All columns of the row."""
    rest = [c for c in rows.columns if c != key]
    best = F.min(F.struct((~F.coalesce(wanted, F.lit(False))).alias("fallback"), F.col(order).alias("_o"), F.struct(*rest).alias("row")))
    return rows.groupBy(key).agg(best.alias("b")).select(key, "b.row.*", "b.fallback")


def pending(files: DataFrame, streams: DataFrame, key: str = "path") -> DataFrame:
    """Files without a Japanese subtitle stream; a file that could not be probed has no streams and is pending."""
    done = streams.where((F.col("codec_type") == "subtitle") & F.lower("language").isin(JAPANESE))
    return files.join(done, key, "left_anti")


def reference_timeline(streams: DataFrame, intervals: DataFrame) -> DataFrame:
    """``path, language, fallback, n, max_end`` of the subtitle stream that gives the reference times: a Chinese one, else the first.

    intervals ``path, index, s, e`` are the time lines of every subtitle stream; a path without any ends at 0.
    """
    pick = preferred(
        streams.where(F.col("codec_type") == "subtitle").select("path", "index", "language"),
        "path",
        "index",
        F.lower("language").isin(CHINESE),
    )
    ends = intervals.groupBy("path", "index").agg(F.count("*").alias("n"), F.max("e").alias("max_end"))
    x = pick.join(ends, ["path", "index"], "left")
    return x.select("path", "language", "fallback", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("max_end", F.lit(0)).alias("max_end"))


def first_track(tracks: DataFrame, streams: DataFrame, languages: list[str]) -> DataFrame:
    """``path, track_id`` of the first track, in container order, whose stream has one of the languages.

    tracks ``path, pos, track_id`` and streams ``path, pos, language`` are matched by position.
    """
    return tracks.join(streams, ["path", "pos"]).where(F.lower("language").isin(languages)).groupBy("path").agg(
        F.min_by("track_id", "pos").alias("track_id")
    )


def layered(settings: DataFrame, keys: list[str], layer: str = "layer", value: str = "value") -> DataFrame:
    """The value of the highest layer of each key."""
    return settings.groupBy(*keys).agg(F.max_by(value, layer).alias(value), F.max(layer).alias(layer))


def resolve_tool(tools: DataFrame) -> DataFrame:
    """``tool, env, env_ok, conf, conf_ok, path, bundled`` -> ``tool, found, origin``; a set env value hides the rest, valid or not."""
    origin = (
        F.when(
            F.col("env").isNotNull(), F.when(F.col("env_ok"), F.lit("env"))
        ).when(F.col("conf_ok"), F.lit("config")).when(F.col("path").isNotNull(), F.lit("path")).when(F.col("bundled").isNotNull(), F.lit("bundled"))
    )
    x = tools.withColumn("origin", origin)
    return x.select(
        "tool",
        F.when(F.col("origin") == "env", F.col("env")).when(F.col("origin") == "config", F.col("conf")).when(F.col("origin") == "path", F.col("path")).when(
            F.col("origin") == "bundled", F.col("bundled")
        ).alias("found"),
        "origin",
    )


def track_plan(tracks: DataFrame, new_id: Column) -> DataFrame:
    """``path, kind, track_id`` -> ``path, track_order``: other kinds, the new one, the old subtitles."""
    rank = F.when(F.col("kind") == "subtitles", 2).otherwise(0)
    x = tracks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "track_id"))).alias("t"))
    part = lambda r: F.transform(F.filter("t", lambda y: y["r"] == r), lambda y: y["track_id"].cast("string"))
    return x.select("path", F.array_join(F.concat(part(0), F.array(new_id.cast("string")), part(2)), ",").alias("track_order"))


def keep_list(japanese: Column, chinese: Column) -> Column:
    """The tracks to keep, at most two."""
    return F.array_compact(F.array(japanese, chinese))


def problems(*checks: tuple[Column, str]) -> Column:
    """Names of the checks that fail (false or null), joined by ``;``; empty if all pass."""
    return F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in checks])), ";")


def verify_mux(before: DataFrame, after: DataFrame, extra: int = 0, order: tuple[str, ...] = ("index",)) -> DataFrame:
    """Streams before and after, by path: same audio and video in order, attachments kept, a Japanese subtitle first and at most two.

    ``order`` names the columns that order a path's streams, nulls last; more than one where an index may repeat.
    """
    at = [c for o in order for c in (F.col(o).isNull().alias(f"no_{o}"), F.col(o))]

    def signature(s: DataFrame, tag: str) -> DataFrame:
        pick = lambda cond, what: F.array_sort(F.collect_list(F.when(cond, F.struct(*at, what))))
        subs = pick(F.col("codec_type") == "subtitle", F.struct(F.lower("language").alias("l"), "title").alias("x"))
        return s.groupBy("path").agg(
            pick(
                F.col("codec_type").isin("audio", "video"), F.concat_ws(":", "codec_type", "codec_name").alias("x")
            ).alias(f"{tag}_av"), F.count_if(F.col("codec_type") == "attachment").alias(f"{tag}_att"), subs.alias(f"{tag}_subs")
        )

    x = signature(before, "old").join(signature(after, "new"), "path", "left")
    names = lambda c: F.transform(c, lambda y: y["x"])
    first = F.get("new_subs", 0)["x"]
    japanese = F.exists("new_subs", lambda y: y["x"]["l"].isin(JAPANESE))
    return x.select(
        "path",
        problems(
            (names("old_av").eqNullSafe(names("new_av")), "streams"), (F.col("new_att") == F.col("old_att") + extra, "attachments"), (
                first["l"].isin(JAPANESE) & (first["title"] == "Japanese"), "first subtitle"
            ),
            (F.size("new_subs") <= 2, "too many subtitles"), (japanese, "no Japanese subtitle"),
        ).alias("problems"),
    )


def missing(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return required.join(present, key, "left_anti")


def run_summary(results: DataFrame, status: str, amount: Column) -> DataFrame:
    """``status, n, total, mean``."""
    return results.groupBy(status).agg(F.count("*").alias("n"), F.sum(amount).alias("total"), (F.sum(amount) / F.count("*")).alias("mean"))


def top_keys(rows: DataFrame, group: list[str], key: str, order: list[str], most: int = 40) -> DataFrame:
    """The ``most`` commonest keys of each group, of equals the first seen: ``group, key, n, first, rank``."""
    from pyspark.sql import Window as W

    n = rows.groupBy(*group, key).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    w = W.partitionBy(*group).orderBy(F.desc("n"), "first", key)
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def most_common(rows: DataFrame, key: str, order: list[str], most: int = 40) -> DataFrame:
    """``key, n`` of the ``most`` commonest keys of all rows, of equals the first seen; a report, kept by every task's own best."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    return n.orderBy(F.desc("n"), "first").limit(most).select(key, "n")


def candidates(tokens: DataFrame, most: int = 40, least_chars: int = 2) -> DataFrame:
    """Proper nouns with kanji, by folder: ``folder, surface, reading, n, rank``. tokens ``folder, pos, surface, part_of_speech, reading``."""
    from cuelake.functions.text import KANJI, to_hira

    ok = tokens.where(F.col("part_of_speech").startswith("名詞,固有名詞") & (F.length("surface") >= least_chars) & F.col("surface").rlike(KANJI))
    read = F.when(F.coalesce("reading", F.lit("")).isin("", "*"), F.lit("?")).otherwise(to_hira(F.col("reading")))
    first = ok.groupBy("folder", "surface").agg(F.min_by(read, "pos").alias("reading"))
    return top_keys(ok, ["folder"], "surface", ["pos"], most).join(first, ["folder", "surface"]).select(
        "folder", "surface", "reading", "n", "rank"
    )


# Lines that part a dictionary file, and the notes in it.
CANDIDATE_MARK = "# ==== 候选（脚本自动生成，每次运行重写这一段）===="
OWN_MARK = "# ==== 我的词典（你自己写，脚本不会动这一段）===="
DICTIONARY_HEAD = [
    "# furigana_dict.txt —— 日语注音用的人名/专有名词读音表",
    "# 用法：一行一条，左边写字幕里原样的字，右边写平假名读音，中间用 Tab 隔开。",
    "#   例：小玉<Tab>たま",
    "# 片假名不用写（片假名会自动转写成平假名，100% 准）；# 开头的行都是注释，不生效。",
    "# 改完直接跑流水线就行，词典每次运行都会重新读。",
]
CANDIDATE_NOTES = [
    "# 下面是从本片字幕里挑出的含汉字固有名詞（括号里是字典给的读音，可能是错的）。",
    "# 核对后把行首的 # 去掉、把读音改对，它就成了生效条目；排在前面的是出现次数多的。",
]
NO_CANDIDATES = "# （本次没挑到含汉字的固有名詞）"


def dictionary_update(found: DataFrame, defined: DataFrame) -> DataFrame:
    """Candidate section of each folder's dictionary, without what the dictionary defines: ``folder, n, section``."""
    open_ = found.join(defined, ["folder", "surface"], "left_anti")
    line = F.concat(F.lit("#"), "surface", F.lit("\t"), "reading", F.lit("\t出现 "), F.col("n").cast("string"), F.lit(" 次"))
    return open_.groupBy("folder").agg(F.count("*").alias("n"), ordered_text(line, "rank", sep="\n").alias("section"))


def dictionary_files(files: DataFrame, found: DataFrame) -> DataFrame:
    """Dictionary files ``folder, body`` (null: none yet) with fresh candidates: ``folder, n, body, changed``.

    What precedes the mark of the candidates stays as the user wrote it; candidates that it defines are left out; only
    rows that ``changed`` need be written. found: ``folder, surface, reading, n, rank``.
    """
    from cuelake.sources.texts import dictionary, lines_of

    fresh = "\n".join([*DICTIONARY_HEAD, "", OWN_MARK, ""])
    own = F.concat(F.regexp_replace(F.substring_index("body", CANDIDATE_MARK, 1), r"(?U)\s+$", ""), F.lit("\n"))
    kept = files.withColumn("keep", F.when(F.col("body").isNull(), F.lit(fresh)).otherwise(own))
    defined = dictionary(lines_of(kept, "folder", "keep")).select(F.col("file").alias("folder"), "surface")
    x = kept.join(dictionary_update(found, defined), "folder", "left")
    section = F.concat_ws("\n", F.lit(CANDIDATE_MARK), *map(F.lit, CANDIDATE_NOTES), F.coalesce("section", F.lit(NO_CANDIDATES)))
    new = F.concat("keep", F.lit("\n"), section, F.lit("\n"))
    return x.select("folder", F.coalesce("n", F.lit(0)).alias("n"), new.alias("new"), "body").select(
        "folder", "n", F.col("new").alias("body"), (~F.col("body").eqNullSafe(F.col("new"))).alias("changed")
    )


def tag_plan(tracks: DataFrame) -> DataFrame:
    """Edits of a new container ``path, pos, kind, track_id, language``: ``path, track, property, value``.

    The first subtitle is the new one: Japanese, named and default; the first Chinese one is default no longer. Tracks
    count from 1 in an edit.
    """
    subs = tracks.where(F.col("kind") == "subtitles")
    chinese = F.min_by("track_id", F.when(F.lower("language").isin(CHINESE), F.col("pos"))).alias("chinese")
    picked = subs.groupBy("path").agg(F.min_by("track_id", "pos").alias("new"), chinese)
    edit = lambda track, name, value: F.struct((track + 1).alias("track"), F.lit(name).alias("property"), F.lit(value).alias("value"))
    edits = [("language", "jpn"), ("name", "Japanese"), ("flag-default", "yes")]
    new = F.array(*[edit(F.col("new"), name, value) for name, value in edits])
    old = F.when(F.col("chinese").isNotNull(), F.array(edit(F.col("chinese"), "flag-default", "no")))
    both = F.when(F.col("chinese").isNotNull(), F.concat(new, old)).otherwise(new)
    return picked.select("path", F.explode(both).alias("e")).select("path", "e.*")


def review_flags(cues: DataFrame, longest: int = 8_000_000, most_chars: int = 24) -> DataFrame:
    """``ep, i, too_long, too_wide`` of cues to look at."""
    x = cues.select("ep", "i", (F.col("e") - F.col("s") > longest).alias("too_long"), (F.length("text") > most_chars).alias("too_wide"))
    return x.where("too_long OR too_wide")


def grammar_flags(cues: DataFrame, bad_start, ends_with_starter) -> DataFrame:
    """``ep, i, particle_start, starter_end`` of cues that break a rule on their first or last word."""
    from cuelake.functions.grammar import by_fragment

    x = cues.select("ep", "i", F.left("text", F.lit(4)).alias("_head"), F.right("text", F.lit(8)).alias("_tail"))
    judge = lambda head, tail: (bad_start(head), ends_with_starter(tail))
    x = by_fragment(x, ["_head", "_tail"], "_judged", judge, "particle_start boolean, starter_end boolean")
    return x.select("ep", "i", "_judged.*").where("particle_start OR starter_end")


def silence_inside(cues: DataFrame, pauses: DataFrame, least: int = 1_500_000, bucket_us: int = 3_600_000_000) -> DataFrame:
    """Cues that hold a whole long pause."""
    from cuelake.operators.intervals import overlap_join

    long = pauses.where(F.col("pb") - F.col("pa") >= least)
    hit = overlap_join(
        cues.select("ep", "i", "s", "e"), long, (F.col("s"), F.col("e")), (F.col("pa"), F.col("pb")), bucket_us=bucket_us
    ).where("s <= pa AND pb <= e")
    return cues.join(hit.select("ep", "i").distinct(), ["ep", "i"], "left_semi")


def mark_score(marks: DataFrame, seams: DataFrame, slack: int = 1) -> DataFrame:
    """marks ``ep, seam, kind`` (merge: no cut there; split: a cut within ``slack``), seams ``ep, cut``: adds ``passed``."""
    near = seams.select(
        "ep", F.explode(F.sequence(F.col("cut") - slack, F.col("cut") + slack)).alias("seam"), (F.lit(0)).alias("_x"), "cut"
    )
    hit = near.groupBy("ep", "seam").agg(F.bool_or(F.col("cut") == F.col("seam")).alias("exact"))
    x = marks.join(hit, ["ep", "seam"], "left")
    return x.withColumn(
        "passed", F.when(F.col("kind") == "merge", ~F.coalesce("exact", F.lit(False))).otherwise(F.col("exact").isNotNull())
    ).drop("exact")
