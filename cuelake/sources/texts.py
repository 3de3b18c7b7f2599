"""Sources that are lines of text, and files found by name. Line tables are ``file, line_no, line`` (ordinals from 1)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.functions.text import one_line, strip

TIME = r"(\d+):(\d{2}):(\d{2})[,.](\d{1,3})\s*-->\s*(\d+):(\d{2}):(\d{2})[,.](\d{1,3})"


MEDIA = r"(?i)\.(mkv|mka)$"


def media_files(spark: SparkSession, root: str, pattern: str = "*.[mM][kK][vV]") -> DataFrame:
    """``path, folder, name, stem, suffix, bytes`` of files below ``root``, or of ``root`` itself if it is one ``.mkv`` or ``.mka``.

    Contents are never read; brackets in ``root`` are plain; files and folders that begin with ``.`` or ``_`` are hidden.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    one = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    for c in "[]{}*?":
        root = root.replace(c, f"\\{c}")
    scan = spark.read.format("binaryFile")
    f = scan.load(root) if one else scan.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return f.where(F.col("path").rlike(MEDIA) | F.lit(not one)).select(
        "path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
        F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("suffix"), F.col("length").alias("bytes"),
    )


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of whole text files, without a byte order mark."""
    body = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^﻿", "").alias("body")
    )
    return lines_of(body, "file", "body")


def lines_of(df: DataFrame, key: str, body: str) -> DataFrame:
    x = df.select(F.col(key).alias("file"), F.posexplode(F.split(body, "\r?\n")).alias("line_no", "line"))
    return x.withColumn("line_no", F.col("line_no") + 1)


def _us(line: Column, first: int) -> Column:
    g = lambda k: F.regexp_extract(line, TIME, first + k).cast("bigint")
    return (g(0) * 3600 + g(1) * 60 + g(2)) * 1_000_000 + g(3) * 1000


def srt_timeline(lines: DataFrame) -> DataFrame:
    """Every line with a time range: ``file, line_no, s, e``; the fraction is a number of milliseconds as it stands."""
    return lines.where(F.col("line").rlike(TIME)).select(
        "file", "line_no", _us(F.col("line"), 1).alias("s"), _us(F.col("line"), 5).alias("e")
    )


def srt_cues(lines: DataFrame) -> DataFrame:
    """``file, cue, s, e, text``. A time line opens a cue; lines that are blank or only digits are no text; the rest, stripped, is joined by blanks."""
    w = W.partitionBy("file").orderBy("line_no")
    is_time = F.col("line").rlike(TIME)
    x = lines.withColumn("cue", F.sum(is_time.cast("int")).over(w)).where("cue > 0")
    text = strip(F.col("line"))
    part = F.when(~is_time & (text != "") & ~text.rlike(r"^[0-9]+$"), F.struct("line_no", text.alias("t")))
    times = F.when(is_time, F.col("line"))
    out = x.groupBy("file", "cue").agg(
        F.max(times).alias("head"), F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["t"]), " ").alias("text")
    )
    return out.select("file", "cue", _us(F.col("head"), 1).alias("s"), _us(F.col("head"), 5).alias("e"), "text")


def ini_settings(lines: DataFrame) -> DataFrame:
    """``file, section, key, value``; keys lower-cased, values stripped, the last of a repeated key stands."""
    w = W.partitionBy("file").orderBy("line_no")
    line = strip(F.col("line"))
    head = F.regexp_extract(line, r"^\[(.+)\]$", 1)
    x = lines.select("file", "line_no", line.alias("line"), F.last(F.when(head != "", head), ignorenulls=True).over(w).alias("section"))
    pair = r"^([^=:\[#;][^=:]*)[=:](.*)$"
    x = x.where(F.col("section").isNotNull() & F.col("line").rlike(pair)).select(
        "file", "line_no", "section", F.lower(
            strip(F.regexp_extract("line", pair, 1))
        ).alias("key"), strip(F.regexp_extract("line", pair, 2)).alias("value")
    )
    return x.groupBy("file", "section", "key").agg(F.max_by("value", "line_no").alias("value"))


def dictionary(lines: DataFrame) -> DataFrame:
    """``file, surface, reading``: blank and ``#`` lines skipped, the first two parts kept, the last of a repeated surface stands."""
    line = strip(F.col("line"))
    parts = F.split(line, r"(?U)[\t,，\s]+", 3)
    x = lines.where((line != "") & ~line.startswith("#")).select(
        "file", "line_no", F.get(parts, 0).alias("surface"), F.get(parts, 1).alias("reading")
    )
    return x.where(
        (F.col("surface") != "") & (F.col("reading") != "")
    ).groupBy("file", "surface").agg(F.max_by("reading", "line_no").alias("reading"))


def mux_tracks(lines: DataFrame) -> DataFrame:
    """``file, pos, track_id, kind`` of the track lines of a mux tool."""
    rule = r"Track ID (\d+): (video|audio|subtitles)"
    return lines.where(F.col("line").rlike(rule)).select(
        "file", F.col("line_no").alias("pos"), F.regexp_extract("line", rule, 1).cast("int").alias("track_id"), F.regexp_extract("line", rule, 2).alias("kind")
    )


STREAM_SCHEMA = "streams array<struct<index:int,codec_type:string,codec_name:string,width:int,height:int,tags:map<string,string>>>"


def probe_streams(probes: DataFrame) -> DataFrame:
    """``path, json`` of a probe tool -> ``path, index, codec_type, codec_name, language, title, filename, width, height``."""
    x = probes.select("path", F.explode(F.from_json("json", STREAM_SCHEMA)["streams"]).alias("x"))
    return x.select(
        "path",
        "x.index",
        "x.codec_type",
        "x.codec_name",
        F.lower(F.col("x.tags")["language"]).alias("language"),
        F.col("x.tags")["title"].alias("title"),
        F.col("x.tags")["filename"].alias("filename"),
        "x.width",
        "x.height",
    )


def probe_errors(probes: DataFrame) -> DataFrame:
    """``path, error`` of the probes that tell no streams: what they say instead, on one line."""
    told = F.from_json("json", STREAM_SCHEMA)["streams"]
    return probes.where(told.isNull()).select("path", one_line(F.coalesce("json", F.lit(""))).alias("error"))


def video_size(streams: DataFrame, width: int = 1920, height: int = 1080, order: tuple[str, ...] = ("index",)) -> DataFrame:
    """Size of each path's first video stream, else the default.

    ``order`` names the columns that order a path's streams; more than one where an index may repeat. Without the first, a stream is left out.
    """
    video = (F.col("codec_type") == "video") & F.col(order[0]).isNotNull()
    first = F.min_by(F.struct("width", "height"), F.when(video, F.struct(*order)))
    return streams.groupBy("path").agg(first.alias("v")).select(
        "path", F.coalesce("v.width", F.lit(width)).alias("width"), F.coalesce("v.height", F.lit(height)).alias("height")
    )


def font_metrics(data: bytes, index: int = 0) -> tuple[int, int, int]:
    """Units an em, ascent and descent of a TrueType file or collection."""
    big = lambda at, n: int.from_bytes(data[at : at + n], "big")
    base = big(12 + 4 * index, 4) if data[:4] == b"ttcf" else 0
    tables = {data[at : at + 4]: big(at + 8, 4) for at in range(base + 12, base + 12 + 16 * big(base + 4, 2), 16)}
    os2 = tables[b"OS/2"]
    return big(tables[b"head"] + 18, 2), big(os2 + 74, 2), big(os2 + 76, 2)


def font_files(spark: SparkSession, path: str, index: int = 0) -> DataFrame:
    """``path, upem, ascent, descent, scale`` of font files; scale is pixels drawn for one asked for."""

    @F.pandas_udf("struct<upem:int,ascent:int,descent:int>")
    def read(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([font_metrics(c, index) for c in content], columns=["upem", "ascent", "descent"])

    f = spark.read.format("binaryFile").load(path).select("path", read("content").alias("m"))
    return f.select("path", "m.*", (F.col("m.upem") / (F.col("m.ascent") + F.col("m.descent"))).alias("scale"))


def append_log(lines: DataFrame, path: str) -> None:
    """Adds the texts of one string column to the log folder ``path``."""
    lines.select(F.col(lines.columns[0]).cast("string").alias("value")).write.mode("append").text(path)
