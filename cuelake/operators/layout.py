"""Screen layout and subtitle sinks. Character widths are a font's, or those of the fallback rule."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.functions.text import ass_time, escape_ass, srt_time, text_em
from cuelake.operators.sequence import ordered_text

# Sizes as shares of the height of the screen, of the main size, or of the width.
MAIN, RUBY, RUBY_LEAST, BOTTOM, MARGIN = 60 / 1080, 27 / 60, 0.30, 50 / 1080, 0.0208
MAIN_LEAST, MAIN_SHRUNK, RUBY_SMALLEST, EDGE, RISE = 20, 24, 12, 6.0, 1.25


class Font(NamedTuple):
    """A font's name in the file, widths in em that differ from the fallback rule, and pixels drawn for one asked for."""

    name: str = "MS Gothic"  # its characters have the widths of the fallback rule
    widths: dict[str, float] | None = None
    scale: float = 1.0


class Screen(NamedTuple):
    """Size of the picture, the font, and sizes that override the usual ones."""

    width: int = 1920
    height: int = 1080
    font: Font = Font()
    main_px: int | None = None
    bottom_px: int | None = None

    def em(self, text: Column | str) -> Column:
        return text_em(F.col(text) if isinstance(text, str) else text, self.font.widths)

    @property
    def base(self) -> dict[str, int]:
        return sizes(self.width, self.height, self.main_px, self.bottom_px)


def sizes(width: int, height: int, main_px: int | None = None, bottom_px: int | None = None) -> dict[str, int]:
    """Main and ruby size, side margin, characters a line, bottom margin; halves go to the even number."""
    main = max(MAIN_LEAST, main_px or round(height * MAIN))
    margin = round(width * MARGIN)
    return {
        "main": main, "ruby": max(RUBY_SMALLEST, round(main * RUBY)), "margin": margin,
        "chars": max(8, (width - 2 * margin) // main), "bottom": bottom_px if bottom_px is not None else round(height * BOTTOM),
    }


def _sizes(widest: Column, screen: Screen) -> tuple[Column, Column]:
    """Main and ruby size of an episode by the width of its widest cue in em."""
    base = screen.base
    room = screen.width - 2 * base["margin"]
    tight = widest * base["main"] > room
    shrunk = F.greatest(F.lit(MAIN_SHRUNK), F.floor(room / F.nullif(widest, F.lit(0.0))))
    main = F.when(tight, shrunk).otherwise(F.lit(base["main"])).cast("int")
    ruby = F.when(tight, F.greatest(F.lit(RUBY_SMALLEST), F.floor(main * RUBY))).otherwise(F.lit(base["ruby"])).cast("int")
    return main, ruby


def plan_layout(cues: DataFrame, screen: Screen = Screen()) -> DataFrame:
    """``ep, widest, main, ruby``: one size an episode, smaller where its widest cue would not fit."""
    w = cues.groupBy("ep").agg(F.coalesce(F.max(screen.em("text")), F.lit(0.0)).alias("widest"))
    main, ruby = _sizes(F.col("widest"), screen)
    return w.select("ep", "widest", main.alias("main"), ruby.alias("ruby"))


def ruby_size(width: Column, span_px: Column, main: Column, size: Column) -> Column:
    """Smaller where a reading, ``width`` em wide, is wider than what it stands over, but not below ``RUBY_LEAST`` of the main size."""
    fits = (span_px <= 0) | (width * size <= span_px)
    return F.when(fits, size).otherwise(F.greatest(F.floor(main * RUBY_LEAST), F.floor(span_px / width)))


def _line(style: str, tag: Column, text: Column) -> Column:
    times = [F.lit("Dialogue: 0,"), ass_time(F.col("s")), F.lit(","), ass_time(F.col("e"))]
    return F.concat(*times, F.lit(f",{style},,0,0,0,,"), tag, escape_ass(text))


def _main_line(screen: Screen) -> Column:
    """The dialogue line of a planned cue, centred by the width of its text."""
    x = (F.lit(screen.width) - screen.em("text") * F.col("main")) / 2
    y = (F.lit(screen.height - screen.base["bottom"]) - F.col("main")).cast("double")
    return _line("JP", F.format_string("{\\an7\\pos(%.1f,%.1f)}", x, y), F.col("text"))


def _ruby_line(screen: Screen) -> Column:
    """The dialogue line of a planned cue's span ``offset, length, ruby_text``."""
    em = screen.em("text")
    left = (F.lit(screen.width) - em * F.col("main")) / 2 + screen.em(F.expr("substring(text, 1, offset)")) * F.col("main")
    span_w = screen.em(F.expr("substring(text, offset + 1, length)")) * F.col("main")
    rs = ruby_size(screen.em("ruby_text"), span_w, F.col("main"), F.col("ruby"))
    rw = screen.em("ruby_text") * rs
    centred = left + (span_w - rw) / 2
    rx = F.least(F.greatest(centred, F.lit(EDGE)), F.lit(screen.width) - rw - EDGE)
    top = (F.lit(screen.height - screen.base["bottom"]) - F.col("main") - F.floor(F.col("ruby") * RISE)).cast("double")
    own_size = F.format_string("\\fs%.1f", rs.cast("double") / F.lit(screen.font.scale))
    shrunk = F.when(rs == F.col("ruby"), F.lit("")).otherwise(own_size)
    tag = F.concat(F.format_string("{\\an7\\pos(%.1f,%.1f)", rx, top), shrunk, F.lit("}"))
    return _line("RB", tag, F.col("ruby_text"))


def _planned(cues: DataFrame, screen: Screen) -> DataFrame:
    """Cues with the sizes of their episode; they are read once."""
    x = cues.withColumn("widest", F.coalesce(F.max(screen.em("text")).over(W.partitionBy("ep")), F.lit(0.0)))
    main, ruby = _sizes(F.col("widest"), screen)
    return x.withColumns({"main": main, "ruby": ruby}).drop("widest")


def main_events(cues: DataFrame, screen: Screen = Screen()) -> DataFrame:
    """``ep, i, line``: one dialogue line a cue, centred by the width of its text."""
    return _planned(cues, screen).select("ep", "i", _main_line(screen).alias("line"))


def ruby_events(cues: DataFrame, spans: DataFrame, screen: Screen = Screen()) -> DataFrame:
    """``ep, i, offset, line`` for each ruby span ``ep, i, offset, length, ruby_text``: centred over its characters, kept on the screen."""
    return _planned(cues, screen).join(spans, ["ep", "i"]).select("ep", "i", "offset", _ruby_line(screen).alias("line"))


def ass_head(screen: Screen, main: Column, ruby: Column) -> Column:
    """Everything above the events; ``main`` and ``ruby`` are the episode's sizes in pixels."""
    columns = (
        "Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, "
        "ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
    )

    def style(name: str, size: Column, outline: int) -> Column:
        colours = "&H00FFFFFF,&H000000FF,&H00000000,&H7F000000"
        form = f"Style: {name},{screen.font.name},%.1f,{colours},-1,0,0,0,100,100,0,0,1,{outline},0,7,0,0,0,1"
        return F.format_string(form, size.cast("double") / F.lit(screen.font.scale))

    fixed = [
        "[Script Info]", "ScriptType: v4.00+", f"PlayResX: {screen.width}", f"PlayResY: {screen.height}", "WrapStyle: 2",
        "ScaledBorderAndShadow: yes", "YCbCr Matrix: TV.601", "", "[V4+ Styles]", f"Format: {columns}",
    ]
    events = ["", "[Events]", "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"]
    return F.concat_ws("\n", *map(F.lit, fixed), style("JP", main, 3), style("RB", ruby, 2), *map(F.lit, events))


def ass_texts(cues: DataFrame, spans: DataFrame | Column | None = None, screen: Screen = Screen()) -> DataFrame:
    """``ep, ass``: one subtitle file's text an episode; each cue's line is followed by those of its ruby spans.

    ``spans`` are rows ``ep, i, offset, length, ruby_text``, or a column of the cues, arrays of such structs. The cues are
    read once: a cue's own line is that of a null span.
    """
    if isinstance(spans, DataFrame):
        one = F.struct("offset", "length", "ruby_text")
        cues = cues.join(spans.groupBy("ep", "i").agg(F.collect_list(one).alias("_spans")), ["ep", "i"], "left")
        spans = F.col("_spans")
    kind = "array<struct<offset:int,length:int,ruby_text:string>>"
    rows = F.array(F.lit(None).cast(kind[6:-1]))
    if spans is not None:
        cues = cues.withColumn("_spans", spans)
        rows = F.concat(rows, F.coalesce(F.col("_spans").cast(kind), F.array().cast(kind)))
    x = _planned(cues, screen).select("ep", "main", "ruby", "s", "e", "i", "text", F.explode(rows).alias("_x"))
    own = F.col("_x").isNull()
    x = x.select("*", own.alias("_own"), F.coalesce("_x.offset", F.lit(-1)).alias("offset"), "_x.length", "_x.ruby_text")
    lines = x.withColumn("line", F.when(F.col("_own"), _main_line(screen)).otherwise(_ruby_line(screen)))
    body = lines.groupBy("ep", "main", "ruby").agg(ordered_text("line", "s", "i", "offset", sep="\n").alias("body"))
    return body.select("ep", F.concat(ass_head(screen, F.col("main"), F.col("ruby")), F.lit("\n"), "body", F.lit("\n")).alias("ass"))


def srt_blocks(cues: DataFrame) -> DataFrame:
    """``ep, i, block``: numbers count all cues in order, also those without text, which are left out."""
    n = F.row_number().over(W.partitionBy("ep").orderBy("s", "i"))
    x = cues.withColumn("n", n).where(F.length("text") > 0)
    return x.select(
        "ep",
        "i",
        "n",
        F.concat_ws(
            "\n", F.col("n").cast("string"), F.concat(srt_time(F.col("s")), F.lit(" --> "), srt_time(F.col("e"))), "text", F.lit("")
        ).alias("block"),
    )


def srt_texts(cues: DataFrame) -> DataFrame:
    """``ep, srt``: one file's text an episode."""
    return srt_blocks(cues).groupBy("ep").agg(ordered_text("block", "n", sep="\n").alias("srt"))


def write_srt(cues: DataFrame, path: str) -> None:
    """One text file part a partition, episodes apart by folder."""
    srt_texts(cues).write.mode("overwrite").partitionBy("ep").text(path)
