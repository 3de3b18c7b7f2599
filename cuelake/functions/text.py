"""Column functions on times, characters and texts; all of them run in the JVM, but for ``bigram_codes``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and tables that results depend on.
PUNCTUATION = "。、！？…?!「」（）『』・　 "
SPLIT_PUNCT = "、。！？!?…「」"
KANJI = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3005}\x{3006}]"
KATA = r"[\x{30A1}-\x{30FA}\x{30FC}\x{FF66}-\x{FF9D}]"
HIRA = r"[\x{3041}-\x{3096}]"
VOICED_FROM, VOICED_TO = "かきくけこさしすせそたちつてとはひふへほ", "がぎぐげござじずぜぞだぢづでどばびぶべぼ"
#: Katakana ァ .. ヶ and the hiragana 0x60 below each; the long mark stays.
KATAKANA = "".join(chr(c) for c in range(0x30A1, 0x30F7))
HIRAGANA = "".join(chr(c - 0x60) for c in range(0x30A1, 0x30F7))


def srt_time(us: Column) -> Column:
    """``HH:MM:SS,mmm``; fractions of a millisecond are cut off."""
    ms = F.floor(us / 1000).cast("bigint")
    return F.format_string(
        "%02d:%02d:%02d,%03d",
        F.floor(ms / 3_600_000).cast("bigint"),
        F.floor(ms / 60_000).cast("bigint") % 60,
        F.floor(ms / 1000).cast("bigint") % 60,
        ms % 1000,
    )


def ass_time(us: Column) -> Column:
    """``H:MM:SS.cc``; halves of a hundredth go to the even one."""
    cs = F.rint(us / 10_000).cast("bigint")
    return F.format_string(
        "%d:%02d:%02d.%02d",
        F.floor(cs / 360_000).cast("bigint"),
        F.floor(cs / 6000).cast("bigint") % 60,
        F.floor(cs / 100).cast("bigint") % 60,
        cs % 100,
    )


def strip(text: Column) -> Column:
    """Without any Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_punct(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, "")


def chars(text: Column) -> Column:
    """Code points of a text as an array (none for an empty text)."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters; none for a text of less than two."""

    def pairs(c: Column) -> Column:
        n = F.greatest(F.size(c) - 1, F.lit(0))
        return F.array_distinct(F.zip_with(F.slice(c, 1, n), F.slice(c, 2, n), lambda a, b: F.concat(a, b)))

    return _let(chars(text), pairs)


def bigram_codes(text: Column, without: str = "") -> Column:
    """``bigrams`` of a text less the characters ``without``, as sorted numbers: for long texts, as an array of numbers a text."""

    @F.arrow_udf("array<bigint>")
    def run(texts: pa.Array) -> pa.Array:
        kept = np.ones(0x110000, bool)
        kept[[ord(c) for c in without]] = False
        sets, ends = [np.zeros(0, np.int64)], [0]
        for t in texts:
            if t.is_valid:
                c = np.frombuffer(t.as_py().encode("utf-32-le"), np.uint32)
                c = c[kept[c]].astype(np.int64)
                sets.append(np.unique(c[:-1] << 21 | c[1:]))
                ends.append(ends[-1] + len(sets[-1]))
            else:
                ends.append(ends[-1])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)), mask=texts.is_null())

    return run(text)


def shared(a: Column, b: Column) -> Column:
    """Share of the set ``a`` that ``b`` has; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def overlap_ratio(text: Column, other: Column) -> Column:
    """Share of ``text``'s character pairs (without punctuation) that ``other`` has; 0 if either has none."""
    sets = F.struct(bigrams(strip_punct(text)).alias("a"), bigrams(strip_punct(other)).alias("b"))
    return _let(sets, lambda x: shared(x["a"], x["b"]))


def text_em(text: Column, widths: dict[str, float] | None = None) -> Column:
    """Width by the fallback rule, half an em for printable ASCII and one em for the rest, but for characters in ``widths``.

    Characters of one width are counted together, so a whole font is a few expressions.
    """
    narrow = F.length(F.regexp_replace(text, r"[^\x20-\x7E]", ""))
    out = F.length(text) - narrow * 0.5
    other: dict[float, str] = {}
    for c, em in sorted((widths or {}).items()):
        more = em - (0.5 if " " <= c <= "~" else 1.0)
        if more:
            other[more] = other.get(more, "") + c
    for more, chars_ in sorted(other.items()):
        out = out + (F.length(text) - F.length(F.translate(text, chars_, ""))) * F.lit(more)
    return out


def escape_ass(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))


def to_hira(text: Column) -> Column:
    """Full-width katakana to hiragana; half-width forms need ``nfkc`` first."""
    return F.translate(text, KATAKANA, HIRAGANA)


def rendaku(reading: Column) -> Column:
    """The first kana voiced."""
    return F.concat(F.translate(to_hira(F.substring(reading, 1, 1)), VOICED_FROM, VOICED_TO), F.substring(reading, 2, 1 << 30))


def first_line(text: Column) -> Column:
    """The first line that is not blank, stripped; null if there is none."""
    return F.try_element_at(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != ""), F.lit(1))


def one_line(text: Column, most: int = 200) -> Column:
    """White space collapsed, cut to ``most`` characters."""
    return F.left(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(most))


def tolerant_int(text: Column) -> Column:
    """A whole number or null; empty is null too."""
    return text.try_cast("int")


def mentions(text: Column, words: list[str]) -> Column:
    """Does the text hold any of the words, whatever their case?"""
    low = F.lower(text)
    found = F.lit(False)
    for w in words:
        found = found | F.contains(low, F.lit(w.lower()))
    return found


def version_key(version: Column) -> Column:
    """Numbers of a dotted version, for ordering."""
    return F.transform(F.split(version, r"\."), lambda x: x.cast("int"))
