"""Reading annotation: functions on tokens, as plain Python over arrays, and their Arrow forms."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cuelake.functions.text import HIRAGANA, KATAKANA, SPLIT_PUNCT, VOICED_FROM, VOICED_TO

# Fixed values.
ITERATION_MARKS = "々ゝゞヽヾ〻"
SPLIT_PARTICLES = ("から", "まで", "けど", "ので", "のに", "って", "という", "は", "が", "を", "に", "で", "と", "も", "て", "し", "ば")
_PARTICLE_AT = [(p, re.compile(f"(?={p})")) for p in SPLIT_PARTICLES]
_TO_HIRA = str.maketrans(KATAKANA, HIRAGANA)
_VOICE = str.maketrans(VOICED_FROM, VOICED_TO)
_KANJI = re.compile("[㐀-䶿一-鿿豈-﫿々〆]")
_KATA = re.compile("[ァ-ヺーｦ-ﾝ]+")
_KANA = re.compile("[ァ-ヺーｦ-ﾝぁ-ゖ]")


def hira(text: str) -> str:
    return unicodedata.normalize("NFKC", text).translate(_TO_HIRA)


def voiced(reading: str) -> str:
    return hira(reading[:1]).translate(_VOICE) + reading[1:]


def ruby_parts(surface: str, reading: str) -> list[tuple[int, int, str]]:
    """(offset, length, reading) of each stretch that kana of the surface do not spell themselves.

    The kana met from left to right are looked up in the rest of the reading; what lies before one belongs to the
    stretch before it. Kana that the reading lacks are part of their stretch.
    """
    anchors = []  # (place in the surface, place in the reading)
    used = 0
    for i, c in enumerate(surface):
        if _KANA.match(c):
            at = reading.find(hira(c) if _KATA.match(c) else c, used)
            if at >= 0:
                anchors.append((i, at))
                used = at + 1
    out, open_at, read_from = [], 0, 0
    for i, at in [*anchors, (len(surface), len(reading))]:
        if i > open_at and at > read_from:
            out.append((open_at, i - open_at, reading[read_from:at]))
        open_at, read_from = i + 1, at + 1
    return out


def merge_marks(tokens: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Iteration marks join the token before them, if its reading is kana, and repeat its reading voiced."""
    out: list[tuple[str, str]] = []
    for surface, reading in tokens:
        marks = bool(surface) and set(surface) <= set(ITERATION_MARKS)
        if marks and out and out[-1][1] and all(_KANA.match(c) for c in out[-1][1]):
            before, read = out.pop()
            out.append((before + surface, read + voiced(read) * len(surface)))
        else:
            out.append((surface, reading))
    return out


def segment_spans(text: str, tokens: list[tuple[str, str]]) -> list[tuple[int, int, str]]:
    """Ruby spans of a stretch of text from its tokens (surface, reading or ``*``)."""
    out, at = [], 0
    for surface, reading in merge_marks(tokens):
        start = text.find(surface, at)
        start = at if start < 0 else start
        at = start + len(surface)
        spelled = reading != "*" and all(_KANA.match(c) for c in reading)
        if spelled and _KANJI.search(surface):
            out += [(start + o, n, r) for o, n, r in ruby_parts(surface, hira(reading))]
        elif surface and _KATA.fullmatch(surface):
            out.append((start, len(surface), hira(surface)))
    return out


def longest_matches(text: str, entries: dict[str, str]) -> list[tuple[int, str]]:
    """Left to right, at each place the longest key; matched text is consumed: (offset, key)."""
    if not entries:
        return []
    by_length = sorted(entries, key=len, reverse=True)
    pattern = _patterns.get(tuple(by_length))
    if pattern is None:
        pattern = _patterns[tuple(by_length)] = re.compile("|".join(map(re.escape, by_length)))
    return [(m.start(), m.group()) for m in pattern.finditer(text)]


_patterns: dict = {}
Tokenize = Callable[[str], list[tuple[str, str]]]


def text_spans(text: str, entries: dict[str, str], tokenize: Tokenize) -> list[tuple[int, int, str]]:
    """Dictionary hits first; the stretches between them go to the tokenizer."""
    out, at = [], 0
    for start, key in [*longest_matches(text, entries), (len(text), "")]:
        if start > at:
            gap = text[at:start]
            out += [(at + o, n, r) for o, n, r in segment_spans(gap, tokenize(gap))]
        if key:
            out.append((start, len(key), entries[key]))
        at = start + len(key)
    return out


class LexiconTokenizer:
    """A small longest-match tokenizer for tests and demonstrations: {surface: (reading, part of speech)}."""

    def __init__(self, lexicon: dict[str, tuple[str, str]]):
        self.lexicon = lexicon
        self.longest = max(map(len, lexicon), default=1)

    def tokens(self, text: str) -> list[tuple[str, str, str]]:
        out, at = [], 0
        while at < len(text):
            n = next((k for k in range(min(self.longest, len(text) - at), 0, -1) if text[at : at + k] in self.lexicon), 1)
            word = text[at : at + n]
            out.append((word, *self.lexicon.get(word, ("*", ""))))
            at += n
        return out

    def __call__(self, text: str) -> list[tuple[str, str]]:
        return [(s, r) for s, r, _ in self.tokens(text)]


def split_long(text: str, limit: int) -> list[str]:
    """Halves a text until no part is longer than ``limit``: near the middle, rather after punctuation or a particle.

    What a place gains by what stands before it is the same in every part, as no part is cut within eight characters of
    its ends; so it is looked up once for the whole text.
    """
    if len(text) <= limit:
        return [text]
    gain = np.zeros(len(text) + 1)
    for p, at in _PARTICLE_AT:
        for m in at.finditer(text):
            gain[m.start() + len(p)] = 6
    for i, c in enumerate(text, 1):
        if c in SPLIT_PUNCT:
            gain[i] = 12
    out, todo = [], [(0, len(text))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= limit:
            out.append(text[lo:hi])
            continue
        i = np.arange(8, hi - lo - 8)
        middle = (hi - lo) / 2
        at = lo + (int(i[(np.abs(i - middle) - gain[lo + i]).argmin()]) if len(i) else int(middle))
        todo += [(at, hi), (lo, at)]
    return out


def nfkc(text: Column) -> Column:
    """Unicode normalisation, for which Spark has no function."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    return run(text)


def split_long_column(text: Column, limit: int) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else split_long(t, limit))

    return run(text)


def ruby_column(text: Column, entries: dict[str, str], tokenize: Tokenize) -> Column:
    """``array<struct<offset int, length int, ruby string>>`` of a text column."""

    @F.pandas_udf("array<struct<offset:int,length:int,ruby:string>>")
    def run(s: pd.Series) -> pd.Series:
        spans = lambda t: [dict(zip(("offset", "length", "ruby"), x)) for x in text_spans(t, entries, tokenize)]
        texts = [t or "" for t in s]
        known = {t: spans(t) for t in set(texts)}
        return pd.Series([known[t] for t in texts], index=s.index)

    return run(text)
