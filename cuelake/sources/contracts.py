"""Schemas of the logical relations, and the hook by which an external recogniser or analyser fills one.

Times are microseconds from the episode's start; every relation has an explicit ordinal, as tables have no order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

MEDIA_FILE = "path string, folder string, name string, stem string, suffix string"
STREAM = "path string, index int, codec_type string, codec_name string, language string, title string, filename string, width int, height int"
MUX_TRACK = "path string, pos int, track_id int, kind string"
BASE_INTERVAL = "ep long, j long, cs long, ce long"
SEGMENT = "ep long, seg_i long, s long, e long, text string, words array<struct<ws:bigint,we:bigint,w:string>>"
WORD = "ep long, seg_i long, w_i long, s long, e long, text string"
SPEECH_SPAN = "ep long, j long, a long, b long"
PAUSE = "ep long, j long, pa long, pb long"
CUE = "ep long, i long, s long, e long, text string"
TOKEN = "text_id long, pos int, surface string, base_form string, part_of_speech string, reading string"
RUBY_SPAN = "ep long, i long, offset int, length int, ruby_text string"
DICT_ENTRY = "folder string, surface string, reading string"
SETTING = "folder string, section string, key string, value string, layer int"
RUN_RESULT = "path string, status string, seconds double, error string"


def external(inputs: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], relation: str) -> DataFrame:
    """The relation that ``run`` makes of batches of ``inputs``; it may load a model once, before its first batch."""
    return inputs.mapInPandas(run, relation)


def status_of(inputs: DataFrame, run: Callable[[str], object], key: str = "path") -> DataFrame:
    """``key, status, error`` of ``run`` on each row: a failure is a row, never the end of the job."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k in b[key]:
                try:
                    run(k)
                    out.append((k, "done", None))
                except Exception as e:  # noqa: BLE001
                    out.append((k, "failed", " ".join(str(e).split())[:200]))
            yield pd.DataFrame(out, columns=[key, "status", "error"])

    return inputs.select(key).mapInPandas(each, f"{key} string, status string, error string")
