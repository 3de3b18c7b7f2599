import random
import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuelake.operators import catalog, intervals, layout
from cuelake.sources import texts
from cuelake.streaming import timeline


def test_srt_cues(spark, tmp_path):
    body = "﻿noise\n1\n00:00:01,5 --> 00:00:02.250\n one \n42\ntwo\n\n2\n00:00:03,000 --> 00:00:04,000\n\n"
    (tmp_path / "a.srt").write_text(body, encoding="utf-8")
    lines = texts.text_lines(spark, str(tmp_path / "a.srt"))
    got = [(r["cue"], r["s"], r["e"], r["text"]) for r in texts.srt_cues(lines).orderBy("cue").collect()]
    assert got == [(1, 1_005_000, 2_250_000, "one two"), (2, 3_000_000, 4_000_000, "")]
    assert texts.srt_timeline(lines).count() == 2


def test_media_files(spark, tmp_path):
    root = tmp_path / "[grp] x"
    (root / "s").mkdir(parents=True)
    for n in ("a.mkv", "s/B.MKV", "c.txt"):
        (root / n).write_bytes(b"123")
    got = {r["name"]: (r["suffix"], r["bytes"]) for r in texts.media_files(spark, str(root)).collect()}
    assert got == {"a.mkv": (".mkv", 3), "B.MKV": (".mkv", 3)}
    (root / "d.mka").write_bytes(b"12345")
    assert [(r["name"], r["bytes"]) for r in texts.media_files(spark, str(root / "d.mka")).collect()] == [("d.mka", 5)]
    assert texts.media_files(spark, str(root / "c.txt")).count() == 0


def test_font_metrics(spark, tmp_path):
    head, os2 = bytearray(54), bytearray(96)
    struct.pack_into(">H", head, 18, 1000)
    struct.pack_into(">HH", os2, 74, 1200, 300)
    at = 12 + 32
    table = lambda tag, off, n: tag + struct.pack(">III", 0, off, n)
    data = struct.pack(">IHHHH", 0x00010000, 2, 0, 0, 0) + table(b"OS/2", at, 96) + table(b"head", at + 96, 54) + bytes(os2) + bytes(head)
    assert texts.font_metrics(data) == (1000, 1200, 300)
    (tmp_path / "a.ttf").write_bytes(data)
    r = texts.font_files(spark, str(tmp_path / "a.ttf")).first()
    assert (r["upem"], r["ascent"], r["descent"], round(r["scale"], 4)) == (1000, 1200, 300, 0.6667)


def test_fonts_on_the_screen(spark):
    """Widths of a font's own characters, and sizes as the renderer wants them."""
    cues = spark.createDataFrame([(1, 1, 0, 1_000_000, "ab漢「")], "ep long, i long, s long, e long, text string")
    font = layout.Font("Some Font", {"「": 0.5, "a": 0.75}, 0.5)
    screen = layout.Screen(font=font, main_px=40)
    assert layout.plan_layout(cues, screen).first().asDict() == {"ep": 1, "widest": 2.75, "main": 40, "ruby": 18}
    assert "pos(905.0,990.0)" in layout.main_events(cues, screen).first()["line"]
    ass = layout.ass_texts(cues, None, screen).first()["ass"]
    assert "Style: JP,Some Font,80.0," in ass and "Style: RB,Some Font,36.0," in ass


def test_dictionary_files(spark):
    own = "# note\n小玉\tたま\n\n" + catalog.CANDIDATE_MARK + "\n#old\told\n"
    files = spark.createDataFrame([("a", own), ("b", None), ("c", "x y")], "folder string, body string")
    found = spark.createDataFrame([("a", "小玉", "こだま", 5, 1), ("a", "東京", "?", 3, 2), ("b", "神田", "かんだ", 2, 1)], "folder string, surface string, reading string, n long, rank int")
    got = {r["folder"]: r for r in catalog.dictionary_files(files, found).collect()}
    assert all(r["changed"] for r in got.values()) and [got[k]["n"] for k in "abc"] == [1, 1, 0]
    assert got["a"]["body"].startswith("# note\n小玉\tたま\n\n" + catalog.CANDIDATE_MARK) and got["a"]["body"].endswith("#東京\t?\t出现 3 次\n")
    assert got["b"]["body"].startswith(catalog.DICTIONARY_HEAD[0]) and got["c"]["body"].endswith(catalog.NO_CANDIDATES + "\n")
    again = spark.createDataFrame([(k, r["body"]) for k, r in got.items()], "folder string, body string")
    assert not any(r["changed"] for r in catalog.dictionary_files(again, found).collect())


def test_tag_plan(spark):
    t = [("a", 0, "video", 0, None), ("a", 1, "subtitles", 1, "und"), ("a", 2, "subtitles", 4, "CHI"), ("b", 0, "subtitles", 2, "eng")]
    got = sorted(tuple(r) for r in catalog.tag_plan(spark.createDataFrame(t, "path string, pos int, kind string, track_id int, language string")).collect())
    new = lambda p, n: [(p, n, "flag-default", "yes"), (p, n, "language", "jpn"), (p, n, "name", "Japanese")]
    assert got == sorted([*new("a", 2), ("a", 5, "flag-default", "no"), *new("b", 3)])


def test_probe_errors_and_log(spark, tmp_path):
    probes = spark.createDataFrame([("a", '{"streams":[]}'), ("b", "not  a\nfile"), ("c", None)], "path string, json string")
    assert {r["path"]: r["error"] for r in texts.probe_errors(probes).collect()} == {"b": "not a file", "c": ""}
    for _ in range(2):
        texts.append_log(probes.select("path"), str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 6


def test_contracts(spark):
    """A recogniser fills a relation, its words come out normalised; a failure is a row with its reason."""
    from cuelake.operators.sequence import normalise_words
    from cuelake.sources import contracts

    files = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, ep long")

    def heard(batches):
        for b in batches:
            words = [[{"ws": 500_000, "we": 100_000, "w": "x"}, {"ws": 500_000, "we": 500_000, "w": "y"}] if ep != 2 else None for ep in b["ep"]]
            yield pd.DataFrame({"ep": b["ep"], "seg_i": 0, "s": 0, "e": 10, "text": ["" if ep == 3 else "z" for ep in b["ep"]], "words": words})

    segments = contracts.external(files, heard, contracts.SEGMENT)
    assert segments.schema == spark.createDataFrame([], contracts.SEGMENT).schema
    got = sorted(tuple(r) for r in normalise_words(segments).collect())
    one = lambda ep: [(ep, 0, 0, 100_000, 500_000, "x"), (ep, 0, 1, 500_000, 550_000, "y")]
    assert got == [*one(1), (2, 0, 0, 0, 50_000, "z"), *one(3)]

    def run(path):
        if path == "b":
            raise ValueError("no\n such   tool")

    assert sorted((tuple(r) for r in contracts.status_of(files, run).collect()), key=str) == [("a", "done", None), ("b", "failed", "no such tool"), ("c", "done", None)]


def test_long_intervals(spark):
    """Intervals of any length meet as a plain comparison says, each pair once."""
    rnd = random.Random(4)
    span = lambda: (lambda a: (a, a + rnd.choice([0, 3, 50, 900, 70_000, 900_000])))(rnd.randint(0, 10**6))
    left, right = [(1, k, *span()) for k in range(60)], [(1, k, *span()) for k in range(60)]
    a, b = spark.createDataFrame(left, "ep long, i long, s long, e long"), spark.createDataFrame(right, "ep long, j long, a long, b long")
    got = sorted((r["i"], r["j"]) for r in intervals.overlap_join(a, b, (F.col("s"), F.col("e")), (F.col("a"), F.col("b")), bucket_us=10).collect())
    assert got == sorted((i, j) for _, i, s, e in left for _, j, x, y in right if s <= y and x <= e)


def test_layout():
    assert layout.sizes(1920, 1080) == {"main": 60, "ruby": 27, "margin": 40, "chars": 30, "bottom": 50}


def test_ruby_events(spark):
    cues = spark.createDataFrame([(1, 1, 0, 1_000_000, "今日{")], "ep long, i long, s long, e long, text string")
    spans = spark.createDataFrame([(1, 1, 0, 2, "きょう")], "ep long, i long, offset int, length int, ruby_text string")
    main = layout.main_events(cues).first()["line"]
    assert main == "Dialogue: 0,0:00:00.00,0:00:01.00,JP,,0,0,0,,{\\an7\\pos(885.0,970.0)}今日\\{"
    assert layout.ruby_events(cues, spans).first()["line"] == "Dialogue: 0,0:00:00.00,0:00:01.00,RB,,0,0,0,,{\\an7\\pos(904.5,937.0)}きょう"


def test_verify_mux(spark):
    kind = "path string, index int, codec_type string, codec_name string, language string, title string"
    old = [("a", 0, "video", "avc", None, None), ("a", 1, "audio", "aac", "jpn", None), ("b", 0, "video", "avc", None, None)]
    new = [*old[:2], ("a", 2, "subtitle", "ass", "JPN", "Japanese"), ("b", 0, "video", "hevc", None, None)]
    got = {r["path"]: r["problems"] for r in catalog.verify_mux(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind)).collect()}
    assert got == {"a": "", "b": "streams;first subtitle;no Japanese subtitle"}


def test_candidates(spark):
    t = [("f", 1, "小玉", "名詞,固有名詞,人名", "コダマ"), ("f", 2, "小玉", "名詞,固有名詞,人名", "*"), ("f", 3, "東京", "名詞,固有名詞,地域", "*"), ("f", 4, "アニ", "名詞,固有名詞", "アニ"), ("f", 5, "犬", "名詞,固有名詞", "イヌ")]
    got = catalog.candidates(spark.createDataFrame(t, "folder string, pos int, surface string, part_of_speech string, reading string")).orderBy("rank").collect()
    assert [(r["surface"], r["reading"], r["n"]) for r in got] == [("小玉", "こだま", 2), ("東京", "?", 1)]


def test_sessions_and_add_only(spark, tmp_path):
    ts = pd.to_datetime(["2024-01-01 00:00:00", "2024-01-01 00:00:04", "2024-01-01 00:01:00"])
    spark.createDataFrame(pd.DataFrame({"ep": [1, 1, 1], "ts": ts, "s": [0, 5, 2], "e": [4, 9, 3]})).coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    batch = timeline.silence_groups(spark.read.parquet(str(tmp_path / "in")), "10 seconds")
    assert sorted(r["n"] for r in batch.collect()) == [1, 2]
    q = timeline.silence_groups(timeline.segment_stream(spark, str(tmp_path / "in"), schema), "10 seconds", "1 second").writeStream.format("memory").queryName("g").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("g").count() >= 1
    for k in range(2):
        stream = timeline.segment_stream(spark, str(tmp_path / "in"), schema)
        timeline.add_only(stream, str(tmp_path / "out"), ["ep", "s"], str(tmp_path / f"c{k}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_forward_only(spark, tmp_path):
    spark.createDataFrame([(1, 0, 4), (1, 2, 3), (1, 9, 10)], "ep long, s long, e long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = timeline.forward_only(spark.readStream.schema("ep long, s long, e long").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("fwd").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["s"], r["e"]) for r in spark.table("fwd").orderBy("s", "e").collect()] == [(0, 4), (4, 4), (9, 10)]


@pytest.mark.parametrize("kind", ["merge", "split"])
def test_mark_score(spark, kind):
    marks = spark.createDataFrame([(1, 5, kind), (1, 9, kind)], "ep long, seam long, kind string")
    seams = spark.createDataFrame([(1, 5), (1, 8)], "ep long, cut long")
    got = [r["passed"] for r in catalog.mark_score(marks, seams).orderBy("seam").collect()]
    assert got == ([False, True] if kind == "merge" else [True, True])


def test_first_track(spark):
    t = spark.createDataFrame([("a", 0, 4), ("a", 1, 7)], "path string, pos int, track_id int")
    s = spark.createDataFrame([("a", 0, "eng"), ("a", 1, "ZH")], "path string, pos int, language string")
    assert [r["track_id"] for r in catalog.first_track(t, s, catalog.CHINESE).collect()] == [7]
    assert texts.video_size(s.select("path", F.col("pos").alias("index"), F.lit("audio").alias("codec_type"), F.lit(1).alias("width"), F.lit(1).alias("height"))).first()["width"] == 1920


def test_ass_texts_reads_cues_once(spark):
    """Spans as rows or as a column of the cues give one text, and cues with no episode have one too; the cues are read once."""
    cues = spark.createDataFrame(
        [(1, 0, 0, 10**6, "今日"), (1, 1, 10**6, 2 * 10**6, "a" * 80), (2, 0, 0, 10**6, "x{"), (None, 0, 0, 10**6, "日")],
        "ep long, i long, s long, e long, text string",
    )
    spans = spark.createDataFrame([(1, 0, 1, 1, "にち"), (1, 0, 0, 1, "きょう")], "ep long, i long, offset int, length int, ruby_text string")
    own = F.expr("CASE WHEN text = '今日' THEN array(struct(1, 1, 'にち'), struct(0, 1, 'きょう')) END")
    by_rows, by_column = layout.ass_texts(cues, spans), layout.ass_texts(cues, own)
    got = {r["ep"]: r["ass"] for r in by_column.collect()}
    assert got == {r["ep"]: r["ass"] for r in by_rows.collect()} and set(got) == {1, 2, None}
    lines = [x.split(",", 9) for x in got[1].splitlines() if x.startswith("Dialogue")]
    assert [(x[3], x[9].split("}")[1]) for x in lines] == [("JP", "今日"), ("RB", "きょう"), ("RB", "にち"), ("JP", "a" * 80)]
    assert by_column._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
