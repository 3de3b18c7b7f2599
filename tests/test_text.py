import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuelake.functions import kana
from cuelake.functions import text as tx
from cuelake.functions.grammar import Rules, Token, by_fragment


@pytest.mark.parametrize(
    ("surface", "reading", "parts"),
    [
        ("食べる", "たべる", [(0, 1, "た")]),
        ("連れ去り", "つれさり", [(0, 1, "つ"), (2, 1, "さ")]),
        ("今日", "きょう", [(0, 2, "きょう")]),
        ("お茶", "おちゃ", [(1, 1, "ちゃ")]),
        ("かな", "かな", []),
        ("", "", []),
    ],
)
def test_ruby_parts(surface, reading, parts):
    assert kana.ruby_parts(surface, reading) == parts


def test_iteration_marks():
    assert kana.merge_marks([("神", "カミ"), ("々", "*")]) == [("神々", "カミがミ")]
    assert kana.hira("カタカナ") == "かたかな" and kana.hira("ｶﾞ") == "が"
    assert kana.merge_marks([("々", "*")]) == [("々", "*")]


def test_dictionary_first():
    tok = kana.LexiconTokenizer({"今日": ("キョウ", "名詞")})
    assert kana.text_spans("小玉は今日", {"小玉": "たま", "小": "しょう"}, tok) == [(0, 2, "たま"), (3, 2, "きょう")]
    assert kana.text_spans("", {}, tok) == []


@given(st.text("あ、abc。", max_size=200), st.integers(20, 60))
def test_split_long(text, limit):
    parts = kana.split_long(text, limit)
    assert "".join(parts) == text and all(len(p) <= limit for p in parts)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_times(spark):
    r = one(spark, tx.srt_time(F.lit(3_723_004_999)), tx.ass_time(F.lit(3_723_005_000)), tx.ass_time(F.lit(15_000)), tx.ass_time(F.lit(25_000)))
    assert list(r) == ["01:02:03,004", "1:02:03.00", "0:00:00.02", "0:00:00.02"]


def test_scalars(spark):
    r = one(
        spark, tx.text_em(F.lit("ab漢 ")), tx.strip(F.lit("　 a　b  ")), tx.strip_punct(F.lit("「あ、い」　！")), tx.escape_ass(F.lit("a{b}\\")),
        tx.rendaku(F.lit("カミ")), tx.first_line(F.lit("\n  \n x \ny")), tx.tolerant_int(F.lit("x1")), tx.overlap_ratio(F.lit("abcd"), F.lit("bcd")), tx.overlap_ratio(F.lit("a"), F.lit("")),
        kana.nfkc(F.lit("ｶﾞ")), F.size(tx.bigrams(F.lit("aaa"))),
    )
    assert list(r) == [2.5, "a　b", "あい", "a\\{b\\}\\\\", "がミ", "x", None, 2 / 3, 0.0, "ガ", 1]


LEXICON = {
    "実は": ("副詞",), "スポーツ": ("名詞",), "俺": ("代名詞",), "が": ("助詞", "格助詞"), "です": ("助動詞",), "か": ("助詞", "副助詞／並立助詞／終助詞"),
    "ね": ("助詞", "終助詞"), "いや": ("感動詞",), "はい": ("感動詞",), "と": ("助詞", "格助詞"), "いう": ("動詞",), "くん": ("名詞", "接尾"), "思う": ("動詞",),
}


def tokenize(text):
    out, at = [], 0
    while at < len(text):
        n = next((k for k in range(min(4, len(text) - at), 0, -1) if text[at : at + k] in LEXICON), 1)
        w = text[at : at + n]
        out.append(Token(w, w, LEXICON.get(w, ("記号",))))
        at += n
    return out


def test_rules():
    r = Rules(tokenize)
    assert r.joined_word("ス", "ポーツ") and not r.joined_word("俺", "が") and not r.joined_word("ス。", "ポーツ")
    assert r.next_starts_with_particle("俺", "がいや") and not r.next_starts_with_particle("思う", "といういや")
    assert r.starts_sentence("いや") and not r.starts_sentence("思う") and r.bound_tail("ね") and not r.bound_tail("俺")
    assert r.ends_with_starter("思ういや") and r.all_starters("はいいや") and not r.all_starters("思うはい")
    assert r.attach_penalty("俺", "が") == 6.0 and r.attach_penalty("俺", "です") == 4.0 and r.attach_penalty("俺", "くん") == 4.0 and r.attach_penalty("俺", "思う") == 0.0
    assert r.cut_inside_word("実", "は俺") and not r.cut_inside_word("俺", "が") and not r.cut_inside_word("", "が")
    assert r.bad_line_start("が") and not r.bad_line_start("俺") and not r.bad_line_start("")
    assert r.boundary_cost("思うね", "俺") == pytest.approx(-0.8 - 0.3)
    assert r.boundary_cost("いや", "はい") == pytest.approx(-0.5 + 4.0 + 0.5)
    assert r.boundary_cost("俺が", "思う") == pytest.approx(1.5 - 0.3 + 0.5)
    assert r.cut_cost("俺", "が", None, False) == pytest.approx(1.0 + 6.0 + 4.0 + 0.5)
    assert r.cut_cost("俺", "が", 2_000_000, True) == pytest.approx(-1.5)


def test_by_fragment(spark):
    df = spark.createDataFrame([(1, "が"), (2, "が"), (3, None)], "id int, t string")
    got = {x["id"]: x["bad"] for x in by_fragment(df, ["t"], "bad", Rules(tokenize).bad_line_start, "boolean").collect()}
    assert got == {1: True, 2: True, 3: None}
    two = spark.createDataFrame([(1, "a", 1), (2, "a", None), (3, None, 1)], "id int, t string, n int")
    got = {x["id"]: x["r"] for x in by_fragment(two, ["t", "n"], "r", lambda t, n: f"{t}{n and int(n)}", "string").collect()}
    assert got == {1: "a1", 2: "aNone", 3: None}


def test_by_fragment_reads_rows_once(spark):
    """A rule of two answers, some of them null: no join and no second run for a filter on an answer."""
    df = spark.range(40).select("id", F.expr("CASE WHEN id % 4 > 0 THEN concat('a', id % 4) END AS t"), (F.col("id") % 2).alias("n"))
    x = by_fragment(df, ["t", "n"], "r", lambda t, n: (t + str(int(n)), n == 1), "both string, odd boolean")
    got = x.where("r.odd").select("id", "r.both")
    assert {r["id"]: r["both"] for r in got.collect()} == {i: f"a{i % 4}1" for i in range(1, 40, 2)}
    assert x.where("r IS NULL").count() == 10
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range") == 1 and "Join" not in plan and plan.count("ArrowEvalPython") == 1


def test_bigram_codes(spark):
    """As many pairs, and as many shared ones, as of the pairs as texts."""
    texts = [(0, "abcabc。d"), (1, "😀a😀a!b"), (2, ""), (3, "x"), (4, None), (5, "。、"), (6, "a、bc\n d"), (7, "aaaa")]
    df = spark.createDataFrame(texts, "id int, text string").repartition(3)
    x = df.select("id", tx.bigrams(tx.strip_punct(F.col("text"))).alias("a"), tx.bigram_codes(F.col("text"), tx.PUNCTUATION).alias("b"))
    y = x.select(F.col("id").alias("j"), F.col("a").alias("c"), F.col("b").alias("d"))
    rows = x.crossJoin(y).select(tx.shared(F.col("a"), F.col("c")).alias("want"), tx.shared(F.col("b"), F.col("d")).alias("got")).collect()
    assert len(rows) == 64 and all(r["want"] == r["got"] for r in rows) and {r["got"] for r in rows} > {0.0, 1.0}
    sizes = {r["id"]: (r["n"], r["m"]) for r in x.select("id", F.size("a").alias("n"), F.size("b").alias("m")).collect()}
    assert all(n == m for n, m in sizes.values()) and sizes[0][1] == 4
