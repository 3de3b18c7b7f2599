"""Registered queries of the timeline operators and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.functions import grammar, kana
from cuelake.functions import text as tx
from cuelake.operators import catalog, intervals, layout, recover, segment, sequence
from cuelake.plans.tables import EV, HOUR, events, of_type, read
from cuelake.sources import texts as src
from cuelake.streaming import timeline as live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- ordered operators


@register(f"""WITH {EV}, g AS (SELECT ep, i, e AS a, lead(s) OVER (PARTITION BY ep ORDER BY s, i) AS b FROM ev),
k AS (SELECT ep, i, a, b, unnest(generate_series(0, (b - a - 2) // 7200000000)) AS k FROM g WHERE b - a >= 800000)
SELECT ep, i, k, a + k * 7200000000 AS w0, least(b, a + (k + 1) * 7200000000) AS w1 FROM k
WHERE least(b, a + (k + 1) * 7200000000) - (a + k * 7200000000) >= 800000""")
def gap_windows(spark, d):
    return sequence.gap_windows(events(spark, d), chunk=2 * HOUR)


@register(f"""WITH {EV} SELECT * FROM (SELECT ep, i, e AS pa, lead(s) OVER (PARTITION BY ep ORDER BY s, i) AS pb,
lead(s) OVER (PARTITION BY ep ORDER BY s, i) - e AS gap FROM ev) WHERE gap > 0""")
def silence_gaps(spark, d):
    return sequence.gaps(events(spark, d))


@register(f"""WITH {EV} SELECT *, gap >= 7200000000 AS strong FROM
(SELECT ep, i, s - lag(e) OVER (PARTITION BY ep ORDER BY s, i) AS gap FROM ev) WHERE gap >= 3600000000""")
def cut_candidates(spark, d):
    return sequence.cut_candidates(events(spark, d), HOUR, 2 * HOUR)


RUNS = f"""{EV}, c AS (SELECT *, CASE WHEN lag(1) OVER w IS NULL OR lag(text) OVER w IS DISTINCT FROM text THEN 1 ELSE 0 END AS c
FROM ev WINDOW w AS (PARTITION BY ep ORDER BY s, i)),
r AS (SELECT *, sum(c) OVER (PARTITION BY ep ORDER BY s, i) AS run FROM c)"""


@register(f"""WITH {RUNS} SELECT ep, CAST(run AS BIGINT) AS run, first(text) AS owner, count(*) AS n, min(s) AS s,
arg_max(e, (s, i)) AS e, string_agg(text, '' ORDER BY s, i) AS text FROM r GROUP BY ep, run""")
def run_group(spark, d):
    return sequence.run_cues(events(spark, d), "text")


@register(f"""WITH {EV}, r AS (SELECT ep, i, s, text, CAST(round_even(s / 60000000, 0) AS BIGINT) * 60000000 AS a, CAST(round_even(e / 60000000, 0) AS BIGINT) * 60000000 AS b FROM ev)
SELECT ep, a AS s, b AS e, string_agg(text, '' ORDER BY r.s, r.i) AS text FROM r GROUP BY ep, a, b""")
def merge_same_interval(spark, d):
    return sequence.merge_same_interval(events(spark, d), 60_000_000)


@register(f"""WITH {EV}, h AS (SELECT ep, i, s // 36000000000 * 36000000000 + i % 8 * 500 AS s, s // 36000000000 * 36000000000 + 1000000 + i % 8 * 500 AS e, text FROM ev),
r AS (SELECT ep, i, s, text, CAST(round_even(s / 1000, 0) AS BIGINT) * 1000 AS a, CAST(round_even(e / 1000, 0) AS BIGINT) * 1000 AS b FROM h)
SELECT ep, a AS s, b AS e, string_agg(text, '' ORDER BY r.s, r.i) AS text FROM r GROUP BY ep, a, b""")
def merge_to_millisecond(spark, d):
    """Cues half a millisecond apart: those on a half go to the even millisecond."""
    ten = F.floor(F.col("s") / (10 * HOUR)) * (10 * HOUR) + F.col("i") % 8 * 500
    return sequence.merge_same_interval(events(spark, d).select("ep", "i", ten.alias("s"), (ten + 1_000_000).alias("e"), "text"))


@register(f"""WITH {EV}, a AS (SELECT ep, i, s AS raw, greatest(0, s - 50000) AS s, e FROM ev),
b AS (SELECT ep, i, raw, s, greatest(s + 600000, e) AS e, lead(s) OVER (PARTITION BY ep ORDER BY raw, i) - 50000 AS n FROM a)
SELECT ep, i, s, CASE WHEN n IS NULL THEN greatest(e, s + 600000) ELSE greatest(least(e, n), least(s + 600000, n)) END AS e FROM b""")
def display_clamp(spark, d):
    return sequence.display_clamp(events(spark, d)).select("ep", "i", "s", "e")


@register(f"""WITH {EV}, m AS (SELECT ep, i, s, max(greatest(s, e)) OVER (PARTITION BY ep ORDER BY i) AS m FROM ev)
SELECT ep, i, greatest(s, coalesce(lag(m) OVER (PARTITION BY ep ORDER BY i), s)) AS s, m AS e FROM m""")
def monotone_repair(spark, d):
    return sequence.monotone_repair(events(spark, d)).select("ep", "i", "s", "e")


@register(f"""WITH RECURSIVE {EV}, o AS (SELECT ep, i, s, e + 7200000000 AS e, row_number() OVER w AS n, lead(s) OVER w AS nx
FROM ev WINDOW w AS (PARTITION BY ep ORDER BY s, i)),
f(ep, i, n, s, e) AS (
  SELECT ep, i, n, s, CASE WHEN nx IS NOT NULL AND e > nx - 50000 THEN greatest(s + 300000, nx - 50000) ELSE e END FROM o WHERE n = 1
  UNION ALL
  SELECT o.ep, o.i, o.n, greatest(o.s, f.e + 50000),
    CASE WHEN o.nx IS NOT NULL AND o.e > o.nx - 50000 THEN greatest(greatest(o.s, f.e + 50000) + 300000, o.nx - 50000) ELSE o.e END
  FROM f JOIN o ON o.ep = f.ep AND o.n = f.n + 1)
SELECT ep, i, s, e FROM f""")
def sequential_clamp(spark, d):
    return sequence.sequential_clamp(events(spark, d).withColumn("e", F.col("e") + 2 * HOUR))


@register(f"""WITH {EV} SELECT ep, i,
coalesce(string_agg(text, '') OVER (PARTITION BY ep ORDER BY s, i ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), '') AS prev,
coalesce(string_agg(text, '') OVER (PARTITION BY ep ORDER BY s, i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING), '') AS next,
coalesce(string_agg(text, '') OVER (PARTITION BY ep ORDER BY s, i ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), '') AS last FROM ev""")
def context_strings(spark, d):
    return sequence.context_strings(events(spark, d))


@register(f"""WITH {EV} SELECT ep, i, sum(length(text) * 0.5::DOUBLE) OVER (PARTITION BY ep ORDER BY s, i ROWS UNBOUNDED PRECEDING) AS x FROM ev""")
def prefix_width(spark, d):
    return sequence.prefix_sums(events(spark, d), tx.text_em(F.col("text")), "x").select("ep", "i", "x")


@register(f"""WITH {EV} SELECT ep, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS covered,
count(*) FILTER (e - s > 0 AND length(text) * 1000000 > (e - s) * 10) AS cram FROM ev GROUP BY ep""")
def qa_stats(spark, d):
    return sequence.qa_stats(events(spark, d))


@register(f"""WITH {EV} SELECT ep, i, least(s, 1209600000000) AS s,
least(CASE WHEN e <= s THEN s + 300000 ELSE e END, 1209600000000) AS e FROM ev""")
def repair_and_cap(spark, d):
    return sequence.repair_and_cap(events(spark, d), F.lit(14 * 24 * HOUR)).select("ep", "i", "s", "e")


@register(f"""WITH {EV}, w AS (SELECT ep, list({{'ws': CASE WHEN i % 2 = 0 THEN s ELSE e END, 'we': CASE WHEN i % 2 = 0 THEN e
  ELSE s END, 'w': text}} ORDER BY s, i) AS words FROM ev GROUP BY ep),
u AS (SELECT ep, unnest(words) AS x, generate_subscripts(words, 1) - 1 AS w_i FROM w)
SELECT ep, ep AS seg_i, w_i, least(x.ws, x.we) AS s, greatest(greatest(x.ws, x.we), least(x.ws, x.we) + 50000) AS e, x.w AS text FROM u""")
def word_normalise(spark, d):
    """Every second word comes with its ends reversed."""
    even = F.col("i") % 2 == 0
    word = F.struct(
        "s",
        "i",
        F.struct(
            F.when(even, F.col("s")).otherwise(F.col("e")).alias("ws"),
            F.when(even, F.col("e")).otherwise(F.col("s")).alias("we"),
            F.col("text").alias("w"),
        ).alias("x"),
    )
    seg = events(spark, d).groupBy("ep").agg(
        F.min("s").alias("s"), F.max("e").alias("e"), F.lit("").alias("text"), F.array_sort(F.collect_list(word)).alias("l")
    )
    seg = seg.select("ep", F.col("ep").alias("seg_i"), "s", "e", "text", F.transform("l", lambda y: y["x"]).alias("words"))
    return sequence.normalise_words(seg).withColumn("w_i", F.col("w_i").cast("bigint"))


# ---------------------------------------------------------------- interval joins

WORDS = "w AS (SELECT * FROM ev WHERE text <> 'purchase'), iv AS (SELECT ep, i AS j, s AS cs, s + 21600000000 AS ce FROM ev WHERE text = 'purchase')"
OWNED = f"""{EV}, {WORDS}, d AS (
  SELECT w.ep, w.i, iv.j, w.s + w.e AS m,
    CASE WHEN 2 * cs <= w.s + w.e AND w.s + w.e <= 2 * ce THEN 0 ELSE 1 END AS tier,
    CASE WHEN 2 * cs <= w.s + w.e AND w.s + w.e <= 2 * ce THEN abs(w.s + w.e - cs - ce) WHEN w.s + w.e < 2 * cs THEN 2 * cs - w.s - w.e
      ELSE w.s + w.e - 2 * ce END AS dist
  FROM w JOIN iv ON w.ep = iv.ep),
best AS (SELECT *, row_number() OVER (PARTITION BY ep, i ORDER BY tier, dist, j) AS k FROM d WHERE tier = 0 OR dist <= 7200000000),
owned AS (SELECT w.*, best.j AS owner FROM w LEFT JOIN best ON best.ep = w.ep AND best.i = w.i AND k = 1)"""


def _words(ev):
    return ev.where("text <> 'purchase'")


@register(f"WITH {OWNED} SELECT ep, i, owner FROM owned")
def interval_assign(spark, d):
    ev = events(spark, d)
    return intervals.assign_intervals(
        _words(ev), of_type(ev, "purchase", 6 * HOUR, ("j", "cs", "ce")), HOUR, 6 * HOUR
    ).select("ep", "i", "owner")


#: Words of the events as a small language: for rules on where a text may break.
LEXICON = {
    "click": ("名詞",), "view": ("名詞",), "clickview": ("名詞",), "error": ("助詞", "格助詞"), "signup": ("感動詞",), "purchase": ("動詞",),
}


def event_tokens(text: str) -> list[grammar.Token]:
    """Longest words of ``LEXICON`` from left to right; other characters by themselves."""
    out, at = [], 0
    while at < len(text):
        n = next((k for k in range(9, 0, -1) if text[at : at + k] in LEXICON), 1)
        word = text[at : at + n]
        out.append(grammar.Token(word, word, LEXICON.get(word, ("記号",))))
        at += n
    return out


ALIGNED = f"""{EV},
w AS (SELECT ep, row_number() OVER (PARTITION BY ep ORDER BY s, i) AS i, s, e, text FROM ev WHERE text <> 'purchase'),
iv AS (SELECT ep, row_number() OVER (PARTITION BY ep ORDER BY s, i) AS j, s + i % 3 * 400 AS cs, s + i % 3 * 400 + 21600000000 AS ce FROM ev
  WHERE text = 'purchase'),
d AS (
  SELECT w.ep, w.i, iv.j, CASE WHEN 2 * cs <= w.s + w.e AND w.s + w.e <= 2 * ce THEN 0 ELSE 1 END AS tier,
    CASE WHEN 2 * cs <= w.s + w.e AND w.s + w.e <= 2 * ce THEN abs(w.s + w.e - cs - ce) WHEN w.s + w.e < 2 * cs THEN 2 * cs - w.s - w.e
      ELSE w.s + w.e - 2 * ce END AS dist
  FROM w JOIN iv ON w.ep = iv.ep),
best AS (SELECT *, row_number() OVER (PARTITION BY ep, i ORDER BY tier, dist, j) AS k FROM d WHERE tier = 0 OR dist <= 7200000000),
owned AS (SELECT w.*, best.j AS owner FROM w LEFT JOIN best ON best.ep = w.ep AND best.i = w.i AND k = 1),
c AS (SELECT *, CASE WHEN lag(1) OVER w IS NULL OR lag(owner) OVER w IS DISTINCT FROM owner THEN 1 ELSE 0 END AS c
  FROM owned WINDOW w AS (PARTITION BY ep ORDER BY i)),
r AS (SELECT *, sum(c) OVER (PARTITION BY ep ORDER BY i) AS run FROM c),
g AS (SELECT ep, run, owner, max(i) AS last_i, arg_max(s, i) AS last_s, arg_max(e, i) AS last_e, arg_max(text, i) AS a, arg_min(s, i) AS first_s, arg_min(e, i) AS first_e, arg_min(text, i) AS f
  FROM r GROUP BY ep, run, owner),
n AS (SELECT *, lead(owner) OVER w AS nxt, lead(first_s) OVER w AS b_s, lead(first_e) OVER w AS b_e, lead(f) OVER w AS b
  FROM g WINDOW w AS (PARTITION BY ep ORDER BY run)),
moved AS (SELECT n.ep, last_i AS i FROM n JOIN iv ON iv.ep = n.ep AND iv.j = n.owner
  WHERE owner < nxt AND b_s - last_e <= 21600000000 AND a <> 'error' AND (
    (last_s <= ce AND ce <= last_e + 3600000000 AND a = 'click' AND b = 'view')
    OR (last_s <= ce AND ce <= b_e + 3600000000 AND (b = 'error' OR (a = 'click' AND b = 'view')))
    OR (last_s < ce AND ce < last_e AND a = 'signup')))"""


@register(f"""WITH {ALIGNED}, p AS (SELECT r.ep, r.i, r.s, r.e, r.text, r.run + CASE WHEN moved.i IS NULL THEN 0 ELSE 1 END AS run FROM r LEFT
  JOIN moved ON moved.ep = r.ep AND moved.i = r.i),
t AS (SELECT p.ep, p.run, arg_min(p.s, p.i) AS ws, arg_max(p.e, p.i) AS we, string_agg(text, '' ORDER BY p.i) AS text FROM p GROUP BY p.ep, p.run),
x AS (SELECT t.ep, t.run, coalesce(iv.cs, ws) AS s, coalesce(iv.ce, we) AS e, t.text FROM t JOIN g ON g.ep = t.ep AND g.run = t.run LEFT
  JOIN iv ON iv.ep = g.ep AND iv.j = g.owner),
y AS (SELECT ep, run, s, CASE WHEN e <= s THEN s + 300000 ELSE e END AS e, text FROM x),
z AS (SELECT ep, run, s, text, CAST(round_even(s / 1000, 0) AS BIGINT) * 1000 AS a, CAST(round_even(e / 1000, 0) AS BIGINT) * 1000 AS b FROM y),
m AS (SELECT ep, a, b, string_agg(text, '' ORDER BY z.s, z.run) AS text FROM z GROUP BY ep, a, b)
SELECT ep, least(a, 1209600000000) AS s, least(b, 1209600000000) AS e, text FROM m""")
def align_timeline(spark, d):
    """Purchases are intervals of six hours, the other events words; a third of all cues lies past the cap."""
    ev = events(spark, d)
    n = F.row_number().over(W.partitionBy("ep").orderBy("s", "i")).cast("bigint")
    words = _words(ev).select("ep", n.alias("i"), "s", "e", "text")
    start = F.col("s") + F.col("i") % 3 * 400
    timeline = ev.where("text = 'purchase'").select("ep", n.alias("j"), start.alias("cs"), (start + 6 * HOUR).alias("ce"))
    rules = grammar.Rules(event_tokens)
    return segment.align_timeline(words, timeline, 14 * 24 * HOUR, HOUR, 6 * HOUR, rules, 6 * HOUR, HOUR)


@register(f"""WITH {ALIGNED} SELECT r.ep, r.i, CAST(r.run + CASE WHEN moved.i IS NULL THEN 0 ELSE 1 END AS BIGINT) AS run FROM r LEFT
  JOIN moved ON moved.ep = r.ep AND moved.i = r.i""")
def boundary_repair(spark, d):
    ev = events(spark, d)
    n = F.row_number().over(W.partitionBy("ep").orderBy("s", "i")).cast("bigint")
    start = F.col("s") + F.col("i") % 3 * 400
    timeline = ev.where("text = 'purchase'").select("ep", n.alias("j"), start.alias("cs"), (start + 6 * HOUR).alias("ce"))
    owned = intervals.assign_intervals(_words(ev).select("ep", n.alias("i"), "s", "e", "text"), timeline, HOUR, 6 * HOUR)
    return segment.repair_boundaries(
        sequence.runs(owned, "owner", "i"), timeline, grammar.Rules(event_tokens), 6 * HOUR, HOUR
    ).select("ep", "i", "run")


NEAREST = """SELECT p.ep, p.i, q.j, q.pa, q.pb, CASE WHEN pa <= p.t AND p.t <= pb THEN 0 ELSE least(abs(p.t - pa), abs(p.t - pb)) END AS dist
  FROM p JOIN q ON p.ep = q.ep"""


@register(f"""WITH {EV}, p AS (SELECT ep, i, s AS t FROM ev WHERE text = 'click'),
q AS (SELECT ep, i AS j, s AS pa, s + 600000000 AS pb FROM ev WHERE text = 'error'), n AS ({NEAREST}),
b AS (SELECT *, row_number() OVER (PARTITION BY ep, i ORDER BY dist, j DESC) AS k FROM n WHERE dist <= 3600000000)
SELECT p.ep, p.i, b.j AS pause, b.pa, b.pb FROM p LEFT JOIN b ON b.ep = p.ep AND b.i = p.i AND k = 1""")
def nearest_pause(spark, d):
    ev = events(spark, d)
    points = ev.where("text = 'click'").select("ep", "i", F.col("s").alias("t"))
    return intervals.nearest_pause(points, of_type(ev, "error", HOUR // 6, ("j", "pa", "pb")), HOUR).select("ep", "i", "pause", "pa", "pb")


@register(f"""WITH {EV}, g AS (SELECT ep, i, s, s + 7200000000 AS e FROM ev WHERE text = 'view'),
h AS (SELECT *, (e + lead(s) OVER (PARTITION BY ep ORDER BY i)) // 2 AS t FROM g),
p AS (SELECT ep, i, t FROM h WHERE t IS NOT NULL), q AS (SELECT ep, i AS j, s AS pa, s + 600000000 AS pb FROM ev WHERE text = 'error'),
n AS ({NEAREST}), b AS (SELECT *, row_number() OVER (PARTITION BY ep, i ORDER BY dist, j DESC) AS k FROM n WHERE dist <= 3600000000),
hit AS (SELECT p.ep, p.i, coalesce(b.pa, p.t) AS e2, coalesce(b.pb, p.t) AS s2 FROM p LEFT JOIN b ON b.ep = p.ep AND b.i = p.i AND k = 1),
o AS (SELECT ep, min(s) AS fa, arg_max(s + 3600000000, i) AS lb FROM ev WHERE text = 'signup' GROUP BY ep),
z AS (SELECT g.ep, g.i,
  coalesce(lag(hit.s2) OVER (PARTITION BY g.ep ORDER BY g.i), CASE WHEN abs(g.s - fa) <= 3600000000 THEN fa ELSE g.s END) AS s,
  coalesce(hit.e2, CASE WHEN abs(g.e - lb) <= 3600000000 THEN lb ELSE g.e END) AS e
  FROM g LEFT JOIN hit ON hit.ep = g.ep AND hit.i = g.i LEFT JOIN o ON o.ep = g.ep),
m AS (SELECT ep, i, s, max(greatest(s, e)) OVER (PARTITION BY ep ORDER BY i) AS m FROM z)
SELECT ep, i, greatest(s, coalesce(lag(m) OVER (PARTITION BY ep ORDER BY i), s)) AS s, m AS e FROM m""")
def segment_ranges(spark, d):
    ev = events(spark, d)
    segs = ev.where("text = 'view'").select("ep", "i", "s", (F.col("s") + 2 * HOUR).alias("e"))
    return segment.segment_ranges(
        segs, of_type(ev, "signup", HOUR), of_type(ev, "error", HOUR // 6, ("j", "pa", "pb")), HOUR
    ).select("ep", "i", "s", "e")


SPANS = "w AS (SELECT ep, i, s, s + 21600000000 AS e FROM ev WHERE text = 'purchase'), sp AS (SELECT ep, i AS j, s AS a, s + 3600000000 AS b FROM ev WHERE text = 'click')"


def _windows(ev):
    return of_type(ev, "purchase", 6 * HOUR, ("i", "s", "e"))


@register(f"""WITH {EV}, {SPANS} SELECT w.ep, w.i, sp.j, greatest(w.s, a) AS lo, least(w.e, b) AS hi FROM w JOIN sp ON w.ep = sp.ep
WHERE least(w.e, b) - greatest(w.s, a) > 20000""")
def interval_intersect(spark, d):
    ev = events(spark, d)
    return intervals.intersect_spans(_windows(ev), of_type(ev, "click", HOUR), bucket_us=6 * HOUR)


@register(f"""WITH {EV}, {SPANS} SELECT ep, i, s, e FROM w WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.ep = w.ep) OR EXISTS (
SELECT 1 FROM sp WHERE sp.ep = w.ep AND least(w.e + 3000000, b) - greatest(w.s - 3000000, a) >= 150000)""")
def window_near_speech(spark, d):
    ev = events(spark, d)
    return intervals.near_speech(_windows(ev), of_type(ev, "click", HOUR), bucket_us=6 * HOUR).select("ep", "i", "s", "e")


BASE = "nw AS (SELECT ep, i, s, s + 7200000000 AS e, text FROM ev WHERE text = 'error'), b AS (SELECT ep, i AS j, s AS bs, s + 10800000000 AS be, text FROM ev WHERE text IN ('view', 'click'))"


def _base(ev):
    new = ev.where("text = 'error'").select("ep", "i", "s", (F.col("s") + 2 * HOUR).alias("e"), "text")
    base = ev.where("text IN ('view', 'click')").select(
        "ep", F.col("i").alias("j"), F.col("s").alias("bs"), (F.col("s") + 3 * HOUR).alias("be"), "text"
    )
    return new, base


@register(f"""WITH {EV}, {BASE}, o AS (SELECT nw.ep, nw.i, b.j, (least(e, be) - greatest(s, bs)) / greatest(10000, e - s) AS share FROM nw
  JOIN b ON nw.ep = b.ep AND least(e, be) - greatest(s, bs) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY ep, i ORDER BY share DESC, j) AS k FROM o)
SELECT ep, i, j AS match, share FROM r WHERE k = 1 AND share >= 0.6""")
def max_overlap(spark, d):
    return intervals.max_overlap(*_base(events(spark, d)), bucket_us=3 * HOUR)


@register(f"""WITH {EV}, {BASE} SELECT nw.ep, nw.i, coalesce(string_agg(b.text, '' ORDER BY j), '') AS near_text
FROM nw LEFT JOIN b ON nw.ep = b.ep AND be > s - 7200000000 AND bs < e + 7200000000 GROUP BY nw.ep, nw.i""")
def neighbour_text(spark, d):
    return intervals.neighbour_text(*_base(events(spark, d)), around=2 * HOUR, bucket_us=3 * HOUR).select("ep", "i", "near_text")


_GRAMS = "list_distinct(list_transform(generate_series(1, len({0}) - 1), lambda k: {0}[k] || {0}[k + 1]))"
_CHARS = "list_filter(string_split(translate({0}, '。、！？…?!「」（）『』・　 ', ''), ''), lambda x: x <> '')"


@register(f"""WITH RECURSIVE {EV}, {BASE},
o AS (SELECT nw.ep, nw.i, max((least(e, be) - greatest(s, bs)) / greatest(10000, e - s)) AS share FROM nw JOIN b ON nw.ep = b.ep
  AND least(e, be) - greatest(s, bs) > 0 GROUP BY nw.ep, nw.i),
free AS (SELECT nw.* FROM nw LEFT JOIN o ON o.ep = nw.ep AND o.i = nw.i WHERE coalesce(share, 0) < 0.6
  AND length(translate(text, '。、！？…?!「」（）『』・　 ', '')) >= 2),
nt AS (SELECT free.ep, free.i, any_value(free.s) AS s, any_value(free.e) AS e, any_value(free.text) AS text, coalesce(string_agg(b.text, ''
  ORDER BY j), '') AS near_text
  FROM free LEFT JOIN b ON free.ep = b.ep AND be > free.s - 7200000000 AND bs < free.e + 7200000000 GROUP BY free.ep, free.i),
c AS (SELECT *, {_CHARS.format("text")} AS x, {_CHARS.format("near_text")} AS y
  FROM nt), g AS (SELECT *, {_GRAMS.format("x")} AS p, {_GRAMS.format("y")} AS q FROM c),
added AS (SELECT ep, i, s, e, text FROM g WHERE CASE WHEN len(p) > 0 AND len(q) > 0 THEN len(list_intersect(p, q)) / len(p) ELSE 0.0 END < 0.5),
u AS (SELECT ep, 0 AS src, j AS k, bs AS s, be AS e, text FROM b UNION ALL SELECT ep, 1, i, s, e, text FROM added),
n AS (SELECT ep, s, e, text, row_number() OVER w AS n, lead(s) OVER w AS nx FROM u WINDOW w AS (PARTITION BY ep ORDER BY s, src, k)),
f(ep, n, s, e) AS (
  SELECT ep, n, s, CASE WHEN nx IS NOT NULL AND e > nx - 50000 THEN greatest(s + 300000, nx - 50000) ELSE e END FROM n WHERE n = 1
  UNION ALL
  SELECT n.ep, n.n, greatest(n.s, f.e + 50000), CASE WHEN n.nx IS NOT NULL
    AND n.e > n.nx - 50000 THEN greatest(greatest(n.s, f.e + 50000) + 300000, n.nx - 50000) ELSE n.e END
  FROM f JOIN n ON n.ep = f.ep AND n.n = f.n + 1)
SELECT f.ep, f.n AS i, f.s, f.e, n.text FROM f JOIN n ON n.ep = f.ep AND n.n = f.n""")
def recover_missed(spark, d):
    new, base = _base(events(spark, d))
    return recover.recover(new, base, 2 * HOUR, 3 * HOUR)


@register(f"""WITH {EV}, {SPANS}, l AS (SELECT *, b - a AS len FROM sp) SELECT DISTINCT w.ep, w.i FROM w JOIN l ON w.ep = l.ep WHERE w.s <= a
  AND b <= w.e AND len >= 1500000""")
def silence_inside(spark, d):
    ev = events(spark, d)
    return catalog.silence_inside(_windows(ev), of_type(ev, "click", HOUR, ("j", "pa", "pb")), bucket_us=6 * HOUR).select("ep", "i")


# ---------------------------------------------------------------- texts


@register(f"""WITH {EV}, m AS (SELECT ep, i, s // 1000 AS ms FROM ev) SELECT ep, i,
printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS t FROM m""")
def fmt_srt_ts(spark, d):
    return events(spark, d).select("ep", "i", tx.srt_time(F.col("s")).alias("t"))


@register(f"""WITH {EV}, m AS (SELECT ep, i, CAST(round_even(s / 10000, 0) AS BIGINT) AS cs FROM ev) SELECT ep, i,
printf('%d:%02d:%02d.%02d', cs // 360000, cs // 6000 % 60, cs // 100 % 60, cs % 100) AS t FROM m""")
def fmt_ass_ts(spark, d):
    return events(spark, d).select("ep", "i", tx.ass_time(F.col("s")).alias("t"))


def _block(ms: str) -> str:
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


@register(f"""WITH {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY s, i) AS n FROM ev)
SELECT ep, string_agg(n || chr(10) || {_block("(s // 1000)")} || ' --> ' || {_block("(e // 1000)")} || chr(10) || text || chr(10), chr(10)
  ORDER BY n) AS srt FROM n GROUP BY ep""")
def srt_texts(spark, d):
    return layout.srt_texts(events(spark, d))


@register(f"""WITH {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY s, i) AS n FROM ev)
SELECT ep, n AS cue, s // 1000 * 1000 AS s, e // 1000 * 1000 AS e, text FROM n""")
def srt_roundtrip(spark, d):
    """Cues written as SRT texts and read back."""
    back = src.srt_cues(src.lines_of(layout.srt_texts(events(spark, d)), "ep", "srt"))
    return back.select(F.col("file").alias("ep"), F.col("cue").cast("bigint").alias("cue"), "s", "e", "text")


@register("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def turn_concat(spark, d):
    return read(spark, d, "conversations").groupBy("conv_id").agg(sequence.ordered_text("text", "turn", sep=" ").alias("text"))


PAIRS = """p AS (SELECT doc_id, text, lead(text) OVER (PARTITION BY source, lang ORDER BY doc_id) AS other FROM documents),
c AS (SELECT doc_id, list_filter(string_split(translate(text, '。、！？…?!「」（）『』・　 ', ''), ''), lambda x: x <> '') AS a,
  list_filter(string_split(translate(other, '。、！？…?!「」（）『』・　 ', ''), ''), lambda x: x <> '') AS b FROM p WHERE other IS NOT NULL),
g AS (SELECT doc_id, list_distinct(list_transform(generate_series(1, len(a) - 1), lambda k: a[k] || a[k + 1])) AS a,
  list_distinct(list_transform(generate_series(1, len(b) - 1), lambda k: b[k] || b[k + 1])) AS b FROM c),
o AS (SELECT doc_id, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0.0 END AS ratio FROM g)"""


def _pairs(spark, d):
    """Share of a document's character pairs that the next one of its source and language has."""
    docs = read(spark, d, "documents").select("doc_id", "source", "lang", "text")
    pairs = sequence.following(docs.select("source", "lang", "doc_id"), ["source", "lang"], "doc_id").where("next IS NOT NULL")
    grams = docs.select("doc_id", tx.bigram_codes(F.col("text"), tx.PUNCTUATION).alias("grams"))
    own, other = grams.alias("own"), grams.alias("other")  # one plan, so that one shuffle serves both
    both = pairs.select(F.col("doc_id").alias("id"), "next").join(own, F.col("id") == F.col("own.doc_id"))
    both = both.join(other, F.col("next") == F.col("other.doc_id"))
    ratio = F.when(F.col("other.grams").isNotNull(), tx.shared(F.col("own.grams"), F.col("other.grams")))
    return both.select(F.col("id").alias("doc_id"), ratio.alias("ratio")).where("ratio IS NOT NULL")


@register(f"WITH {PAIRS} SELECT doc_id, ratio FROM o")
def bigram_overlap(spark, d):
    return _pairs(spark, d)


@register(f"WITH {PAIRS} SELECT doc_id FROM o WHERE ratio < 0.5")
def similarity_anti(spark, d):
    return _pairs(spark, d).where("ratio < 0.5").select("doc_id")


@register("""SELECT doc_id, length(text) - length(regexp_replace(text, '[^\\x20-\\x7E]', '', 'g')) * 0.5::DOUBLE AS em FROM documents""")
def text_em(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.text_em(F.col("text")).alias("em"))


@register("""SELECT doc_id, md5(replace(replace(replace(text, '\\', '\\\\'), '{', '\\{'), '}', '\\}')) AS escaped,
length(translate(text, '。、！？…?!「」（）『』・　 ', '')) AS content FROM documents""")
def escape_and_strip(spark, d):
    return read(spark, d, "documents").select(
        "doc_id",
        F.md5(tx.escape_ass(F.col("text"))).alias("escaped"),
        F.length(tx.strip_punct(F.col("text"))).cast("bigint").alias("content"),
    )


@register("""SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9)
  || chr(13))), lambda x: x <> '')[1] AS line FROM documents""")
def first_lines(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.first_line(F.col("text")).alias("line"))


@register("""SELECT page_id, left(trim(regexp_replace(html, '\\s+', ' ', 'g')), 200) AS reason FROM pages""")
def error_text(spark, d):
    return read(spark, d, "pages").select("page_id", tx.one_line(F.col("html")).alias("reason"))


@register("""SELECT doc_id, contains(lower(text), 'license') OR contains(lower(text), 'copyright') AS hit FROM documents""")
def error_classes(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.mentions(F.col("text"), ["License", "copyright"]).alias("hit"))


@register("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
SELECT doc_id AS file, line_no, line FROM l""")
def text_lines(spark, d):
    return src.lines_of(read(spark, d, "documents"), "doc_id", "text").withColumn("line_no", F.col("line_no").cast("bigint"))


def _split_sql(lines: str, limit: int) -> str:
    """``leaf``: the parts (lo, hi] of the lines ``lines`` (k, line), halved until they are short enough."""
    particles = "|".join(kana.SPLIT_PARTICLES)
    return f"""l AS ({lines}),
pos AS (SELECT k, i, CASE WHEN contains('{tx.SPLIT_PUNCT}', substr(line, i, 1)) THEN 12
  WHEN regexp_matches(left(line, i), '({particles})$') THEN 6 ELSE 0 END AS gain
  FROM (SELECT k, line, unnest(generate_series(1, length(line))) AS i FROM l WHERE length(line) > {limit}) x),
f(k, lo, hi) AS (SELECT k, 0::BIGINT, length(line)::BIGINT FROM l UNION ALL
  SELECT c.k, CASE WHEN h = 0 THEN c.lo ELSE c.cut END, CASE WHEN h = 0 THEN c.cut ELSE c.hi END FROM (
    SELECT f.k, f.lo, f.hi, arg_min(pos.i, (abs(pos.i - f.lo - (f.hi - f.lo) / 2) - gain, pos.i)) AS cut
    FROM f JOIN pos ON pos.k = f.k AND pos.i >= f.lo + 8 AND pos.i <= f.hi - 9 WHERE f.hi - f.lo > {limit}
      GROUP BY f.k, f.lo, f.hi) c, (VALUES (0), (1)) AS t(h)),
leaf AS (SELECT f.k, lo, hi, row_number() OVER (PARTITION BY f.k ORDER BY lo) - 1 AS part, substr(line, lo + 1, hi - lo) AS text FROM f
  JOIN l ON l.k = f.k WHERE hi - lo <= {limit})"""


_BENCH_LINES = """SELECT (item_id, n) AS k, line FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM benchmark) x"""


@register(f"""WITH RECURSIVE {_split_sql(_BENCH_LINES, 40)} SELECT k[1] AS file, k[2] AS line_no, part, text FROM leaf""")
def split_long(spark, d):
    """Lines of benchmark items in parts of at most 40 characters."""
    lines = src.lines_of(read(spark, d, "benchmark"), "item_id", "text")
    parts = lines.select(
        "file",
        F.col("line_no").cast("bigint").alias("line_no"),
        F.posexplode(kana.split_long_column(F.col("line"), 40)).alias("part", "text"),
    )
    return parts.withColumn("part", F.col("part").cast("bigint"))


_TURNS = "SELECT (conv_id, turn) AS k, text AS line FROM conversations WHERE text IS NOT NULL"


@register(f"""WITH RECURSIVE {_split_sql(_TURNS, 40)}, c AS (SELECT k, turn * 10000000 AS s, greatest(length(text), 1) AS n
  FROM (SELECT (conv_id, turn) AS k, turn, text FROM conversations WHERE text IS NOT NULL) y)
SELECT leaf.k[1] AS ep, leaf.k[2] AS i, part, CAST(trunc(s + 10000000 * lo / n) AS BIGINT) AS s, CAST(trunc(s + 10000000 * hi / n) AS BIGINT) AS e, text FROM leaf JOIN c ON c.k = leaf.k""")
def expand_long(spark, d):
    """Turns as cues of ten seconds, parts with times in proportion to their characters."""
    at = (F.col("turn") * 10_000_000).cast("bigint")
    cues = read(spark, d, "conversations").where("text IS NOT NULL").select(
        F.col("conv_id").alias("ep"), F.col("turn").alias("i"), at.alias("s"), (at + 10_000_000).alias("e"), "text"
    )
    return segment.expand_long(cues, 40).withColumn("part", F.col("part").cast("bigint"))


DICT = {"the": "da", "th": "z", "tion": "shun", "ing": "ingu", "er": "a", "ung": "unku", "ciónes": "sio", "ent": "en"}


@register(f"""WITH RECURSIVE k(key) AS (VALUES {", ".join(f"('{k}')" for k in DICT)}),
m AS (SELECT item_id, i, max_by(key, length(key)) AS key FROM (SELECT item_id, text, unnest(generate_series(1, length(text))) AS i FROM benchmark) b
  JOIN k ON substr(text, i, length(key)) = key GROUP BY item_id, i),
f(item_id, i, key, pos) AS (SELECT item_id, 0::BIGINT, ''::VARCHAR, 1::BIGINT FROM benchmark UNION ALL
  SELECT x.item_id, x.i, x.key, x.i + length(x.key) FROM (
    SELECT f.item_id, m.i, m.key, row_number() OVER (PARTITION BY f.item_id ORDER BY m.i) AS r FROM f JOIN m ON m.item_id = f.item_id
      AND m.i >= f.pos) x WHERE r = 1)
SELECT item_id, i - 1 AS "offset", length(key) AS length, key FROM f WHERE i > 0""")
def dict_longest_match(spark, d):
    entries = dict(DICT)

    @F.pandas_udf("array<struct<offset:bigint,key:string>>")
    def spans(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"offset": o, "key": k} for o, k in kana.longest_matches(t or "", entries)])

    x = read(spark, d, "benchmark").select("item_id", F.explode(spans("text")).alias("x"))
    return x.select("item_id", "x.offset", F.length("x.key").cast("bigint").alias("length"), "x.key")


KANA = {
    "食べる": ("タベル", "動詞"),
    "連れ去り": ("ツレサリ", "名詞"),
    "今日": ("キョウ", "名詞"),
    "神": ("カミ", "名詞"),
    "々": ("*", "記号"),
    "は": ("ハ", "助詞"),
    "カタカナ": ("*", "名詞"),
}


@register("""SELECT * FROM (VALUES (1, 0, 2, 'きょう'), (1, 3, 1, 'た'), (2, 0, 1, 'つ'), (2, 2, 1, 'さ'), (3, 0, 2, 'かみがみ'), (4, 0, 4, 'かたかな'),
(5, 0, 2, 'たま'), (5, 3, 2, 'きょう')) AS t(id, "offset", length, ruby)""")
def kana_annotate(spark, d):
    """Inline sentences with a small lexicon, as the tables hold no Japanese."""
    rows = spark.createDataFrame([(1, "今日は食べる"), (2, "連れ去り"), (3, "神々"), (4, "カタカナ"), (5, "小玉は今日"), (6, "")], "id int, text string")
    x = rows.select("id", F.explode(kana.ruby_column(F.col("text"), {"小玉": "たま"}, kana.LexiconTokenizer(KANA))).alias("x"))
    return x.select("id", "x.*")


@register("""SELECT * FROM (VALUES (1, 'かたかな', 'が', 0, 4), (2, 'ひらがな', 'ぴらがな', 0, 0), (3, '漢字かな', '漢字かな', 2, 0)) AS t(id, hira, voiced, kanji, kata)""")
def kana_scalars(spark, d):
    t = spark.sql("SELECT * FROM VALUES (1, 'カタカナ', 'か'), (2, 'ひらがな', 'ぴらがな'), (3, '漢字かな', '漢字かな') AS t(id, text, first)")
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("int")
    return t.select(
        "id",
        tx.to_hira(F.col("text")).alias("hira"),
        tx.rendaku(F.col("first")).alias("voiced"),
        count(tx.KANJI).alias("kanji"),
        count(tx.KATA).alias("kata"),
    )


# ---------------------------------------------------------------- picks, plans, checks, summaries


@register(f"""WITH {EV}, c AS (SELECT ep, text, count(*) AS n, min((s, i)) AS f, arg_min(value, (s, i)) AS reading FROM ev GROUP BY ep, text),
r AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY n DESC, f) AS rank FROM c) SELECT ep, text, n, reading, rank FROM r WHERE rank <= 3""")
def topk_candidates(spark, d):
    ev = events(spark, d)
    first = ev.groupBy("ep", "text").agg(F.min_by("value", F.struct("s", "i")).alias("reading"))
    top = catalog.top_keys(ev, ["ep"], "text", ["s", "i"], 3)
    return top.join(first, ["ep", "text"]).select("ep", "text", "n", "reading", F.col("rank").cast("bigint").alias("rank"))


@register("""SELECT l_partkey, n FROM (SELECT l_partkey, count(*) AS n, min((l_orderkey, l_linenumber)) AS f FROM lineitem
  GROUP BY l_partkey) ORDER BY n DESC, f LIMIT 40""")
def top_parts(spark, d):
    return catalog.most_common(read(spark, d, "lineitem"), "l_partkey", ["l_orderkey", "l_linenumber"])


@register(f"""WITH {EV} SELECT ep, text, arg_max(value, (s, i)) AS value FROM ev GROUP BY ep, text""")
def settings_resolve(spark, d):
    x = events(spark, d).withColumn("layer", F.struct("s", "i"))
    return catalog.layered(x, ["ep", "text"]).select("ep", "text", "value")


@register(f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY text <> 'purchase', i) AS k
  FROM ev) SELECT ep, i, text, text <> 'purchase' AS fallback FROM r WHERE k = 1""")
def preferred_track(spark, d):
    ev = events(spark, d).select("ep", "i", "text")
    return catalog.preferred(ev, "ep", "i", F.col("text") == "purchase")


@register("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus IN ('F', 'O'))")
def pending_media(spark, d):
    streams = read(spark, d, "orders").select(
        F.col("o_custkey").alias("c_custkey"),
        F.lit("subtitle").alias("codec_type"),
        F.when(F.col("o_orderstatus").isin("F", "O"), "JPN").otherwise("eng").alias("language"),
    )
    return catalog.pending(read(spark, d, "customer"), streams, "c_custkey").select("c_custkey", "c_name")


@register("""SELECT o_orderkey, concat_ws(';', CASE WHEN coalesce(n, 0) = 0 THEN 'no lines' END, CASE
  WHEN NOT coalesce(n <= 4, false) THEN 'too many lines' END,
CASE WHEN NOT coalesce(flags = 'N', false) THEN 'flags' END) AS problems
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, string_agg(DISTINCT l_returnflag, '' ORDER BY l_returnflag) AS flags FROM lineitem
  GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def verify_diff(spark, d):
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), "").alias("flags")
    )
    x = read(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return x.select(
        "o_orderkey",
        catalog.problems(
            (F.col("n") > 0, "no lines"), (F.col("n") <= 4, "too many lines"), (F.col("flags") == "N", "flags")
        ).alias("problems"),
    )


@register("""SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total, sum(CAST(round(o_totalprice * 100) AS BIGINT)) / count(*) AS mean FROM orders GROUP BY o_orderstatus""")
def run_summary(spark, d):
    return catalog.run_summary(read(spark, d, "orders"), "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("bigint"))


@register("""SELECT l_orderkey AS path, concat_ws(',', string_agg(l_linenumber, ',' ORDER BY l_linenumber) FILTER (l_returnflag <> 'R'), '99',
string_agg(l_linenumber, ',' ORDER BY l_linenumber) FILTER (l_returnflag = 'R')) AS track_order FROM lineitem GROUP BY l_orderkey""")
def track_plan(spark, d):
    t = read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("path"),
        F.when(F.col("l_returnflag") == "R", "subtitles").otherwise("video").alias("kind"),
        F.col("l_linenumber").alias("track_id"),
    )
    return catalog.track_plan(t, F.lit(99))


@register("""SELECT l_orderkey AS path, array_to_string(list_filter([min(l_linenumber) FILTER (l_returnflag = 'R'), min(l_linenumber) FILTER (l_returnflag = 'A')], lambda x: x IS NOT NULL), ',') AS keep FROM lineitem GROUP BY l_orderkey""")
def keep_list(spark, d):
    first = lambda f: F.min(F.when(F.col("l_returnflag") == f, F.col("l_linenumber")))
    x = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(first("R").alias("a"), first("A").alias("b"))
    return x.select("path", F.array_join(catalog.keep_list(F.col("a"), F.col("b")).cast("array<string>"), ",").alias("keep"))


@register("""SELECT l_orderkey AS path, arg_min(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) AS track_id FROM lineitem
  WHERE l_returnflag = 'R' GROUP BY l_orderkey""")
def first_track(spark, d):
    """Lines of an order as tracks of a container; returned ones are Japanese."""
    lines = read(spark, d, "lineitem")
    at = [F.col("l_orderkey").alias("path"), (F.col("l_linenumber").cast("bigint") * 1_000_000_000 + F.col("l_partkey")).alias("pos")]
    language = F.when(F.col("l_returnflag") == "R", "JPN").when(F.col("l_returnflag") == "A", "chi").otherwise("eng")
    tracks = lines.select(*at, F.col("l_partkey").alias("track_id")).distinct()  # streams at one place may differ in language: all stay
    return catalog.first_track(tracks, lines.select(*at, language.alias("language")), catalog.JAPANESE)


_STREAMS = """s AS (SELECT l_orderkey AS path, l_linenumber::BIGINT * 1000000000 + l_partkey AS index, CASE l_linenumber WHEN 1 THEN 'video'
  WHEN 2 THEN 'audio' WHEN 4 THEN 'attachment' ELSE 'subtitle' END AS codec_type,
l_linestatus AS codec_name, CASE l_returnflag WHEN 'R' THEN 'jpn' WHEN 'A' THEN 'chi' ELSE 'eng' END AS language, CASE
  WHEN l_quantity > 25 THEN 'Japanese' ELSE 'other' END AS title,
CAST(l_quantity AS INT) AS width, l_linenumber AS height, l_tax FROM lineitem)"""


def _streams(spark, d):
    """Lines of an order as streams of a file; an index may repeat, ``place`` is where the table has the line."""
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    kind = F.when(n == 1, "video").when(n == 2, "audio").when(n == 4, "attachment").otherwise("subtitle")
    return read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("path"), (
            n.cast("bigint") * 1_000_000_000 + F.col("l_partkey")
        ).alias("index"), kind.alias("codec_type"), F.col("l_linestatus").alias("codec_name"),
        F.when(flag == "R", "JPN").when(flag == "A", "chi").otherwise("eng").alias("language"),
        F.when(F.col("l_quantity") > 25, "Japanese").otherwise("other").alias("title"), F.col("l_quantity").cast("int").alias("width"), n.alias("height"), "l_tax",
        F.struct("_metadata.file_path", "_metadata.row_index").alias("place"),
    )


@register(f"""WITH {_STREAMS}, sig AS (SELECT path, l_tax, index, codec_type, codec_type || ':' || codec_name AS av, language, title FROM s),
old AS (SELECT path, coalesce(list(av ORDER BY index) FILTER (codec_type IN ('audio', 'video')), []) AS av, count(*) FILTER (codec_type = 'attachment') AS att FROM sig GROUP BY path),
new AS (SELECT path, coalesce(list(av ORDER BY index) FILTER (codec_type IN ('audio', 'video')), []) AS av, count(*) FILTER (codec_type = 'attachment') AS att,
  coalesce(list((language, title) ORDER BY index) FILTER (codec_type = 'subtitle'), []) AS subs, count(*) FILTER (codec_type = 'subtitle') AS n, bool_or(codec_type = 'subtitle' AND language = 'jpn') AS jp
  FROM sig WHERE l_tax <> 0.05 GROUP BY path)
SELECT old.path, concat_ws(';', CASE WHEN NOT coalesce(old.av = new.av, false) THEN 'streams' END, CASE
  WHEN NOT coalesce(old.att = new.att, false) THEN 'attachments' END,
  CASE WHEN NOT coalesce(n > 0 AND subs[1] = ('jpn', 'Japanese'), false) THEN 'first subtitle' END, CASE
    WHEN NOT coalesce(n <= 2, false) THEN 'too many subtitles' END,
  CASE WHEN NOT coalesce(jp, false) THEN 'no Japanese subtitle' END) AS problems FROM old LEFT JOIN new ON new.path = old.path""")
def verify_mux(spark, d):
    """Orders as files; the second look misses the streams of one tax rate."""
    streams = _streams(spark, d)
    return catalog.verify_mux(streams, streams.where("l_tax <> 0.05"), order=("index", "place"))


@register(f"""WITH {_STREAMS}, v AS (SELECT path, arg_min(width, index) FILTER (codec_type = 'video') AS w, arg_min(height, index) FILTER (codec_type = 'video') AS h FROM s WHERE l_tax <> 0.05 GROUP BY path)
SELECT path, coalesce(w, 1920) AS width, coalesce(h, 1080) AS height FROM v""")
def video_size(spark, d):
    return src.video_size(_streams(spark, d).where("l_tax <> 0.05"), order=("index", "place"))


@register("""WITH t AS (SELECT l_suppkey AS folder, l_orderkey * 10 + l_linenumber AS pos, CASE l_returnflag WHEN 'R' THEN '小玉'
  WHEN 'A' THEN '神' ELSE '東京' END AS surface,
  CASE WHEN l_linenumber % 2 = 1 THEN CASE l_returnflag WHEN 'R' THEN 'こだま' ELSE 'とうきょう' END ELSE '?' END AS reading FROM lineitem),
c AS (SELECT folder, surface, arg_min(reading, pos) AS reading, count(*) AS n, min(pos) AS f FROM t WHERE surface <> '神' GROUP BY folder, surface)
SELECT folder, surface, reading, n, row_number() OVER (PARTITION BY folder ORDER BY n DESC, f, surface) AS rank FROM c""")
def name_candidates(spark, d):
    """Lines of a supplier as tokens of a folder; one surface is too short, some readings are missing."""
    flag, odd = F.col("l_returnflag"), F.col("l_linenumber") % 2 == 1
    tokens = read(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("folder"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.when(flag == "R", "小玉").when(flag == "A", "神").otherwise("東京").alias("surface"), F.lit("名詞,固有名詞,一般").alias("part_of_speech"),
        F.when(~odd, "*").when(flag == "R", "コダマ").otherwise("トウキョウ").alias("reading"),
    )
    return catalog.candidates(tokens).withColumn("rank", F.col("rank").cast("bigint"))


@register(f"""WITH {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY s, i) AS n
  FROM ev) SELECT ep AS file, n * 4 - 2 AS line_no, s // 1000 * 1000 AS s, e // 1000 * 1000 AS e FROM n""")
def srt_intervals(spark, d):
    lines = src.lines_of(layout.srt_texts(events(spark, d)), "ep", "srt")
    return src.srt_timeline(lines).withColumn("line_no", F.col("line_no").cast("bigint"))


_KANA = "repeat('か', CAST(2 + i % 9 AS INT))"


@register(f"""WITH {EV}, c AS (SELECT *, CAST(round_even(s / 10000, 0) AS BIGINT) AS a, CAST(round_even(e / 10000, 0) AS BIGINT) AS b, 2 + i % 9 AS k, (1920 - length(text) * 30.0::DOUBLE) / 2 AS x0 FROM ev),
z AS (SELECT *, CASE WHEN k * 27 <= 60 THEN 27 ELSE greatest(18, 60 // k) END AS size FROM c)
SELECT ep, i, 0 AS "offset", 'Dialogue: 0,' || printf('%d:%02d:%02d.%02d', a // 360000, a // 6000 % 60, a // 100 % 60, a % 100) || ','
  || printf('%d:%02d:%02d.%02d', b // 360000, b // 6000 % 60, b // 100 % 60, b % 100) ||
',RB,,0,0,0,,' || printf('{{\\an7\\pos(%.1f,%.1f)', least(greatest(x0 + (60 - k * size) / 2, 6), 1914 - k * size)::DOUBLE, 937.0::DOUBLE)
  || CASE WHEN size = 27 THEN '' ELSE printf('\\fs%.1f', size::DOUBLE) END || '}}' || {_KANA} AS line FROM z""")
def ruby_lines(spark, d):
    """Readings of two to ten characters over the first two of each cue."""
    ev = events(spark, d)
    spans = ev.select("ep", "i", F.lit(0).alias("offset"), F.lit(2).alias("length"), F.expr(_KANA).alias("ruby_text"))
    return layout.ruby_events(ev, spans)


@register("""SELECT l_orderkey, string_agg(l_returnflag, '' ORDER BY l_returnflag) AS names, bool_or(l_returnflag = 'R') AS some, bool_and(l_quantity < 40) AS every FROM lineitem GROUP BY l_orderkey""")
def sorted_multiset(spark, d):
    g = read(spark, d, "lineitem").groupBy("l_orderkey")
    return g.agg(
        F.array_join(F.array_sort(F.collect_list("l_returnflag")), "").alias("names"),
        F.bool_or(F.col("l_returnflag") == "R").alias("some"),
        F.bool_and(F.col("l_quantity") < 40).alias("every"),
    )


@register(f"""WITH {EV}, c AS (SELECT ep, text, count(*) AS n, min((s, i)) AS f, arg_min(value, (s, i)) AS v FROM ev GROUP BY ep, text),
r AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY n DESC, f) AS rank FROM c),
o AS (SELECT * FROM r WHERE NOT (text = 'purchase' AND ep % 2 = 0))
SELECT ep AS folder, count(*) AS n, string_agg('#' || text || chr(9) || CAST(CAST(trunc(v * 100) AS BIGINT) AS VARCHAR) || chr(9) || '出现 ' || n
  || ' 次', chr(10) ORDER BY rank) AS section FROM o GROUP BY ep""")
def dict_update(spark, d):
    ev = events(spark, d)
    first = ev.groupBy("ep", "text").agg(
        F.min_by((F.col("value") * 100).cast("bigint").cast("string"), F.struct("s", "i")).alias("reading")
    )
    found = catalog.top_keys(ev, ["ep"], "text", ["s", "i"]).join(first, ["ep", "text"]).withColumnsRenamed({"ep": "folder", "text": "surface"})
    defined = ev.where("ep % 2 = 0").select(F.col("ep").alias("folder"), F.lit("purchase").alias("surface")).distinct()
    return catalog.dictionary_update(found, defined)


@register(f"""WITH {EV} SELECT ep, i, e - s > 60000000 AS too_long, length(text) > 6 AS too_wide FROM ev WHERE e - s > 60000000 OR length(text) > 6""")
def review_flags(spark, d):
    return catalog.review_flags(events(spark, d), 60_000_000, 6)


@register(f"""WITH {EV}, n AS (SELECT ep, i, text, row_number() OVER (PARTITION BY ep ORDER BY s, i) AS n FROM ev),
m AS (SELECT ep, n AS seam, CASE WHEN i % 2 = 0 THEN 'merge' ELSE 'split' END AS kind FROM n WHERE text = 'view'), c AS (SELECT ep, n AS cut
  FROM n WHERE text = 'error')
SELECT ep, seam, kind, CASE WHEN kind = 'merge' THEN NOT EXISTS (SELECT 1 FROM c WHERE c.ep = m.ep AND c.cut = m.seam)
ELSE EXISTS (SELECT 1 FROM c WHERE c.ep = m.ep AND abs(c.cut - m.seam) <= 1) END AS passed FROM m""")
def mark_score(spark, d):
    n = events(spark, d).withColumn("n", F.row_number().over(W.partitionBy("ep").orderBy("s", "i")).cast("bigint"))
    marks = n.where("text = 'view'").select(
        "ep", F.col("n").alias("seam"), F.when(F.col("i") % 2 == 0, "merge").otherwise("split").alias("kind")
    )
    return catalog.mark_score(marks, n.where("text = 'error'").select("ep", F.col("n").alias("cut")))


@register("""WITH x AS (SELECT l_orderkey AS ep, 0::BIGINT AS i, CAST(round(l_discount * 100) AS BIGINT) AS x FROM lineitem)
SELECT ep, i, count(*) AS n FROM x GROUP BY ep, i HAVING sum(x * x) < 4.0 * 4.0 * count(*)""")
def silence_filter(spark, d):
    x = read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("ep"), F.lit(0).cast("bigint").alias("i"), F.round(F.col("l_discount") * 100).cast("bigint").alias("x")
    )
    return recover.silent_windows(x, 4.0)


@register("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_probe(spark, d):
    return read(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@register("""SELECT * FROM (VALUES ('a', 1, 'audio', 'jpn', true), ('a', 2, 'subtitle', 'chi', false), ('b', 0, 'video', NULL, false)) AS t(path, index, codec_type, language, japanese)""")
def probe_streams(spark, d):
    j = """SELECT * FROM VALUES ('a', '{"streams":[{"index":1,"codec_type":"audio","tags":{"language":"JPN"}},{"index":2,"codec_type":"subtitle","tags":{"language":"chi"}}]}'),
    ('b', '{"streams":[{"index":0,"codec_type":"video","width":10,"height":20}]}'), ('c', 'broken') AS t(path, json)"""
    x = src.probe_streams(spark.sql(j))
    return x.select(
        "path", "index", "codec_type", "language", F.coalesce(F.col("language").isin(catalog.JAPANESE), F.lit(False)).alias("japanese")
    )


_FILES = {
    "m": ["File: Track ID 0: video (AVC)", "Track ID 1: audio (AAC)", "chapters", "Track ID 3: subtitles (ASS)"],
    "i": ["; note", "[Paths]", "FFmpeg = C:/x = y ", "bad line", "[align]", "mode: jp", "mode = cn"],
    "d": ["# head", "小玉\tたま", "神,かみ 3 times", "小玉 こだま", "alone"],
}


def _files(spark):
    return src.lines_of(spark.createDataFrame([(k, "\n".join(v)) for k, v in _FILES.items()], "file string, body string"), "file", "body")


@register("SELECT * FROM (VALUES ('m', 1, 0, 'video'), ('m', 2, 1, 'audio'), ('m', 4, 3, 'subtitles')) AS t(file, pos, track_id, kind)")
def mux_tracks(spark, d):
    return src.mux_tracks(_files(spark))


@register("SELECT * FROM (VALUES ('i', 'Paths', 'ffmpeg', 'C:/x = y'), ('i', 'align', 'mode', 'cn')) AS t(file, section, key, value)")
def ini_settings(spark, d):
    return src.ini_settings(_files(spark).where("file = 'i'"))


@register("SELECT * FROM (VALUES ('d', '小玉', 'こだま'), ('d', '神', 'かみ')) AS t(file, surface, reading)")
def dict_scan(spark, d):
    return src.dictionary(_files(spark).where("file = 'd'"))


@register("""SELECT p_brand, arg_max(v, list_transform(string_split(v, '.'), lambda x: CAST(x AS INT))) AS newest FROM
(SELECT p_brand, p_size || '.' || (p_partkey % 17) || '.' || p_partkey AS v FROM part) GROUP BY p_brand""")
def version_max(spark, d):
    v = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 17).cast("string"), F.col("p_partkey").cast("string"))
    return read(spark, d, "part").withColumn("v", v).groupBy("p_brand").agg(F.max_by("v", tx.version_key(F.col("v"))).alias("newest"))


@register("""SELECT o_orderkey, TRY_CAST(left(o_orderpriority, 1) AS INT) AS level, TRY_CAST(nullif(o_orderpriority, '') AS INT) AS bad FROM orders""")
def tolerant_int(spark, d):
    return read(spark, d, "orders").select(
        "o_orderkey",
        tx.tolerant_int(F.left("o_orderpriority", F.lit(1))).alias("level"),
        tx.tolerant_int(F.col("o_orderpriority")).alias("bad"),
    )


@register("""SELECT * FROM (VALUES ('a', 'E', 'env'), ('b', NULL, NULL), ('c', 'C', 'config'), ('d', 'P', 'path'), ('e', 'B', 'bundled')) AS t(tool, found, origin)""")
def resolve_tool(spark, d):
    return catalog.resolve_tool(spark.sql("""SELECT * FROM VALUES ('a', 'E', true, 'C', true, 'P', 'B'), ('b', 'E', false, 'C', true, 'P', 'B'),
    ('c', NULL, false, 'C', true, 'P', 'B'), ('d', NULL, false, 'C', false, 'P', 'B'), ('e', NULL, false, NULL, false, NULL, 'B') AS t(tool, env, env_ok, conf, conf_ok, path, bundled)"""))


@register("SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity > 49)")
def missing_parts(spark, d):
    present = read(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return catalog.missing(read(spark, d, "supplier").select("s_suppkey"), present, "s_suppkey")


# ---------------------------------------------------------------- layout


@register(f"""WITH {EV}, w AS (SELECT ep, max(length(text) * 8 * 0.5::DOUBLE) AS widest FROM ev GROUP BY ep)
SELECT ep, widest, CASE WHEN widest * 60 > 1840 THEN greatest(24, CAST(floor(1840 / widest) AS INT)) ELSE 60 END AS main,
CASE WHEN widest * 60 > 1840 THEN greatest(12, CAST(floor(greatest(24, floor(1840 / widest)) * (27 / 60)) AS INT)) ELSE 27 END AS ruby FROM w""")
def plan_layout(spark, d):
    return layout.plan_layout(events(spark, d).withColumn("text", F.repeat("text", 8)))


@register(f"""WITH {EV}, c AS (SELECT *, CAST(round_even(s / 10000, 0) AS BIGINT) AS a, CAST(round_even(e / 10000, 0) AS BIGINT) AS b FROM ev)
SELECT ep, i, 'Dialogue: 0,' || printf('%d:%02d:%02d.%02d', a // 360000, a // 6000 % 60, a // 100 % 60, a % 100) || ',' ||
printf('%d:%02d:%02d.%02d', b // 360000, b // 6000 % 60, b // 100 % 60, b % 100) || ',JP,,0,0,0,,'
  || printf('{{\\an7\\pos(%.1f,%.1f)}}', (1920 - length(text) * 30.0::DOUBLE) / 2, 970.0::DOUBLE) || text AS line FROM c""")
def ass_events(spark, d):
    return layout.main_events(events(spark, d))


_HEAD = "\n".join(
    [
        "[Script Info]", "ScriptType: v4.00+", "PlayResX: 1920", "PlayResY: 1080", "WrapStyle: 2", "ScaledBorderAndShadow: yes", "YCbCr Matrix: TV.601", "", "[V4+ Styles]",
        "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding",
        "Style: JP,MS Gothic,60.0,&H00FFFFFF,&H000000FF,&H00000000,&H7F000000,-1,0,0,0,100,100,0,0,1,3,0,7,0,0,0,1", "Style: RB,MS Gothic,27.0,&H00FFFFFF,&H000000FF,&H00000000,&H7F000000,-1,0,0,0,100,100,0,0,1,2,0,7,0,0,0,1",
        "", "[Events]", "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text",
    ]
)


@register(f"""WITH {EV}, c AS (SELECT *, CAST(round_even(s / 10000, 0) AS BIGINT) AS a, CAST(round_even(e / 10000, 0) AS BIGINT) AS b FROM ev),
l AS (SELECT ep, s, i, 'Dialogue: 0,' || printf('%d:%02d:%02d.%02d', a // 360000, a // 6000 % 60, a // 100 % 60, a % 100) || ',' ||
printf('%d:%02d:%02d.%02d', b // 360000, b // 6000 % 60, b // 100 % 60, b % 100) || ',JP,,0,0,0,,'
  || printf('{{\\an7\\pos(%.1f,%.1f)}}', (1920 - length(text) * 30.0::DOUBLE) / 2, 970.0::DOUBLE) || text AS line FROM c)
SELECT ep, '{_HEAD}' || chr(10) || string_agg(line, chr(10) ORDER BY s, i) || chr(10) AS ass FROM l GROUP BY ep""")
def ass_texts(spark, d):
    return layout.ass_texts(events(spark, d))


@register(f"""WITH {EV}, s AS (SELECT ep, i, text FROM ev WHERE text IN ('view', 'click', 'error')),
p AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY text <> 'click', i) AS k FROM s)
SELECT p.ep AS path, p.text AS language, p.text <> 'click' AS fallback, 1::BIGINT AS n, ev.e AS max_end FROM p JOIN ev ON ev.ep = p.ep
  AND ev.i = p.i WHERE k = 1""")
def reference_timeline(spark, d):
    """Events as streams of one interval each; clicks are the wanted language."""
    ev = events(spark, d).where("text IN ('view', 'click', 'error')")
    named = F.when(F.col("text") == "click", "chi").otherwise(F.col("text"))
    streams = ev.select(
        F.col("ep").alias("path"), F.col("i").alias("index"), F.lit("subtitle").alias("codec_type"), named.alias("language")
    )
    out = catalog.reference_timeline(streams, ev.select(F.col("ep").alias("path"), F.col("i").alias("index"), "s", "e"))
    return out.withColumn("language", F.when(F.col("language") == "chi", "click").otherwise(F.col("language")))


# ---------------------------------------------------------------- grouped dynamic programs, streaming forms


def _timed(spark, d):
    """Words of an episode as a segment each hour; clicks are stretches of speech."""
    ev = events(spark, d)
    words = ev.select(
        "ep",
        F.floor(F.col("s") / (24 * HOUR)).alias("seg_i"),
        F.col("i").alias("w_i"),
        "s",
        F.greatest("e", F.col("s") + 50_000).alias("e"),
        "text",
    )
    ranges = words.groupBy("ep", "seg_i").agg(F.min("s").alias("s"), F.max("e").alias("e")).withColumnRenamed("seg_i", "i")
    ranges = segment.segment_ranges(ranges, of_type(ev, "click", HOUR), of_type(ev, "error", HOUR // 6, ("j", "pa", "pb")), HOUR)
    return words, ranges, of_type(ev, "click", HOUR)


@register()
def retime(spark, d):
    return segment.retime(*_timed(spark, d))


@register()
def line_break_dp(spark, d):
    """Cut costs from the silence before a word; a line is at most 20 characters wide."""
    w = segment.retime(*_timed(spark, d))
    cost = F.when(F.col("gap") >= 300_000, -1.5).when(F.col("gap") >= 150_000, -1.0).otherwise(1.0)
    x = w.withColumn("width", tx.text_em(F.col("text"))).withColumn(
        "cut_cost", F.when(F.col("n") == 0, 0.0).otherwise(cost)
    ).withColumn("starter", F.col("text") == "signup")
    return segment.segment_lines(x, 10.0)


@register()
def transcript_lines(spark, d):
    """Words put on the time of the speech, then broken into lines by grammar: the whole path of a transcript."""
    return segment.transcript_lines(*_timed(spark, d), grammar.Rules(event_tokens), width=900)


@register()
def transcript_ass(spark, d):
    """The lines of a transcript with readings over their words, as subtitle files."""
    cues = transcript_lines(spark, d)
    read_ = {"click": ("クリック", "名詞"), "view": ("ミル", "名詞"), "error": ("*", "")}
    ruby = kana.ruby_column(F.col("text"), {"click": "くりっく", "view": "みる"}, kana.LexiconTokenizer(read_))
    return layout.ass_texts(cues, ruby)


@register()
def grammar_flags(spark, d):
    """Lines of a transcript that begin with a particle or end in a word that only begins sentences."""
    rules = grammar.Rules(event_tokens)
    return catalog.grammar_flags(transcript_lines(spark, d), rules.bad_line_start, rules.ends_with_starter)


@register(f"""WITH {EV}, c AS (SELECT ep, s, i, CASE WHEN s - max(s) OVER (PARTITION BY ep ORDER BY s, i ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING) < 3600000000 THEN 0 ELSE 1 END AS c FROM ev),
r AS (SELECT *, sum(c) OVER (PARTITION BY ep ORDER BY s, i) AS r FROM c)
SELECT ep, min(s) AS s, max(s) + 3600000000 AS e, count(*) AS n FROM r GROUP BY ep, r""")
def session_groups(spark, d):
    ts = read(spark, d, "events").select(F.col("user_id").alias("ep"), "ts")
    us = lambda c: F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01', {c})")
    return live.silence_groups(ts, "1 hour").select("ep", us("start").alias("s"), us("end").alias("e"), "n")
