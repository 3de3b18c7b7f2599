"""URL filters: a blocked Bloom filter in front of an exact hash join. DataFrame functions only.

A listed entry is a canonical ``host/path`` prefix: it stands for its host, all subdomains, and every path that begins
with its own. An URL is probed at each *shape* an entry can have (so many host labels, so many path characters); the
filter has one 64-bit block a probe, so a probe is one array element and a mask. What passes is looked up in the list by
one hash join, which removes what the filter passed by mistake, and each URL takes its longest entry. The plan has the
same number of joins whatever the list holds; a list too long to be sent to every executor has its filter dealt to
ranges of blocks, and both the filter and the list meet the probes in shuffled joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules of the registered query: allowed or blocked, host, path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: A list of up to so many entries is sent to every executor (a filter of 4 MB at most), and so is the list itself if its
#: texts come to ``MOST_BYTES`` at most; beyond, both are dealt out.
MOST_LISTED, MOST_BYTES = 1 << 20, 64 << 20
#: Blocks in one row of a filter that is dealt out (256 KB).
_RANGE = 1 << 15


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _hash(key: Column) -> Column:
    return F.xxhash64(key)


def _mask(h: Column) -> Column:
    """Four bits of a block."""
    out = None
    for at in (6, 12, 18, 24):
        place = F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place)
        out = bit if out is None else out.bitwiseOR(bit)
    return out


def _blocks(count: int) -> int:
    """Blocks of a filter with 16 bits an entry or more."""
    return max(64, 1 << max(0, (count // 4)).bit_length())


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftright(h, 32), F.lit(blocks).cast("bigint"))


def bloom(listed: DataFrame, blocks: int, width: int) -> DataFrame:
    """The filter of ``listed.entry``: ``part, filter`` with ``width`` blocks a row."""
    h = _hash(F.col("entry"))
    set_bits = (
        listed.select(_block(h, blocks).alias("block"), _mask(h).alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("mask"))
    )
    every = listed.sparkSession.range(blocks).withColumnRenamed("id", "place").join(set_bits, F.col("place") == F.col("block"), "left")
    at = F.struct((F.col("place") % width).alias("place"), F.coalesce("mask", F.lit(0).cast("bigint")).alias("mask"))
    packed = every.groupBy(F.floor(F.col("place") / width).cast("long").alias("part")).agg(F.array_sort(F.collect_list(at)).alias("m"))
    return packed.select("part", F.transform("m", lambda x: x["mask"]).alias("filter"))


def _passes(filter_: Column, h: Column, blocks: int, width: int) -> Column:
    block = F.element_at(filter_, (_block(h, blocks) % width + 1).cast("int"))
    return block.bitwiseAND(_mask(h)) == _mask(h)


def url_filter(
    spark: SparkSession,
    pages: DataFrame,
    rules: DataFrame,
    key: str = "page_id",
    url: str = "url",
    otherwise: str = "allow",
) -> DataFrame:
    """``key, host, path, rule, verdict`` for every row. ``rules``: ``verdict, host, path``, one row an entry.

    The longest entry that fits wins (of equal length the last by name); none: rule null and the verdict ``otherwise``,
    as what is not listed passes. An entry listed with several verdicts has the last of them by name (``block`` rather
    than ``allow``). Null urls and those without ``://`` have an empty host and path and fit nothing; repeated rows and
    null keys are carried; no rows give no rows; rules with a null part are none; other columns of the input, whatever
    their names, play no part. Urls of which no probe passes the filter stay where they are while the filter can be sent
    to every executor, which is checked; the shapes are at most the host labels times the path lengths of the list.
    """
    entries = (
        rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .groupBy(F.concat("host", "path").alias("entry"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars"))
        .agg(F.max("verdict").alias("listed"))
    )
    count, size = entries.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("entry")), F.lit(0))).first()
    rows = pages.select(F.col(f"`{key}`").alias("key"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    if not count:
        return rows.select(
            F.col("key").alias(key), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict")
        )
    blocks = _blocks(count)
    shapes = entries.agg(F.array_sort(F.collect_set(F.struct("labels", "chars")))).scalar()
    # rows are told apart by their values and the task that read them, so equal ones are spread like the input
    rows = rows.withColumns({"from": F.spark_partition_id(), "_shapes": shapes, "_parts": F.split("host", r"\.")})
    own = ["key", "host", "path", "from"]
    fits = lambda s: (F.length("host") > 0) & (F.size("_parts") >= s["labels"]) & (F.length("path") >= s["chars"])
    entry = lambda s: F.concat(
        F.array_join(F.slice("_parts", -s["labels"], s["labels"]), "."), F.col("path").substr(F.lit(1), s["chars"])
    )
    probes = F.transform(F.filter("_shapes", fits), entry)
    if count <= MOST_LISTED and size <= MOST_BYTES:
        rows = rows.withColumn("_filter", bloom(entries, blocks, blocks).select("filter").scalar())
        passed = F.filter(probes, lambda p: _passes(F.col("_filter"), _hash(p), blocks, blocks))
        rows = rows.select(*own, passed.alias("passed"))
        rest = rows.where(F.size("passed") == 0).select(
            *own[:3], F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict")
        )
        tried = rows.where(F.size("passed") > 0).select(*own, F.size("passed").alias("n"), F.explode("passed").alias("probe"))
        entries = F.broadcast(entries)
    else:
        width = min(_RANGE, blocks)
        spread = F.xxhash64("host", "path", "probe", "from")
        tried = rows.select(*own, F.greatest(F.size(probes), F.lit(1)).alias("n"), F.explode_outer(probes).alias("probe"))
        # what has no probe, and below what the filter stops, gets a key of its own that meets nothing
        part = F.when(
            F.col("probe").isNull(), -1 - F.pmod(spread, F.lit(1 << 20))
        ).otherwise(F.floor(_block(_hash(F.col("probe")), blocks) / width))
        tried = tried.withColumn("part", part.cast("long"))
        tried = tried.join(bloom(entries, blocks, width).hint("shuffle_hash"), "part", "left")  # a row a range: small beside the probes
        ok = F.coalesce(_passes(F.col("filter"), _hash(F.col("probe")), blocks, width), F.lit(False))
        tried = tried.select(*own, "n", F.when(ok, F.col("probe")).otherwise(F.concat(F.lit("#"), spread.cast("string"))).alias("probe"))
        rest = None
    found = tried.join(entries.select(F.col("entry").alias("rule"), "listed"), F.col("probe") == F.col("rule"), "left")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "rule", "listed"))).alias("best")
    judged = (
        found.groupBy(*own, "n")
        .agg(best, F.count("*").alias("probed"))
        .select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.floor(F.col("probed") / F.col("n")))))
        .select("key", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.listed", F.lit(otherwise)).alias("verdict"))
    )
    return (judged if rest is None else rest.union(judged)).withColumnRenamed("key", key)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(repr, RULES))} AS r(verdict, host, path)")
    return url_filter(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


_HOST = """translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""
ORACLE = f"""
WITH rules(verdict, host, path) AS (VALUES {", ".join(repr(r) for r in RULES)}),
p AS (
  SELECT row_number() OVER () AS n, page_id, {_HOST} AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
hit AS (
  SELECT p.n, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.n ORDER BY length(r.host || r.path) DESC) AS k
  FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, hit.rule, coalesce(hit.verdict, 'allow') AS verdict
FROM p LEFT JOIN hit ON hit.n = p.n AND hit.k = 1
"""
