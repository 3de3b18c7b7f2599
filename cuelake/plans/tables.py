"""How the driver's tables play the relations of a timeline: an episode is a user, a cue or word an event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000_000

#: The same mapping for DuckDB: relation ``ev`` with ep, i, s, e, text, value.
EV = """ev AS (
  SELECT user_id AS ep, event_id AS i, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS s,
         epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') + CAST(trunc(value * 1000000) AS BIGINT) AS e,
         event_type AS text, value FROM events)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ep, i, s, e, text, value`` in microseconds since 2024-01-01."""
    s = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01', ts)")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("ep"), F.col("event_id").alias("i"), s.alias("s"), (
            s + (F.col("value") * 1_000_000).cast("bigint")
        ).alias("e"), F.col("event_type").alias("text"), "value"
    )


def of_type(ev: DataFrame, kind: str, length: int | None = None, names: tuple[str, str, str] = ("j", "a", "b")) -> DataFrame:
    """Events of one type as intervals ``ep, j, a, b``, ``length`` long."""
    e = F.col("s") + length if length is not None else F.col("e")
    return ev.where(F.col("text") == kind).select("ep", F.col("i").alias(names[0]), F.col("s").alias(names[1]), e.alias(names[2]))
