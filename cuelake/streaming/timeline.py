"""Structured Streaming forms: silence-delimited groups, incremental consumption, add-only upserts, sequential state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def silence_groups(words: DataFrame, gap: str, late: str | None = None, ts: str = "ts", ep: str = "ep") -> DataFrame:
    """Groups that a silence of ``gap`` ends: ``ep, start, end, n``. Batch or stream; a stream needs ``late``."""
    x = words.withWatermark(ts, late) if late else words
    g = x.groupBy(ep, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select(ep, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def segment_stream(spark, path: str, schema, files_a_trigger: int = 16) -> DataFrame:
    """Segments as files arrive; progress is in the query's progress reports, restarts go by the checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def add_only(stream: DataFrame, target: str, keys: list[str], checkpoint: str, slices: int = 64) -> StreamingQuery:
    """Appends rows whose keys the target does not have yet; running a batch again adds nothing.

    The target is laid out by ``_slice``, a hash of the keys: a batch reads the keys of the slices it touches only.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(slices)).cast("int")

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys).withColumn("_slice", place)
        if _exists(spark, target):
            touched = [r["_slice"] for r in fresh.select("_slice").distinct().collect()]  # at most `slices`
            there = spark.read.parquet(target).where(F.col("_slice").isin(touched)).select(*keys, "_slice")
            fresh = fresh.join(there, [*keys, "_slice"], "left_anti")
        fresh.write.mode("append").partitionBy("_slice").parquet(target)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def forward_only(words: DataFrame, ep: str = "ep") -> DataFrame:
    """Words ``ep, s, e`` as they come, starts never before the end of what came before: ``ep, s, e``."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else (0,)
        for p in parts:
            p = p.sort_values(["s", "e"])
            end = np.maximum.accumulate(np.maximum(np.maximum(p["s"].to_numpy(), p["e"].to_numpy()), last))
            start = np.maximum(p["s"].to_numpy(), np.append(last, end[:-1]))
            last = int(end[-1]) if len(end) else last
            state.update((last,))
            yield pd.DataFrame({"ep": key[0], "s": start, "e": end})

    return words.groupBy(ep).applyInPandasWithState(run, "ep long, s long, e long", "last long", "append", "NoTimeout")


