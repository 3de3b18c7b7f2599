"""Connected components of a link table by alternating star contraction.

Every round is a few equi-joins and partial aggregates, so a hub with a third of all links is pre-aggregated
before it is shuffled and its join can be split. No node, link or component list reaches the driver: two rounds return
one row with a count and a checksum. A forest of at most ``ONE_TASK`` distinct links (16 MB) is settled by one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.store import drop, table

ONE_TASK = 1 << 20


def unite(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins u[i] with v[i]; label always holds each node's smallest member."""
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _settled(t: pa.Table) -> pa.Table:
    nodes, ends = np.unique(np.concatenate([t["u"].to_numpy(), t["v"].to_numpy()]), return_inverse=True)
    label = np.arange(len(nodes))
    unite(label, ends[: t.num_rows], ends[t.num_rows :])
    return pa.table({"node": nodes, "root": nodes[label]})


def _round(stars: DataFrame) -> DataFrame:
    """Large star, then small star: every node's links go to its smallest neighbour."""
    both = stars.select("u", "v").union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    down = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(down, "u").select(F.explode(F.array("u", "v")).alias("u"), "m").where("u <> m")
    return small.select("u", F.col("m").alias("v")).distinct()


def components(spark: SparkSession, links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links(u bigint, v bigint)`` -> ``(node, root)`` for every linked node; root is the smallest node reachable.

    Null ends and loops are ignored; repeated links do no harm; no links give no rows.
    """
    stars = table(
        spark,
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
    )
    state = None
    for _ in range(0, max_rounds, 2):
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if 0 < now[0] <= ONE_TASK:
            out = table(spark, stars.groupBy(F.lit(0).alias("all")).applyInArrow(_settled, "node long, root long"))
            drop(spark, stars)
            return out
        if now[0] == 0 or now == state:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state = now
        nxt = table(spark, _round(_round(stars)))
        drop(spark, stars)
        stars = nxt
    raise RuntimeError(f"components: not settled after {max_rounds} rounds")
