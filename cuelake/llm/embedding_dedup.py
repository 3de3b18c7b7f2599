"""Embedding near-dedup by dual traversal of cover trees.

Vectors with equal components fall together first, so copies are one point with a weight. The upper levels of the tree
are made over all tasks: a cell with too many points (at first a label's) gets pivots far apart, its points go to their
nearest one, and so on down, every cell by itself and in chunks of bounded size. A point visits another cell only where
its distance to the cell's pivot allows a link with a member; if it must link with all of them, the cell is told its
weight and no visit is made; a cell whose members all must link is counted by its weight. So a vector is copied where it
may link, not to all blocks of its label. In a task, the members of a cell and what meets them become cover trees: nested
levels of nodes, every level's radius half of the one above. Pairs of nodes are walked together: a pair goes when its
centres are further apart than both radii and the threshold, is taken whole when everything in it must link (counted by
weights, never listed), and is opened otherwise. What reaches single points is decided by the cosine itself, in double
precision. A task counts the links of the members of its cell only, so each link is counted once from each end.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.bytesvec import trimmed
from cuelake.llm.components import components, unite
from cuelake.llm.store import drop, table

_SLACK = 1e-7  # of a distance, for rounding: a pair within it is opened, not judged by bounds
_CLOSE = 1e-11  # of a cosine, for rounding: a pair within it is decided by the formula itself


class CoverTree:
    """Nodes as arrays: centre, covering radius, children (a run of nodes) and members (a run of ``order``)."""

    def __init__(self, unit: np.ndarray, leaf: int = 8):
        n = len(unit)
        self.unit, self.order = unit, np.arange(n)
        centre, radius, kids, span = [], [], [], []

        def node(lo: int, hi: int) -> int:
            own = self.order[lo:hi]
            far = float(_chord(unit[own] @ unit[own[0]]).max()) if hi - lo > 1 else 0.0
            centre.append(own[0])
            radius.append(far)
            kids.append((0, 0))
            span.append((lo, hi))
            return len(centre) - 1

        if n:
            node(0, n)
        at = 0
        while at < len(centre):  # breadth first: the children of a node are neighbours
            lo, hi = span[at]
            if hi - lo > leaf and radius[at] > 1e-9:
                cuts = self._net(lo, hi, radius[at] / 2)
                first = len(centre)
                for a, b in zip(cuts, cuts[1:]):
                    node(a, b)
                kids[at] = (first, len(centre))
            elif hi - lo > 1:
                first = len(centre)
                for a in range(lo, hi):
                    node(a, a + 1)
                kids[at] = (first, len(centre))
            at += 1
        self.centre, self.radius = np.array(centre, np.int64), np.array(radius)
        self.kids, self.span = np.array(kids, np.int64).reshape(-1, 2), np.array(span, np.int64).reshape(-1, 2)

    def _net(self, lo: int, hi: int, radius: float) -> list[int]:
        """Deals a node's members to centres ``radius`` apart at least, each member to the first that covers it."""
        rest, cuts, at = self.order[lo:hi].copy(), [lo], lo
        near = 1 - radius * radius / 2
        while len(rest):
            block = rest[:32]  # the next centres are among these; one product serves all of them
            cos = self.unit[block] @ self.unit[rest].T
            free = np.ones(len(rest), bool)
            for k in range(len(block)):
                if not free[k]:
                    continue
                mine = free & (cos[k] >= near)
                mine[k] = True
                free &= ~mine
                mine[k] = False
                own = np.append(block[k], rest[mine])
                self.order[at : at + len(own)] = own
                at += len(own)
                cuts.append(at)
            rest = rest[free]
        return cuts


def _chord(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos))


def dual_links(a: CoverTree, b: CoverTree, vec_a, vec_b, weight_a, weight_b, least: float):
    """Number of weighted links of each point of a and of b, and a label of each point (b's after a's) that links join.

    a is b: each point's links to the others.
    """
    own = a is b
    na = len(a.unit)
    total_a = np.zeros(na, np.int64)
    total_b = total_a if own else np.zeros(len(b.unit), np.int64)
    label = np.arange(na if own else na + len(b.unit))
    if not na or not len(b.unit):
        return total_a, total_b, label
    reach = math.sqrt(2 - 2 * least)
    shift = 0 if own else na

    def whole(i: int, j: int) -> None:
        x, y = a.order[slice(*a.span[i])], b.order[slice(*b.span[j])]
        if own and i == j:
            total_a[x] += weight_a[x].sum() - weight_a[x]
        else:
            total_a[x] += weight_b[y].sum()
            total_b[y] += weight_a[x].sum()
        unite(label, np.append(x, y + shift), np.full(len(x) + len(y), x[0]))

    single_a, single_b = a.span[:, 1] - a.span[:, 0] == 1, b.span[:, 1] - b.span[:, 0] == 1
    if own and 2 * a.radius[0] <= reach - _SLACK:
        whole(0, 0)
        return total_a, total_b, label
    stack = [(0, 0)]
    while stack:
        i, j = stack.pop()
        left = np.arange(*a.kids[i]) if a.kids[i][1] else np.array([i])
        right = np.arange(*b.kids[j]) if b.kids[j][1] else np.array([j])
        for at in range(0, len(left), 512):
            some = left[at : at + 512]
            cos = a.unit[a.centre[some]] @ b.unit[b.centre[right]].T
            open_up = cos >= 1 - (reach + _SLACK + a.radius[some][:, None] + b.radius[right][None, :]).clip(0, 2) ** 2 / 2
            p, q = np.nonzero(open_up)
            cos, p, q = cos[p, q], some[p], right[q]
            if own and i == j:
                up = p <= q
                cos, p, q = cos[up], p[up], q[up]
            both = single_a[p] & single_b[q]
            if own:
                both_self = both & (p == q)
                cos, p, q, both = cos[~both_self], p[~both_self], q[~both_self], both[~both_self]
            if both.any():
                x, y, c = a.centre[p[both]], b.centre[q[both]], cos[both]
                ok = c >= least
                for k in np.flatnonzero(np.abs(c - least) < _CLOSE):
                    u, v = vec_a[x[k]], vec_b[y[k]]
                    ok[k] = float(u @ v) / (math.sqrt(float(u @ u)) * math.sqrt(float(v @ v))) >= least
                x, y = x[ok], y[ok]
                np.add.at(total_a, x, weight_b[y])
                np.add.at(total_b, y, weight_a[x])
                unite(label, x, y + shift)
            p, q, far = p[~both], q[~both], _chord(cos[~both])
            spread = a.radius[p] + b.radius[q]
            take = far + np.where(own & (p == q), 2 * a.radius[p], spread) <= reach - _SLACK
            for k in np.flatnonzero(take):
                whole(int(p[k]), int(q[k]))
            stack += [(int(s), int(t)) for s, t in zip(p[~take], q[~take])]
    return total_a, total_b, label


def _vectors(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).astype(np.float64).reshape(len(flat), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _meet(least: float):
    """Links of the members of one cell (or a block of them) with what meets them there.

    role 0: a member, 1: what it is compared with, 2: both.
    """

    @trimmed
    def run(t: pa.Table) -> pa.Table:
        role = t["role"].to_numpy()
        rep, weight, vec = t["rep"].to_numpy(), t["weight"].to_numpy(), _vectors(t["vec"])
        order = np.lexsort((rep, role))
        rep, weight, vec, role = rep[order], weight[order], vec[order], role[order]
        unit = _unit(vec)
        member, other = np.flatnonzero(role != 1), np.flatnonzero(role == 1)
        links, label = np.zeros(len(rep), np.int64), np.arange(len(rep))
        tree = CoverTree(unit[member])
        pairs = [(other, None)]
        if len(member) and role[member[0]] == 2:
            pairs.append((member, tree))
        for against, own in pairs:
            if not len(member) or not len(against):
                continue
            b = CoverTree(unit[against]) if own is None else tree
            some, _, joined = dual_links(tree, b, vec[member], vec[against], weight[member], weight[against], least)
            links[member] += some
            both = member if own is not None else np.append(member, against)
            unite(label, both, both[joined])
        # a member that meets itself as a role 1 has counted its own weight
        self_at = np.searchsorted(rep[other], rep[member]) if len(other) else np.zeros(0, np.int64)
        if len(other):
            twin = rep[other][np.minimum(self_at, len(other) - 1)] == rep[member]
            links[member] -= np.where(twin, weight[member], 0)
        some = (links > 0) | (label != np.arange(len(rep)))
        return pa.table({"rep": rep[some], "links": links[some], "root": rep[label][some]})

    return run


_CELL = ["label", "dim", "cell"]


@trimmed
def _pivots(t: pa.Table) -> pa.Table:
    """Up to ``want`` points of a sample of a cell, each as far from those before it as can be."""
    rep, vec = t["rep"].to_numpy(), _vectors(t["vec"])
    order = np.argsort(rep)
    unit = _unit(vec[order])
    far, chosen = _chord(unit @ unit[0]), [0]
    while len(chosen) < min(t["want"][0].as_py(), len(unit)) and far.max() > 1e-7:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _chord(unit @ unit[chosen[-1]]))
    k = len(chosen)
    keys = [t[c].slice(0, 1).combine_chunks().take(pa.array([0] * k)) for c in _CELL]
    flat = pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * unit.shape[1], pa.int32()), pa.array(unit[chosen].ravel()))
    return pa.table([*keys, pa.array(np.arange(k), pa.int32()), pa.array(rep[order][chosen]), flat], names=[*_CELL, "no", "p_rep", "p_vec"])


@trimmed
def _home(left: pa.Table, right: pa.Table) -> pa.Table:
    """Points of a chunk of a cell and the pivot each member is nearest to; visitors have none."""
    place, far = np.full(left.num_rows, -1, np.int32), np.zeros(left.num_rows)
    home = left["home"].to_numpy(zero_copy_only=False)
    if home.any():
        p = _vectors(right["p_vec"])[np.argsort(right["no"].to_numpy())]
        cos = _unit(_vectors(left["vec"].filter(left["home"]))) @ p.T
        place[home] = cos.argmax(axis=1)
        far[home] = _chord(cos.max(axis=1))
    return left.append_column("no", pa.array(place)).append_column("far", pa.array(far))


def _visits(reach: float):
    """What a chunk of a cell sends to other children of it: visitors (kind 0), and weights that link with all (kind 1).

    A point visits a child that it is within reach of by the child's radius, and by each plane half way between the
    child's pivot and another one: the child's members lie on its side of the plane, so the point is within reach of it.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at = np.argsort(right["no"].to_numpy())
        p, radius, child_rep = _vectors(right["p_vec"])[at], right["r"].to_numpy()[at], right["p_rep"].to_numpy()[at]
        name = right["child"].combine_chunks().take(pa.array(at))
        cos = _unit(_vectors(left["vec"])) @ p.T if left.num_rows else np.zeros((0, len(p)))
        far = _chord(cos)
        near = far <= radius[None, :] + reach + _SLACK
        for k, apart in enumerate(_chord(p @ p.T)):
            near &= cos[:, k : k + 1] - cos <= reach * apart + _SLACK
        own = left["no"].to_numpy()
        some = np.flatnonzero(own >= 0)
        near[some, np.searchsorted(np.sort(right["no"].to_numpy()), own[some])] = False
        x, j = np.nonzero(near)
        whole = (far[x, j] + radius[j] <= reach - _SLACK).astype(np.int32)
        order = np.argsort(whole, kind="stable")
        x, j, whole = x[order], j[order], whole[order]
        sent = int((whole == 0).sum())
        take = pa.array(x)
        vec = left["vec"].combine_chunks()
        vec = pa.concat_arrays([vec.take(pa.array(x[:sent])), pa.nulls(len(x) - sent, vec.type)])
        return pa.table(
            [
                left["label"].take(take),
                left["dim"].take(take),
                name.take(pa.array(j)),
                pa.array(whole),
                left["rep"].take(take),
                left["weight"].take(take),
                vec,
                pa.array(child_rep[j]),
            ],
            names=[*_CELL, "kind", "rep", "weight", "vec", "p_rep"],
        )

    return trimmed(run)


def embedding_dedup(
    spark: SparkSession,
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    least: float = 0.98,
    block_bytes: int = 4 << 20,
    fan: int = 64,
    most_levels: int = 40,
) -> DataFrame:
    """``key, n_links, component_id, kept``: links are pairs of one label with a cosine of ``least`` or more.

    ``n_links`` counts the other rows linked directly, copies included; ``component_id`` is the smallest key reachable;
    ``kept`` is true for that one. Rows with a null key or label, a null, empty or zero vector, or one with null or
    non-finite components link with nothing and are kept; vectors of different lengths don't link; repeated rows are
    copies of each other; no rows give no rows; other columns of the input play no part. Labels are integers.

    No task holds more than about ``block_bytes`` of members of a cell (8,192 vectors of 64 numbers) and twice as much of
    what meets them. Equal vectors are told by two hashes.
    """
    v = F.col("vec")
    rows = vectors.select(
        F.col(f"`{key}`").alias("id"),
        F.col(f"`{label}`").alias("label"),
        F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double") + F.lit(0.0)).alias("vec"),
    ).withColumn(
        "sound",
        F.coalesce(
            F.col("id").isNotNull()
            & F.col("label").isNotNull()
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
            & F.exists(v, lambda x: x != 0),
            F.lit(False),
        ),
    )
    named = ["label", "dim", "h1", "h2"]
    hashed = rows.where("sound").select(
        "id", "label", F.size("vec").alias("dim"), F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(9), "vec").alias("h2"), "vec"
    )
    copies = hashed.groupBy(*named).agg(F.min("id").cast("long").alias("rep"), F.count("*").alias("weight"), F.first("vec").alias("vec"))
    reps = table(spark, copies)
    found = _links(spark, reps.select("label", "dim", "rep", "weight", "vec"), least, block_bytes, fan, most_levels)
    roots = components(spark, found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links")).withColumnRenamed("rep", "l_rep")
    groups = table(
        spark,
        reps.select(*[F.col(c).alias(f"g_{c}") for c in named], "rep", "weight")
        .join(links, F.col("rep") == F.col("l_rep"), "left")
        .join(roots, F.col("rep") == F.col("node"), "left")
        .select(
            *[f"g_{c}" for c in named],
            (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("root", "rep").alias("component_id"),
        ),
    )
    drop(spark, found)
    drop(spark, reps)
    same = reduce(and_, [F.col(c) == F.col(f"g_{c}") for c in named])
    joined = hashed.drop("vec").join(groups, same).select("id", "n_links", "component_id")
    alone = rows.where("NOT sound").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return joined.union(alone).select(
        F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def _links(spark: SparkSession, points: DataFrame, least: float, block_bytes: int, fan: int, most_levels: int) -> DataFrame:
    """Distinct points ``label, dim, rep, weight, vec`` -> a table ``rep, links, root``: weights linked, and a forest."""
    reach = math.sqrt(2 - 2 * least)
    block = F.greatest(F.lit(1), F.floor(F.lit(block_bytes) / (8 * F.col("dim")))).cast("long")
    kind = points.schema["label"].dataType.simpleString()
    keys, point = f"label {kind}, dim int, cell string", "rep long, weight long, vec array<double>"
    state = points.select("label", "dim", F.lit("").alias("cell"), F.lit(True).alias("home"), "rep", "weight", "vec")
    cells = table(
        spark,
        state.groupBy(*_CELL).agg(
            F.count("*").alias("n"), F.lit(0).cast("long").alias("v"), F.lit(None).cast("long").alias("edge"), F.lit(False).alias("closed")
        ),
    )
    leaves, credits, done = [], [], [cells]
    for level in range(most_levels):
        big = (F.col("n") > block) & ~F.col("closed")
        if cells.where(big).isEmpty():
            break
        placed = state.join(cells, _CELL)
        leaves.append(placed.where(~big))
        full = placed.where(big).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.ceil((F.col("n") + F.col("v")) / block)))
        drawn = F.pmod(F.xxhash64("rep", F.lit(level)), F.col("n")) < 4 * fan  # about so many of a cell, however large
        sample = full.where(F.col("home") & (drawn | (F.col("rep") == F.col("edge"))))
        want = F.least(F.lit(fan), F.greatest(F.lit(2), F.ceil(2 * F.col("n") / block))).cast("int").alias("want")
        sample = sample.select(*_CELL, "rep", "vec", want)
        pivots = table(spark, sample.groupBy(*_CELL).applyInArrow(_pivots, f"{keys}, no int, p_rep long, p_vec array<double>"))
        dealt = cells.where(big).select(
            *_CELL, F.explode(F.sequence(F.lit(0).cast("long"), F.ceil((F.col("n") + F.col("v")) / block) - 1)).alias("chunk")
        ).join(pivots, _CELL)
        by_chunk = [*_CELL, "chunk"]
        homes = table(
            spark,
            full.select(*by_chunk, "home", "rep", "weight", "vec").groupBy(*by_chunk).cogroup(dealt.groupBy(*by_chunk))
            .applyInArrow(_home, f"{keys}, chunk long, home boolean, {point}, no int, far double"),
        )
        stats = homes.where("home").groupBy(*_CELL, "no").agg(
            F.count("*").alias("n"),
            F.sum("weight").alias("total"),
            F.max("far").alias("r"),
            F.max_by("rep", F.struct("far", "rep")).alias("edge"),
        )
        stats = table(spark, stats.withColumn("child", F.concat("cell", F.lit("."), F.col("no").cast("string"))))
        known = dealt.join(stats.select(*_CELL, "no", "r", "child"), [*_CELL, "no"])
        sent = table(
            spark,
            homes.select(*by_chunk, "rep", "weight", "vec", "no").groupBy(*by_chunk).cogroup(known.groupBy(*by_chunk))
            .applyInArrow(_visits(reach), f"{keys}, kind int, {point}, p_rep long"),
        )
        # weights that link with every member of a cell, and cells whose members all link with each other
        told = sent.where("kind = 1")
        bonus = told.groupBy(*_CELL).agg(F.sum("weight").alias("links"), F.min("rep").alias("root"))
        members = homes.where("home").select(
            "label",
            "dim",
            F.concat("cell", F.lit("."), F.col("no").cast("string")).alias("cell"),
            F.lit(True).alias("home"),
            "rep",
            "weight",
            "vec",
        )
        closed = 2 * F.col("r") <= reach - _SLACK
        shut = stats.where(closed & (F.col("n") > 1)).select("label", "dim", F.col("child").alias("cell"), "total").join(
            pivots.select("label", "dim", F.concat("cell", F.lit("."), F.col("no").cast("string")).alias("cell"), "p_rep"), _CELL
        )
        credits += [
            members.drop("vec").join(bonus, _CELL).select("rep", "links", "root"),
            told.select("rep", F.lit(0).cast("long").alias("links"), F.col("p_rep").alias("root")),
            members.drop("vec").join(shut, _CELL).select(
                "rep", (F.col("total") - F.col("weight")).alias("links"), F.col("p_rep").alias("root")
            ),
        ]
        visitors = sent.where("kind = 0").select(*_CELL, F.lit(False).alias("home"), "rep", "weight", "vec")
        state = members.unionByName(visitors)
        visits = visitors.groupBy(*_CELL).agg(F.count("*").alias("v"))
        cells = stats.select("label", "dim", F.col("child").alias("cell"), "n", "edge", closed.alias("closed"))
        cells = table(spark, cells.join(visits, _CELL, "left").select(*_CELL, "n", F.coalesce("v", F.lit(0)).alias("v"), "edge", "closed"))
        done += [pivots, homes, stats, sent, cells]
    leaves.append(state.join(cells, _CELL))
    met = [_leaf(x, least, block) for x in leaves]
    out = table(spark, reduce(DataFrame.unionByName, [*met, *credits]))
    for old in done:
        drop(spark, old)
    return out


def _leaf(rows: DataFrame, least: float, block: Column) -> DataFrame:
    """Members of cells against each other (unless their cell is closed) and against its visitors, in blocks."""
    others = F.when(F.col("closed"), F.col("v")).otherwise(F.col("n") + F.col("v"))
    x = rows.withColumn("_a", F.ceil(F.col("n") / block)).withColumn("_c", F.ceil(others / (2 * block))).where("_c > 0")
    one = (F.col("_a") == 1) & (F.col("_c") == 1)
    spread = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), n)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    task = lambda a, c, role: F.struct(a.cast("long").alias("a"), c.cast("long").alias("c"), F.lit(role).alias("role"))
    as_member = F.transform(upto(F.col("_c")), lambda c: task(spread(F.col("_a"), 1), c, 0))
    as_other = F.transform(upto(F.col("_a")), lambda a: task(a, spread(F.col("_c"), 2), 1))
    zero = F.lit(0)
    tasks = (
        F.when(~F.col("home"), as_other)
        .when(F.col("closed"), as_member)
        .when(one, F.array(task(zero, zero, 2)))
        .otherwise(F.concat(as_member, as_other))
    )
    dealt = x.select(*_CELL, "rep", "weight", "vec", F.explode(tasks).alias("t")).select(*_CELL, "rep", "weight", "vec", "t.*")
    return dealt.groupBy(*_CELL, "a", "c").applyInArrow(_meet(least), "rep long, links long, root long")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
