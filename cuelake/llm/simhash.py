"""SimHash near-dedup by a self-join of the binary trie of all fingerprints.

Fingerprints are made where the texts lie, in one scan; exact copies then fall together in a partial aggregate, so a
third of all documents with one text is one trie leaf. The upper ``depth`` bits name subtrees; a pair of subtrees whose
names differ in at most ``max_bits`` bits is one task's work, and there both subtrees are walked together: a pair of
nodes carries the bits spent so far and ends when it has spent too many. Sorted arrays stand for the subtrees; a
frontier of node pairs goes down one bit at a time as arrays. A task returns a spanning forest of the links it found,
never the pairs of a group; components are then joined over all tasks.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.bytesvec import U64, pieces, ragged, raw, trimmed, words
from cuelake.llm.components import components, unite
from cuelake.llm.store import table, text_hashes

SEED = 42
#: A small trie is cut into 16 subtrees too, which make 96 pairs: work for as many tasks.
LEAST_DEPTH = 4


def fingerprints(text, shingle: int = 3) -> np.ndarray:
    """SimHash of each text over its word shingles, A-Z lower-cased; fewer words: one shingle; none: zero."""
    data, off = raw(text)
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + np.uint8(32), data)
    starts, ends, first = words(data, off)
    size = ends - starts + 1
    joined = np.append(data, np.uint8(32))[ragged(starts, size)]
    stop = np.cumsum(size)
    joined[stop - 1] = 32
    begin = stop - size
    n_words = np.diff(first)
    n = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    at = ragged(first[:-1], n)
    last = np.minimum(at + shingle, np.repeat(first[1:], n)) - 1
    body, digest = joined.tobytes(), xxhash.xxh64_intdigest
    h = np.array([digest(body[a:b], SEED) for a, b in zip(begin[at].tolist(), (stop[last] - 1).tolist())], U64)
    out = np.zeros(len(n), U64)
    full = np.flatnonzero(n)
    if len(full):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count = np.add.reduceat(bits, (np.cumsum(n) - n)[full], axis=0, dtype=np.int32)
        out[full] = np.packbits(count * 2 > n[full, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def trie_links(a: np.ndarray, b: np.ndarray | None, max_bits: int, leaf: int = 12, width: int = 1 << 19):
    """Index pairs (into a, into b) of sorted distinct fingerprints that differ in at most ``max_bits`` bits, in parts.

    b None: a with itself, each pair once.
    """
    own = b is None
    b = a if own else b
    if not len(a) or not len(b):
        return
    stack = [(63, *(np.array([x], np.int64) for x in (0, len(a), 0, len(b), 0)))]
    while stack:
        bit, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > width:
            half = len(alo) // 2
            stack += [(bit, *(x[s] for x in (alo, ahi, blo, bhi, err))) for s in (slice(half), slice(half, None))]
            continue
        small = (ahi - alo) * (bhi - blo) <= leaf if bit >= 0 else np.ones(len(alo), bool)
        if small.any():
            la, lb = (ahi - alo)[small], (bhi - blo)[small]
            i = ragged(np.zeros(int(small.sum()), np.int64), la * lb)
            lb_each = np.repeat(lb, la * lb)
            x = np.repeat(alo[small], la * lb) + i // lb_each
            y = np.repeat(blo[small], la * lb) + i % lb_each
            near = np.bitwise_count(a[x] ^ b[y]) <= max_bits
            if own:
                near &= x < y
            if near.any():
                yield x[near], y[near]
        alo, ahi, blo, bhi, err = (x[~small] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        one, shift = U64(1), U64(bit)
        amid = np.searchsorted(a, ((a[alo] >> shift) | one) << shift)
        bmid = np.searchsorted(b, ((b[blo] >> shift) | one) << shift)
        amid, bmid = np.clip(amid, alo, ahi), np.clip(bmid, blo, bhi)
        twin = (alo == blo) if own else np.zeros(len(alo), bool)
        parts = [
            (alo, amid, blo, bmid, err, np.ones(len(alo), bool)),
            (amid, ahi, bmid, bhi, err, np.ones(len(alo), bool)),
            (alo, amid, bmid, bhi, err + 1, np.ones(len(alo), bool)),
            (amid, ahi, blo, bmid, err + 1, ~twin),
        ]
        joined = [np.concatenate(x) for x in zip(*parts)]
        keep = joined[5] & (joined[1] > joined[0]) & (joined[3] > joined[2]) & (joined[4] <= max_bits)
        stack.append((bit - 1, *(x[keep] for x in joined[:5])))


def _walk(max_bits: int):
    @trimmed
    def run(t: pa.Table) -> pa.Table:
        fp = t["fp"].to_numpy().view(U64)
        right = t["other"].to_numpy(zero_copy_only=False)
        a = np.sort(fp[~right])
        b = np.sort(fp[right]) if t["low"][0] != t["high"][0] else None
        nodes = a if b is None else np.concatenate([a, b])
        label = np.arange(len(nodes))
        for x, y in trie_links(a, b, max_bits):
            unite(label, x, y if b is None else y + len(a))
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.table({"u": pa.array(nodes[moved].view(np.int64)), "v": pa.array(nodes[label[moved]].view(np.int64))})

    return run


def near_links(fps: DataFrame, count: int, max_bits: int = 2, subtree: int = 1 << 18) -> DataFrame:
    """Distinct ``fp bigint`` -> a forest ``u, v`` that connects what links within ``max_bits`` bits connect.

    ``count`` sets the depth of the subtrees, so that one has about ``subtree`` leaves. A fingerprint goes to the
    subtree pairs whose names are near its own: C(depth, 0) + .. + C(depth, max_bits) of them.
    """
    depth = max(LEAST_DEPTH, min(24, (-(-count // subtree)).bit_length()))
    masks = [sum(1 << i for i in c) for k in range(max_bits + 1) for c in combinations(range(depth), k)]
    name = F.shiftrightunsigned("fp", 64 - depth)
    other = F.explode(F.array(*[F.lit(m).cast("bigint") for m in masks]))
    pairs = (
        fps.select("fp", name.alias("name"), other.alias("mask"))
        .select("fp", "name", F.col("name").bitwiseXOR(F.col("mask")).alias("to"))
        .select(
            "fp", F.least("name", "to").alias("low"), F.greatest("name", "to").alias("high"), (F.col("name") > F.col("to")).alias("other")
        )
    )
    return pairs.groupBy("low", "high").applyInArrow(_walk(max_bits), "u long, v long")


def simhash(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, hashed: bool = False) -> DataFrame:
    """``key, fp bigint`` for each row, made in the scan; hashed: and ``text_hash, text_hash2``."""
    more = ["text_hash", "text_hash2"] if hashed else []

    def run(batches):
        for b in pieces(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(fingerprints(b.column(1), shingle).view(np.int64)), *b.columns[2:]], names=["id", "fp", *more]
            )

    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"), *text_hashes(text)[: len(more)])
    return source.mapInArrow(run, ", ".join([f"id {kind}, fp long", *[f"{c} long" for c in more]]))


def simhash_dedup(
    spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2
) -> DataFrame:
    """``key, fingerprint, component_id``: documents linked at ``max_bits`` or fewer differing bits, over any number of steps.

    ``component_id`` is the smallest key of the component, itself included. Null, empty and blank texts have the
    fingerprint zero and are linked with whatever else is near zero; repeated rows are copies of each other; null keys
    are carried and never are a component's smallest key unless it has no other (then null). No rows give no rows;
    other columns of the input play no part.
    """
    prints = table(spark, simhash(docs, key, text, shingle))
    named = table(spark, _placed(spark, prints, max_bits).drop("root"))
    return prints.join(named, prints.fp == named.of).select(
        F.col("id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _placed(spark: SparkSession, prints: DataFrame, max_bits: int) -> DataFrame:
    """``id, fp`` -> ``of, root, component_id`` for each fingerprint: its component's sign and smallest key."""
    fps = table(spark, prints.groupBy("fp").agg(F.min("id").alias("least")))
    count = fps.count()
    roots = components(spark, near_links(fps.select("fp"), count, max_bits))
    placed = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    whole = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(whole, "root").select(F.col("fp").alias("of"), "root", "component_id")


def simhash_firsts(
    spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2
) -> DataFrame:
    """``id, text_hash, text_hash2, n``: for each component of ``simhash_dedup`` one pair of key and text, and its rows.

    It is the pair with the smallest key (nulls last), then the smallest hashes. Whatever rows share, null keys and
    repeated keys among it, only rows of one component compete.
    """
    prints = table(spark, simhash(docs, key, text, shingle, hashed=True))
    named = table(spark, _placed(spark, prints, max_bits).select("of", "root"))
    pairs = prints.groupBy("id", "text_hash", "text_hash2", "fp").agg(F.count("*").alias("n"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash", "text_hash2", "n")
    each = pairs.groupBy("fp").agg(F.min(order).alias("first"))
    firsts = each.join(named, each.fp == named.of).groupBy("root").agg(F.min("first").alias("first"))
    return firsts.select("first.id", "first.text_hash", "first.text_hash2", "first.n")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
