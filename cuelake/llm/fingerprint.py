"""Document fingerprints: digests of improbable features.

Every 64-byte window of a text has an entropy; windows whose entropy is far from that of running text are rare, and
rarity is a window's rank. A window that is the rarest (the leftmost of equals) in many of the 64-window stretches it
lies in is a *feature*; in a text where none is that of so many, those of the most stretches are. Features go, in the order of the text, into a chain of 2,048-bit Bloom filters of at most 160
features each; the likeness of two digests is the overlap of the filters that match best, freed of the overlap that
chance gives and weighted by features. Entropies are counted in integers, rolled along the bytes of many texts at once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.llm.bytesvec import U64, lanes, pieces, ragged, raw, spans_hash
from cuelake.llm.store import text_bytes

WINDOW, STRETCH, LEAST_POPULAR, SHORT = 64, 64, 16, 8
#: Bytes of the shortest text that holds a whole stretch of windows.
FULL = WINDOW + STRETCH - 1
FILTER_BITS, PER_FILTER, BITS_EACH = 2048, 160, 5
#: The usual entropy of a window of text, and the entropy below which a window is a mere repetition, in bits a byte.
USUAL, TRIVIAL = 3.9, 1.0
_SCALE = 1 << 16
_F = np.array([0] + [round(_SCALE * c * np.log2(c)) for c in range(1, WINDOW + 2)], np.int64)
_GAIN = np.append(np.diff(_F), 0)
_BLOCK = 1 << 16


def _neighbours(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each byte occurs among the 63 before it, and among the 63 after it."""
    n = len(x)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for at in range(0, n, _BLOCK):
        lo, hi = max(0, at - WINDOW + 1), min(n, at + _BLOCK)
        part = x[lo:hi]
        b, a = np.zeros(len(part), np.uint8), np.zeros(len(part), np.uint8)
        for d in range(1, min(WINDOW, len(part))):
            same = (part[d:] == part[:-d]).view(np.uint8)
            b[d:] += same
            a[:-d] += same
        before[at:hi] = b[at - lo :]
        done = hi if hi == n else hi - WINDOW + 1
        after[lo:done] = a[: done - lo]
    return before, after


def entropies(x: np.ndarray) -> np.ndarray:
    """64 times the entropy of each 64-byte window, in units of 1 / _SCALE bits."""
    n = len(x) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    before, after = _neighbours(x)
    step = _GAIN[before]
    # the first window is filled byte by byte; then each step first lets the oldest byte go, then takes the next
    filled = np.zeros(len(x), np.int64)
    first = x[:WINDOW]
    counts = np.zeros(256, np.int64)
    for k in range(WINDOW):
        filled[k] = _GAIN[counts[first[k]]]
        counts[first[k]] += 1
    filled[WINDOW:] = step[WINDOW:] - _GAIN[after[: len(x) - WINDOW]]
    return WINDOW * 6 * _SCALE - np.cumsum(filled)[WINDOW - 1 :]


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each feature, in order. An empty text has none, any other at least one; of one without a whole stretch, every ``SHORT`` bytes are one."""
    n_docs, size = len(off) - 1, np.diff(off)
    starts_each = np.where(size >= FULL, size - WINDOW + 1, 0)
    at = ragged(off[:-1], starts_each)
    doc = np.repeat(np.arange(n_docs), starts_each)
    eights = lanes(data)
    if len(at):
        e = entropies(data)[at] / (WINDOW * _SCALE)
        rare = np.minimum(np.abs(e - USUAL) * 256, 510).astype(np.int64)
        rank = np.where(e < TRIVIAL, 511, 510 - rare)
        never = np.int64(1) << 40
        key = np.full(len(data) + STRETCH, never)
        key[at] = (rank << 30) | at
        best, reach = key, 1
        while reach < STRETCH:
            best = np.minimum(best[:-reach], best[reach:])
            reach *= 2
        winner = best[at] & ((1 << 30) - 1)
        popular = np.bincount(winner, minlength=len(data))[at]
        # where no window has enough stretches, the ones with the most
        most = np.zeros(n_docs, np.int64)
        np.maximum.at(most, doc, popular)
        chosen = popular >= np.minimum(LEAST_POPULAR, most)[doc]
        at, doc = at[chosen], doc[chosen]
    short = np.flatnonzero((size > 0) & (size < FULL))
    pieces_each = np.maximum(size[short] - SHORT + 1, 1)
    small = ragged(off[:-1][short], pieces_each)
    doc = np.concatenate([doc, np.repeat(short, pieces_each)])
    begin = np.concatenate([at, small])
    end = np.concatenate([at + WINDOW, np.minimum(small + SHORT, np.repeat(off[1:][short], pieces_each))])
    h = spans_hash(data, begin, end, eights)
    order = np.lexsort((begin, h, doc))
    doc, h, begin = doc[order], h[order], begin[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h, begin = doc[new], h[new], begin[new]
    order = np.lexsort((begin, doc))
    return doc[order], h[order]


def digests(texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its chain of filters (rows of 32 words) and the features in each."""
    data, off = raw(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
    n = len(off) - 1
    doc, h = features(data, off)
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    chain = -(-count // PER_FILTER)
    chain_first = np.cumsum(chain) - chain
    filt = chain_first[doc] + (np.arange(len(doc)) - first[doc]) // PER_FILTER
    bits = np.zeros((int(chain.sum()), FILTER_BITS // 8), np.uint8)
    for k in range(BITS_EACH):
        bit = ((h >> U64(11 * k)) & U64(FILTER_BITS - 1)).astype(np.int64)
        np.bitwise_or.at(bits, (filt, bit >> 3), (1 << (bit & 7)).astype(np.uint8))
    held = np.bincount(filt, minlength=len(bits))
    wide = bits.view(U64)
    return [(wide[a : a + c], held[a : a + c]) for a, c in zip(chain_first.tolist(), chain.tolist())]


def likeness(a: tuple, b: tuple) -> float:
    """0 to 1; two digests without features are alike, one without is unlike any other."""
    if len(a[1]) > len(b[1]) or (len(a[1]) == len(b[1]) and a[1].sum() > b[1].sum()):
        a, b = b, a
    (x, nx), (y, ny) = a, b
    if not len(nx):
        return 1.0 if not len(ny) else 0.0
    in_x, in_y = np.bitwise_count(x).sum(axis=1).astype(float), np.bitwise_count(y).sum(axis=1).astype(float)
    both = np.bitwise_count(x[:, None, :] & y[None, :, :]).sum(axis=2).astype(float)
    chance = in_x[:, None] * in_y[None, :] / FILTER_BITS
    most = np.minimum(in_x[:, None], in_y[None, :])
    share = np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0.0, 1.0).max(axis=1)
    return float((share * nx).sum() / nx.sum())


def spelled(d: tuple) -> str:
    """Features and bits of each filter: ``160:<512 hex digits>``, joined by commas; empty for no features."""
    return ",".join(f"{n}:{x.tobytes().hex()}" for x, n in zip(d[0], d[1].tolist()))


def read_back(text: str) -> tuple:
    """The inverse of ``spelled``."""
    parts = [p.split(":") for p in text.split(",")] if text else []
    body = b"".join(bytes.fromhex(h) for _, h in parts)
    return np.frombuffer(body, U64).reshape(-1, FILTER_BITS // 64), np.array([int(n) for n, _ in parts], np.int64)


def _in_order(docs: DataFrame, key: str, text: str, run_bytes: int) -> DataFrame:
    """Rows dealt to runs of neighbouring keys, in order, each run followed by (copies of) the row after it.

    Runs are cut at 255 quantiles of the key and evenly between them; the row after a run's last is the first of the
    next run that has any, after the last run the first of all. There are at most 2**17 runs, so above 768 GiB of text
    they grow; a task streams its rows in order, so what it holds does not.
    """
    rows = docs.select(
        F.col(f"`{key}`").alias("id"),
        F.col(f"`{text}`").alias("text"),
        F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(1 << 63))).alias("k"),
    )
    total = text_bytes(docs, text)
    runs = max(1, min(1 << 17, -(-total // run_bytes)))
    coarse = min(runs, 256)
    finer = -(-runs // coarse)
    found = rows.agg(
        F.min("k").alias("lo"), F.max("k").alias("hi"), F.percentile_approx(
            "k", [i / coarse for i in range(1, coarse)] or [0.5], 10000
        ).alias("cuts")
    ).first()
    if found["lo"] is None:
        return rows.select("id", "text", F.lit(0).cast("long").alias("run"), F.lit(False).alias("after"))
    cuts = sorted(set(found["cuts"])) if coarse > 1 else []
    bounds = F.array(*[F.lit(x).cast("double") for x in (found["lo"], *cuts, found["hi"])])
    place = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in cuts]).cast("array<bigint>"), lambda c: c < F.col("k")))
    lo, hi = F.element_at(bounds, place + 1), F.element_at(bounds, place + 2)
    inside = F.least(F.lit(finer - 1), F.floor((F.col("k") - lo) / (hi - lo + 1) * finer)).cast("long")
    dealt = rows.withColumn("run", place * F.lit(finer) + F.greatest(inside, F.lit(0)))
    firsts = dealt.groupBy("run").agg(F.min("k").alias("first"))
    order = W.orderBy("run")  # a row a run, at most 2**17
    firsts = firsts.select(
        "first", F.coalesce(
            F.lag("run").over(order), F.max("run").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        ).alias("to")
    )
    out = dealt.join(F.broadcast(firsts), F.col("k") == F.col("first"), "left")
    twice = F.array(F.struct(F.col("run"), F.lit(False).alias("after")), F.struct(F.col("to").alias("run"), F.lit(True).alias("after")))
    once = F.array(F.struct(F.col("run"), F.lit(False).alias("after")))
    return (
        out.select("id", "text", "k", F.explode(F.when(F.col("to").isNotNull(), twice).otherwise(once)).alias("p"))
        .select("id", "text", "k", "p.run", "p.after")
        .repartition("run")
        .sortWithinPartitions("run", "after", "k", F.xxhash64("text"))
        .select("id", "text", "run", "after")
    )


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", run_bytes: int = 6 << 20) -> DataFrame:
    """``key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for each row.

    The edited text has its last quarter replaced by the beginning of the next document by ascending key (after the
    last the first; rows of one key by a hash of the text, so a lone document is its own next). Null texts are empty;
    an empty text has an empty fingerprint, like only to another empty one; null keys come first; repeated rows follow
    each other; no rows give no rows; other columns of the input play no part. Keys are integers.
    """

    def run(batches):
        carried: list = []
        for b in pieces(batches, "text", 1 << 20):
            rows = carried + list(zip(*(c.to_pylist() for c in b.columns)))
            carried = rows[-1:]
            todo = [i for i in range(len(rows) - 1) if not rows[i][3]]
            texts = [r[1] or "" for r in rows]
            edited = [texts[i][: len(texts[i]) - len(texts[i]) // 4] + texts[i + 1][: len(texts[i]) // 4] for i in todo]
            own, changed = digests(texts), digests(edited)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[i][0] for i in todo], b.schema.field(0).type),
                    pa.array([len(texts[i]) for i in todo], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    pa.array([spelled(own[i]) for i in todo], pa.string()),
                    pa.array([spelled(d) for d in changed], pa.string()),
                    pa.array([likeness(own[i], d) for i, d in zip(todo, changed)], pa.float64()),
                    pa.array([likeness(own[i], own[i + 1]) for i in todo], pa.float64()),
                ],
                names=names,
            )

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kind = docs.schema[key].dataType.simpleString()
    schema = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _in_order(docs, key, text, run_bytes).mapInArrow(run, schema).withColumnRenamed("id", key)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
