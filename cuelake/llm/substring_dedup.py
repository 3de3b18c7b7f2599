"""Exact substring dedup by fixed-block anchors.

A run of ``window`` words holds a whole block of ``(window + 1) // 2`` words that starts at a multiple of that width
in its own document. So only those non-overlapping *reference blocks* are indexed, and every rolling window of that
width probes the index (each place is a probe, each aligned place an index entry too). A probe that meets a block
elsewhere is an *anchor*; every ``window``-word run round an anchor is then held exactly against the runs round all
other anchors, and runs that match and touch fuse into the maximal repeat, whose words go.

How it is laid out. Documents are dealt to chunks of about ``chunk_bytes``; a chunk sends each bucket the sorted
distinct 32-bit remainders of its probes in that bucket, with a bit for those that are its own index entries, and gets
back one bit each. The bucket number is part of the hash and buckets hold a fixed number of bytes, so the share of false
anchors is the same at every size; they cost a comparison in the second exchange, nothing else. The second exchange is
of the same form with a further 64-bit hash besides the bucket's bits. A window that a third of all documents share is
one entry a chunk: no group of copies, and no pair of them, is ever formed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.bytesvec import U64, ragged, raw, spans_hash, trimmed, windows_hash, words
from cuelake.llm.store import table, text_bytes

_SENT = "chunk long, bucket long, kind int, body binary"
_BACK = "chunk long, bucket long, kind int, body binary"


def _parse(text) -> tuple:
    data, off = raw(text)
    starts, ends, first = words(data, off)
    return data, off, starts, ends, first, spans_hash(data, starts, ends)


def _probes(word_hash, first, block: int, buckets: int):
    """Begin, place in the sorted distinct probes, and aligned or not, of each rolling window; the distinct probes."""
    begin, h = windows_hash(word_hash, first, block)
    doc = np.searchsorted(first, begin, "right") - 1
    aligned = (begin - first[doc]) % block == 0
    bucket = (h >> U64(32)) % U64(buckets)
    key = (bucket << U64(32)) | (h & U64(0xFFFFFFFF))
    keys, inv = np.unique(key, return_inverse=True)
    own = np.bincount(inv[aligned], minlength=len(keys))
    return begin, inv, aligned, keys, own


def _messages(chunk: int, kind: int, bucket: np.ndarray, values: np.ndarray, marks: np.ndarray | None) -> pa.Table:
    """One row for each bucket: the values, then a bit for each."""
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    to = np.r_[cut[1:], len(bucket)] if len(bucket) else cut
    body = [
        values[a:b].tobytes() + (b"" if marks is None else np.packbits(marks[a:b]).tobytes()) for a, b in zip(cut, to)
    ]
    n = len(body)
    return pa.table(
        {
            "chunk": pa.array(np.full(n, chunk, np.int64)),
            "bucket": pa.array(bucket[cut].astype(np.int64)),
            "kind": pa.array(np.full(n, kind, np.int32)),
            "body": pa.array(body, pa.binary()),
        }
    )


def _replies(replies: pa.Table, kind: int, bucket: np.ndarray) -> np.ndarray:
    """The bits that came back, in the order of the sorted distinct keys."""
    out = np.zeros(len(bucket), bool)
    got = {
        b: body
        for b, k, body in zip(replies["bucket"].to_pylist(), replies["kind"].to_pylist(), replies["body"].to_pylist())
        if k == kind
    }
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    to = np.r_[cut[1:], len(bucket)] if len(bucket) else cut
    for a, b in zip(cut, to):
        out[a:b] = np.unpackbits(np.frombuffer(got[int(bucket[a])], np.uint8), count=b - a)
    return out


@trimmed
def _answer_blocks(table: pa.Table) -> pa.Table:
    """For each probe of each chunk: is it an index entry of another chunk?"""
    bodies = table["body"].to_pylist()
    values, marks = [], []
    for body in bodies:
        n = len(body) * 8 // 33
        while 4 * n + (n + 7) // 8 < len(body):
            n += 1
        values.append(np.frombuffer(body, "<u4", n))
        marks.append(np.unpackbits(np.frombuffer(body, np.uint8, offset=4 * n), count=n).astype(bool))
    index = np.concatenate([v[m] for v, m in zip(values, marks)])
    keys, count = np.unique(index, return_counts=True)
    out = []
    for v, m in zip(values, marks):
        if not len(keys):
            out.append(np.packbits(np.zeros(len(v), bool)).tobytes())
            continue
        at = np.minimum(np.searchsorted(keys, v), len(keys) - 1)
        out.append(np.packbits(np.where(keys[at] == v, count[at], 0) - m > 0).tobytes())
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "kind": table["kind"], "body": pa.array(out, pa.binary())})


@trimmed
def _answer_runs(table: pa.Table) -> pa.Table:
    """For each run of each chunk: has another chunk the same run?"""
    values = [np.frombuffer(body, "<u8") for body in table["body"].to_pylist()]
    keys, count = np.unique(np.concatenate(values), return_counts=True)
    out = [np.packbits(count[np.searchsorted(keys, v)] > 1).tobytes() for v in values]
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "kind": table["kind"], "body": pa.array(out, pa.binary())})


def _runs(word_hash, first, window: int, block: int, buckets: int, replies: pa.Table):
    """Runs of ``window`` words that hold an anchor: begin, place in the distinct runs, those runs and their count here."""
    begin, inv, aligned, keys, own = _probes(word_hash, first, block, buckets)
    elsewhere = _replies(replies, 0, (keys >> U64(32)).astype(np.int64))
    hit = elsewhere[inv] | (own[inv] - aligned > 0)
    anchors = np.zeros(len(word_hash) + 1, np.int64)
    anchors[begin[hit] + 1] = 1
    anchors = np.cumsum(anchors)
    at, low = windows_hash(word_hash, first, window)
    _, high = windows_hash(word_hash, first, window, 1)
    near = anchors[at + window - block + 1] > anchors[at]
    at, low = at[near], low[near]
    bucket = (high[near] >> U64(20)) % U64(buckets)
    order = np.lexsort((low, bucket))
    b, v = bucket[order], low[order]
    new = np.r_[True, (b[1:] != b[:-1]) | (v[1:] != v[:-1])] if len(v) else np.zeros(0, bool)
    place = np.empty(len(v), np.int64)
    place[order] = np.cumsum(new) - 1
    count = np.bincount(place, minlength=int(new.sum()))
    return at, place, b[new], v[new], count


def _first_pass(block: int, buckets: int):
    @trimmed
    def run(table: pa.Table) -> pa.Table:
        *_, first, word_hash = _parse(table["text"])
        _, _, _, keys, own = _probes(word_hash, first, block, buckets)
        chunk = table["chunk"][0].as_py()
        return _messages(chunk, 0, (keys >> U64(32)).astype(np.int64), (keys & U64(0xFFFFFFFF)).astype("<u4"), own > 0)

    return run


def _second_pass(window: int, block: int, buckets: int):
    @trimmed
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        *_, first, word_hash = _parse(left["text"])
        _, _, bucket, value, _ = _runs(word_hash, first, window, block, buckets, right)
        chunk = (left if left.num_rows else right)["chunk"][0].as_py()
        return _messages(chunk, 1, bucket.astype(np.int64), value.astype("<u8"), None)

    return run


def _last_pass(window: int, block: int, buckets: int, out_schema: pa.Schema, carried: list[str], with_text: bool):
    @trimmed
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        data, off, starts, ends, first, word_hash = _parse(left["text"])
        at, place, bucket, _, count = _runs(word_hash, first, window, block, buckets, right)
        repeated = (count > 1) | _replies(right, 1, bucket.astype(np.int64))
        edge = np.zeros(len(starts) + 1, np.int64)
        begin = at[repeated[place]]
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + window, -1)
        kept = np.cumsum(edge)[:-1] == 0
        n_words = np.diff(first)
        before = np.r_[0, np.cumsum(kept)]
        n_kept = before[first[1:]] - before[first[:-1]]
        size = ends[kept] - starts[kept] + 1
        joined = np.r_[data, np.uint8(32)][ragged(starts[kept], size)]
        stop = np.cumsum(size)
        joined[stop - 1] = 32
        stop = np.r_[0, stop]
        lo, hi = stop[before[first[:-1]]], stop[before[first[1:]]]
        texts = [joined[a : max(a, b - 1)].tobytes() for a, b in zip(lo, hi)]
        columns = {c: left[c] for c in carried} | {
            "n_words": pa.array(n_words),
            "n_removed": pa.array(n_words - n_kept),
            "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
        }
        if with_text:
            columns["text"] = pa.array(
                [
                    t.decode() if gone else was
                    for t, gone, was in zip(texts, (n_words > n_kept).tolist(), left["text"].to_pylist())
                ],
                pa.string(),
            )
        return pa.table([columns[f.name] for f in out_schema], names=out_schema.names).cast(out_schema)

    return run


def substring_dedup(
    spark: SparkSession,
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    window: int = 35,
    chunk_bytes: int = 4 << 20,
    bucket_bytes: int = 8 << 20,
    keep_text: bool = False,
) -> DataFrame:
    """Removes every word covered by a ``window``-word run that starts at another place too, same document included.

    Returns ``key, n_words, n_removed, kept_sha256`` for each input row, and with ``keep_text`` all columns of the
    input: ``text`` is unchanged where nothing went, else the kept words joined by one space.

    Null and empty texts have no words (and stay as they are); a document shorter than ``window`` loses nothing;
    repeated rows are documents of their own, so a text of at least ``window`` words that occurs twice goes whole;
    a null key is carried; no rows give no rows. Columns that clash with the result's names are replaced. Chunks and
    buckets are sized from the bytes of all texts; neither drops anything. Texts are first written to the shared folder,
    each with its chunk; a chunk is a draw of rows, so no key, length or copied text fills one.
    """
    block = (window + 1) // 2
    total = text_bytes(docs, text)
    chunks = max(1, -(-total // chunk_bytes))
    buckets = max(1, -(-total * 2 // (3 * bucket_bytes)))  # a word is six bytes, its probe four
    made = ["n_words", "n_removed", "kept_sha256", "chunk"]
    carried = [c for c in docs.columns if c not in (made + [text])] if keep_text else [key]
    # dealt by row, so rows of one key (or without one) and one length are spread; written, as all passes must see one dealing
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).alias("chunk")
    dealt = table(spark, docs.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text}`").alias("text"), place))
    by_chunk = dealt.groupBy("chunk")
    blocks = by_chunk.applyInArrow(_first_pass(block, buckets), _SENT).groupBy("bucket").applyInArrow(_answer_blocks, _BACK)
    runs = (
        by_chunk.cogroup(blocks.groupBy("chunk"))
        .applyInArrow(_second_pass(window, block, buckets), _SENT)
        .groupBy("bucket")
        .applyInArrow(_answer_runs, _BACK)
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = docs.select(*[F.col(f"`{c}`") for c in carried]).schema
    for name, kind in (("n_words", "long"), ("n_removed", "long"), ("kept_sha256", "string")):
        schema = schema.add(name, kind)
    if keep_text:
        schema = schema.add("text", "string")
    done = by_chunk.cogroup(blocks.unionByName(runs).groupBy("chunk")).applyInArrow(
        _last_pass(window, block, buckets, to_arrow_schema(schema), carried, keep_text), schema
    )
    return done.withColumnRenamed("text", text) if keep_text else done


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
