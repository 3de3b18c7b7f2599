"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance shrunk towards its diagonal and towards a common scale; their Cholesky factors
are made once. A score is the logistic of the difference of the two log densities (half of each squared Mahalanobis
distance, and the factors' log determinants) and the log odds of the classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.bytesvec import pieces, raw, spans_hash, words

STATISTICS = [
    "log_words", "word_length", "word_length_spread", "distinct", "echo", "symbols", "marks", "digits", "capitals",
    "odd_ends", "line_length", "repeated_lines", "long_bytes",
]
_KIND = np.zeros(256, np.uint8)  # 0: anything else
_KIND[[*range(65, 91)]] = 1  # capitals
_KIND[[*range(97, 123), *range(128, 256)]] = 2  # other letters, and all bytes of longer characters
_KIND[[*range(48, 58)]] = 3
_KIND[[ord(c) for c in ".,;:'\"-?()"]] = 4
_KIND[[32, *range(9, 14)]] = 5
#: Second bytes of two-byte capitals that follow the byte 0xC3.
_WIDE_CAPITAL = (0x80, 0x9E)


def _share(part: np.ndarray, whole: np.ndarray, more: float) -> np.ndarray:
    """Log odds of a share, damped at both ends; ``more`` places without the mark keep short texts from standing out."""
    p = part / (whole + more)
    return np.log((p + 0.01) / (1.01 - p))


def statistics(text) -> np.ndarray:
    """One row of ``STATISTICS`` for each text; an empty one has the values of no words."""
    data, off = raw(text)
    n = len(off) - 1
    starts, ends, first = words(data, off)
    doc = np.repeat(np.arange(n), np.diff(first))
    n_words = np.diff(first).astype(float)
    size = (ends - starts).astype(float)

    def of_bytes(mask: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(mask))
        return (total[off[1:]] - total[off[:-1]]).astype(float)

    def of_words(x: np.ndarray) -> np.ndarray:
        return np.bincount(doc, x, minlength=n).astype(float)

    kind = _KIND[data]
    chars = of_bytes((data & 0xC0) != 0x80)
    wide = np.zeros(len(data), bool)
    if len(data) > 1:
        wide[1:] = (data[:-1] == 0xC3) & (data[1:] >= _WIDE_CAPITAL[0]) & (data[1:] <= _WIDE_CAPITAL[1])
    capitals = of_bytes((kind == 1) | wide)
    letters = of_bytes(((kind == 1) | (kind == 2)) & ((data & 0xC0) != 0x80))
    h = spans_hash(data, starts, ends)
    order = np.lexsort((h, doc))
    sorted_h, sorted_doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (sorted_h[1:] != sorted_h[:-1]) | (sorted_doc[1:] != sorted_doc[:-1])
    distinct = np.bincount(sorted_doc[new], minlength=n).astype(float)
    echo = np.zeros(len(h), bool)
    echo[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    mean = of_words(size) / np.maximum(n_words, 1)
    spread = np.sqrt(np.maximum(0, of_words(size**2) / np.maximum(n_words, 1) - mean**2))
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    odd = (_KIND[last] == 0) & (last < 128)
    cut = data == 10
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    line_start = np.flatnonzero(~cut & (edge[:-1] | np.append(True, cut[:-1]))) if len(data) else np.zeros(0, np.int64)
    line_end = np.flatnonzero(~cut & (edge[1:] | np.append(cut[1:], True))) + 1 if len(data) else np.zeros(0, np.int64)
    line_doc = np.searchsorted(off, line_start, "right") - 1
    n_lines = np.bincount(line_doc, minlength=n).astype(float)
    line_hash = spans_hash(data, line_start, line_end)
    pair = np.lexsort((line_hash, line_doc))
    again = np.zeros(len(pair), bool)
    again[1:] = (line_hash[pair][1:] == line_hash[pair][:-1]) & (line_doc[pair][1:] == line_doc[pair][:-1])
    repeated = np.bincount(line_doc[pair][again], minlength=n).astype(float)
    return np.column_stack(
        [
            np.log1p(n_words),
            np.log1p(mean),
            np.log1p(spread),
            np.log((distinct + 1) / (n_words + 1)) / np.maximum(1.0, np.log1p(n_words)),
            _share(of_words(echo), n_words, 20),
            _share(of_bytes((kind == 0) & (data < 128)), chars, 100),
            _share(of_bytes(kind == 4), chars, 100),
            _share(of_bytes(kind == 3), chars, 100),
            _share(capitals, letters, 100),
            _share(of_words(odd), n_words, 20),
            np.log1p(chars / np.maximum(n_lines, 1)),
            _share(repeated, n_lines, 6),
            _share(of_bytes(data >= 128), chars * 2, 100),
        ]
    )


class Discriminant:
    """Two shrunk Gaussians. ``rows`` of the classes 0 and 1; a class with no row takes the other's scale and mean."""

    def __init__(self, rows: np.ndarray, label: np.ndarray, towards_diagonal: float = 0.1, towards_scale: float = 0.3):
        d = rows.shape[1]
        self.middle = rows.mean(axis=0) if len(rows) else np.zeros(d)
        self.scale = np.maximum(rows.std(axis=0), 1e-3) if len(rows) else np.ones(d)
        z = (rows - self.middle) / self.scale
        self.mean, self.factor, self.log_det, self.log_odds = [], [], [], 0.0
        count = [int((label == k).sum()) for k in (0, 1)]
        for k in (0, 1):
            own = z[label == k] if count[k] else z
            mean = own.mean(axis=0) if len(own) else np.zeros(d)
            cov = np.cov(own, rowvar=False, bias=True) if len(own) > 1 else np.eye(d)
            cov = (1 - towards_diagonal) * cov + towards_diagonal * np.diag(np.diag(cov))
            cov = (1 - towards_scale) * cov + towards_scale * np.eye(d)
            lower = np.linalg.cholesky(cov)
            self.mean.append(mean)
            self.factor.append(np.linalg.inv(lower))
            self.log_det.append(float(np.log(np.diag(lower)).sum()))
        self.log_odds = float(np.log((count[1] + 1) / (count[0] + 1)))

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = (rows - self.middle) / self.scale
        far = [((z - self.mean[k]) @ self.factor[k].T) ** 2 for k in (0, 1)]
        gap = 0.5 * (far[0].sum(axis=1) - far[1].sum(axis=1)) + self.log_det[0] - self.log_det[1] + self.log_odds
        return 1 / (1 + np.exp(-np.clip(gap, -500, 500)))


def _labelled_statistics(rows: DataFrame) -> DataFrame:
    """``label, x`` from ``label, text``: x are the statistics."""

    def run(batches):
        for b in pieces(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(list(statistics(b.column(1))), pa.list_(pa.float64()))], names=["label", "x"]
            )

    return rows.select("label", "text").mapInArrow(run, "label int, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, most_rows: int = 20_000) -> Discriminant:
    """Learns from about ``most_rows`` labelled keys at most, drawn by a hash of the key.

    A key counts once with each of its labels, and with one text (of several that with the least hash), however often it
    is repeated on either side, so neither the sample nor what is sent to the workers grows with a key.
    """
    known = labels.where(F.col("label").isNotNull() & F.col("label_key").isNotNull())
    n = known.agg(F.approx_count_distinct("label_key", 0.02)).first()[0]
    share = int(min(1.0, most_rows / max(1, n)) * (1 << 30))
    drawn = known.where(F.pmod(F.xxhash64("label_key", F.lit(5)), F.lit(1 << 30)) <= share).distinct()
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    found = rows.join(F.broadcast(drawn), F.col("id") == F.col("label_key"))
    one = found.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = _labelled_statistics(one).collect()
    x = np.array([r["x"] for r in got], float).reshape(-1, len(STATISTICS))
    return Discriminant(x, np.array([r["label"] for r in got], int))


def quality(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    folds: int = 5,
    held: int = 0,
    threshold: float = 0.3,
    most_rows: int = 20_000,
) -> DataFrame:
    """``key, held_out, score, predicted`` of each whole text; score is the probability of label 1.

    Learns from labels whose ``crc32(key) mod folds`` is not ``held``. Null texts are empty; empty texts are scored by
    the statistics of no words; rows with a null key are scored and not held out; null labels are not learned from;
    repeated rows are scored alike, repeated rows and labels are learned from once; without any label the score is 0.5.
    No rows give no rows; other columns play no part.
    """
    fold = lambda c: F.crc32(c.cast("string")) % folds
    seen = labels.select(F.col(f"`{key}`").alias("label_key"), F.col(f"`{label}`").cast("int").alias("label")).where(
        fold(F.col("label_key")) != held
    )
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, seen, key, text, most_rows))

    def run(batches):
        for b in pieces(batches, "text", 1 << 20):
            score = model.value.score(statistics(b.column(2)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                names=["id", "held_out", "score", "predicted"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return (
        docs.select(
            F.col(f"`{key}`").alias("id"),
            F.coalesce(fold(F.col(f"`{key}`")) == held, F.lit(False)).alias("held_out"),
            F.col(f"`{text}`").alias("text"),
        )
        .mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int")
        .withColumnRenamed("id", key)
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
