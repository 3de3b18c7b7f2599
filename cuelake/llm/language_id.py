"""Language ID with bit-sliced Bloom filters.

The model is one table of slots; a slot is a bit mask with a bit for each language. A letter trigram that is usual in a
language sets that language's bit in each of its slots, so one look at an n-gram's slots, and-ed, names *all* languages
that have it. A text's hits are counted for each language, freed of the expected false hits, set against the share of
trigrams that a text of that language usually has in its own filter, and the highest decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from cuelake.llm.bpe import LETTER, Splitter
from cuelake.llm.bytesvec import U64, fmix, pieces
from cuelake.llm.store import drop, table

UNKNOWN = "und"
HASHES = 2
_BLANK = 32


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Exact keys of the letter trigrams of lower-cased words (with a blank at either end), and each text's first."""
    low = [(t or "").lower() for t in texts]
    size = np.array([len(t) + 1 for t in low], np.int64)
    points = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le"), np.uint32)
    letter = Splitter.classes(points) == LETTER
    points = np.where(letter, points, _BLANK)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each word
    keep[:1] = True
    text = np.repeat(np.arange(len(low)), size)[keep]
    points = points[keep].astype(U64)
    if len(points) < 2:
        return np.zeros(0, U64), np.zeros(len(low) + 1, np.int64)
    before = np.append(U64(_BLANK), points[:-1])
    after = np.append(points[1:], U64(_BLANK))
    middle = points != _BLANK
    key = ((before << U64(42)) | (points << U64(21)) | after)[middle]
    return key, np.searchsorted(text[middle], np.arange(len(low) + 1))


def slots(key: np.ndarray, mask: int) -> list[np.ndarray]:
    h = fmix(key)
    return [((h >> U64(24 * k)) & U64(mask)).astype(np.int64) for k in range(HASHES)]


class Model:
    """Filters of all languages; ``usual`` is the share of a language's trigrams that its own filter holds."""

    def __init__(self, grams: dict[str, np.ndarray], usual: dict[str, float]):
        self.langs = sorted(grams)
        most = max([len(g) for g in grams.values()], default=0)
        self.mask = (1 << max(10, (16 * most).bit_length())) - 1
        self.table = np.zeros((-(-max(1, len(self.langs)) // 64), self.mask + 1), U64)
        self.false = np.zeros(len(self.langs))
        self.usual = np.array([max(usual[x], 1e-9) for x in self.langs])
        for k, lang in enumerate(self.langs):
            for at in slots(grams[lang], self.mask):
                self.table[k // 64][at] |= U64(1) << U64(k % 64)
            share = ((self.table[k // 64] >> U64(k % 64)) & U64(1)).mean()
            self.false[k] = share**HASHES

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        key, first = trigrams(texts)
        n = np.diff(first)
        score = np.zeros((len(texts), len(self.langs)))
        full = np.flatnonzero(n)
        if len(full) and self.langs:
            at = slots(key, self.mask)
            for w in range(len(self.table)):
                found = self.table[w][at[0]]
                for a in at[1:]:
                    found = found & self.table[w][a]
                for k in range(w * 64, min(len(self.langs), w * 64 + 64)):
                    hits = np.add.reduceat(((found >> U64(k % 64)) & U64(1)).astype(np.int64), first[:-1][full])
                    true = (hits / n[full] - self.false[k]) / (1 - self.false[k])
                    score[full, k] = true / self.usual[k]
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = score.argmax(axis=1)
        out = np.clip(score[np.arange(len(texts)), best], 0.0, 1.0)
        out[n == 0] = 0.0
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), n.tolist())], out


def _fold(key: str, folds: int) -> Column:
    return F.crc32(F.col(f"`{key}`").cast("string")) % folds


def fit(
    docs: DataFrame, text: str = "text", lang: str = "lang", most_texts: int = 3000, least_share: float = 1e-4
) -> Model:
    """Learns from about ``most_texts`` distinct texts of each language at most, drawn by a hash of the text.

    A text counts once however often it occurs, so a text that a third of all rows share is one text.

    A trigram is kept for a language if it makes up ``least_share`` or more of that language's trigrams, so a language
    has at most ``1 / least_share`` of them: the model's size depends on the number of languages only.
    """
    known = docs.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(
        F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")
    )
    known = known.withColumn("h", F.xxhash64("text", F.lit(3)))
    sizes = {r["lang"]: max(1, r["n"]) for r in known.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not sizes:
        return Model({}, {})
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, most_texts / n) * (1 << 30)))])
    drawn = known.where(F.pmod("h", F.lit(1 << 30)) <= F.element_at(share, F.col("lang")))
    drawn = drawn.groupBy("lang", "h").agg(F.first("text").alias("text")).select("text", "lang")

    def count(batches):
        for b in pieces(batches, "text", 1 << 20):
            key, first = trigrams(b.column(0).to_pylist())
            of = np.array(b.column(1).to_pylist(), object)
            row = np.repeat(np.arange(len(of)), np.diff(first))
            for lang in sorted(set(of)):
                grams, n = np.unique(key[(of == lang)[row]], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"]
                )

    counts = drawn.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = table(docs.sparkSession, counts)
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return Model({}, {})
    least = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, float(n) * least_share)])
    kept = counts.where(F.col("n") >= F.element_at(least, F.col("lang"))).toPandas()
    drop(docs.sparkSession, counts)
    grams = {k: g["gram"].to_numpy(np.int64).view(U64) for k, g in kept.groupby("lang")}
    usual = {k: float(g["n"].sum()) / totals[k] for k, g in kept.groupby("lang")}
    return Model(grams, usual)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs``, then ``lang_pred`` and ``score`` (columns of these names are replaced)."""
    base = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place, names = base.columns.index(text), [*base.columns, "lang_pred", "score"]

    def run(batches):
        for b in pieces(batches, text, 1 << 20):
            lang, score = sent.value.predict(b.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(lang, pa.string()), pa.array(score)], names=names
            )

    schema = StructType([*base.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return base.mapInArrow(run, schema)


def language_id(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """``key, held_out, lang_pred, score`` of each whole text.

    Learns from rows whose ``crc32(key) mod folds`` is not ``held`` and whose language is known; rows with a null key
    are not learned from and not held out. Null texts and those without a letter are ``und`` with score 0, as is every
    text if nothing could be learned. Repeated rows are judged alike; no rows give no rows; other columns play no part.
    """
    fold = _fold(key, folds)
    model = fit(docs.where(fold != held), text, lang)
    out = predict(
        docs.select(
            F.col(f"`{key}`").alias("id"), F.coalesce(fold == held, F.lit(False)).alias("held_out"), F.col(f"`{text}`").alias("text")
        ),
        model,
    )
    return out.select(F.col("id").alias(key), "held_out", "lang_pred", "score")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
