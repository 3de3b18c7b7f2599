"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, substring dedup, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents`` and work on every row their predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import language_id as lid
from cuelake.llm.line_dedup import drop_repeated_lines
from cuelake.llm.packing import packed_steps
from cuelake.llm.simhash import simhash_firsts
from cuelake.llm.store import drop, sweep, table, table_mark, text_hashes
from cuelake.llm.substring_dedup import substring_dedup

#: No SQL says the same; the stages are held against brute-force versions in tests/llm.
ORACLE_SQL = None


#: Texts with a lower score for every language are in none that was learned. Half the least score that a learning-fold
#: document got in its own language (0.40 on sf0.1, 0.43 on 51,282 documents), so no clean one goes.
LEAST_SCORE = 0.2


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no language can be told go, the rest stays as it is, repeated rows and null keys among it.

    These are null and empty texts, texts without a letter, and texts whose best score is below ``LEAST_SCORE`` (letters
    in no order that any learned language has). Where nothing could be learned nothing can be told, and no row stays; no
    rows give no rows.
    """
    model = lid.fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    told = (F.col("lang_pred") != lid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    own = {c: f"_own_{c}" for c in ("lang_pred", "score") if c in docs.columns}
    kept = lid.predict(docs.withColumnsRenamed(own), model).where(told)
    return kept.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and nearly equal lines the first stays; ``n_chars`` follows the text.

    Null and empty texts stay as they are; rows with a null or repeated key lose their own lines only, rows with the same
    key and text are taken for one, so both keep what one keeps; no rows give no rows.
    """
    return _counted(drop_repeated_lines(spark, docs), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their fingerprints one row stays: that of the smallest key (nulls last; then by hashes of the text).

    Null and empty texts are alike, so one of them stays; repeated rows are copies; null and repeated keys with different
    texts compete only where their texts are linked; no rows give no rows.
    """
    firsts = table(spark, simhash_firsts(spark, docs))
    again = firsts.where("n > 1")
    if again.isEmpty():
        return _of(docs, firsts)
    # rows equal in key and text: the one with the least other columns stays
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    least = [F.min(F.struct(*rest)).alias("_rest")] if rest else []
    one = _of(docs, again).select("*", *text_hashes("text")).groupBy("doc_id", "text_hash", "text_hash2").agg(F.first("text").alias("text"), *least)
    one = one.select("doc_id", "text", *[f"_rest.{c}" for c in rest]).select(*docs.columns)
    return _of(docs, firsts.where("n = 1")).unionByName(one)


def _of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows by key and text. Hashed, as one side is every text: nothing is sorted, and the plan is the same at every size."""
    one, two = text_hashes("text")
    rows = rows.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("text_hash2").alias("_hash2"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & one.eqNullSafe(F.col("_hash")) & two.eqNullSafe(F.col("_hash2"))
    return docs.join(rows.hint("shuffle_hash"), same, "left_semi")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that occur elsewhere too go; texts without any stay as they are; ``n_chars`` follows the text.

    Null texts stay null; rows of one key are documents of their own; repeated rows repeat each other's passages; no rows
    give no rows.
    """
    return _counted(substring_dedup(spark, docs, keep_text=True), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed documents: a row a piece, every id of every document in one of them.

    Null and empty texts are one id long; repeated rows and keys are packed like any other; no rows give no rows.
    """
    import public_tokenizers

    return packed_steps(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


def _counted(new: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return new.select(*docs.columns)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", line_dedup),
    ("simhash", near_dedup),
    ("substring", repeated_passages),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage wrote on its way is deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        made, before = table_mark(), docs
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = table(spark, docs)
            sweep(spark, made, [docs])
            if name != STAGES[0][0]:
                drop(spark, before)
    return docs
