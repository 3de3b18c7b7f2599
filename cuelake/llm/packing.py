"""Hierarchical multi-length packing.

Documents become ids once (each distinct word is given to the tokenizer library once a worker) and are routed by length
to context tiers. What is longer than the longest tier is cut into full windows; each tier's remainders open windows of
their own tier, longest tier first; the gap of a window is filled with whole documents of shorter tiers, longest fitting
first, and the last few places with the head of one more, so windows end full. What no window of its tier can fill waits
for the next documents of the task; at the end of the task it goes to ever shorter windows of a power of two. That is one
scan: no exchange of texts, and a task holds one piece of text and at most a few windows' worth of ids.

Then the windows of each length, of all tasks, are dealt to step groups of equal numbers of tokens (``deal_steps``): the
windows are numbered in their task, the tasks' counts are summed up, and only one group of a length is partial. Pieces
stay where they are.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.llm.bpe import Memo
from cuelake.llm.bytesvec import pieces, ragged, raw, spans_hash, words
from cuelake.llm.store import table

TIERS = (2048, 1024, 512, 256)
END_ID = 1
STEP_TOKENS = 1 << 16
_TASK = 40  # a window's number in its task has so many bits


class WordIds:
    """Ids of whole texts by a vocabulary that drops white space, a distinct blank-free word at a time."""

    _made: dict[str, WordIds] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok, self.memo = Tokenizer.from_file(path), Memo()
        self.tok.no_truncation()
        self.tok.no_padding()

    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode(self, text) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin."""
        data, off = raw(text)
        starts, ends, first = words(data, off)

        def own(places: np.ndarray):
            body = data.tobytes()
            all_ids, count = [], np.zeros(len(places), np.int64)
            for at in range(0, len(places), 4096):
                part = places[at : at + 4096]
                got = self.tok.encode(
                    [body[a:z].decode() for a, z in zip(starts[part].tolist(), ends[part].tolist())],
                    is_pretokenized=True,
                    add_special_tokens=False,
                )
                all_ids.append(np.array(got.ids, np.uint32))
                count[at : at + len(part)] = np.bincount(np.array(got.word_ids, np.int64), minlength=len(part))
            return np.concatenate(all_ids), count

        at = self.memo.look(spans_hash(data, starts, ends), own)
        count = self.memo.count[at]
        before = np.append(0, np.cumsum(count))
        return self.memo.ids[ragged(self.memo.first[at], count)], before[first]


class Packer:
    """Windows from documents that come one after the other; rows as they become final."""

    def __init__(self, task: int, tiers: tuple[int, ...] = TIERS):
        self.base, self.tiers, self.next = task << _TASK, tiers, 0
        self.of_tier: dict[int, int] = {}  # windows of each length so far
        self.sizes: list[int] = []  # of what waits, ascending, and in the same order what it is
        self.waiting: list[tuple] = []
        self.rows: list[tuple] = []

    def _put(self, item: tuple) -> None:
        at = bisect.bisect_right(self.sizes, item[3])
        self.sizes.insert(at, item[3])
        self.waiting.insert(at, item)

    def _take(self, at: int) -> tuple:
        del self.sizes[at]
        return self.waiting.pop(at)

    def _window(self, items: list[tuple], tier: int) -> None:
        number = self.base + self.next
        self.next += 1
        place = self.of_tier.get(tier, 0)
        self.of_tier[tier] = place + 1
        at = 0
        for key, ids, start, size, whole in items:
            self.rows.append((key, start, size, zlib.crc32(ids), whole, number, at, tier, place))
            at += size

    def add(self, key, ids: np.ndarray) -> None:
        whole, top, at = len(ids), self.tiers[0], 0
        while whole - at >= top:
            self._window([(key, ids[at : at + top].tobytes(), at, top, whole)], top)
            at += top
        if at < whole:
            self._put((key, ids[at:].tobytes(), at, whole - at, whole))

    def _fill(self, tier: int, opener: tuple | None) -> None:
        items, gap = [], tier
        if opener:
            items, gap = [opener], tier - opener[3]
        while gap:
            at = bisect.bisect_right(self.sizes, gap) - 1
            if at >= 0 and (self.sizes[at] * 2 > gap or len(self.sizes) == at + 1):
                item = self._take(at)  # the longest that fits, if it is a good part of the gap
            else:
                key, ids, start, size, whole = self._take(min(at + 1, len(self.sizes) - 1))
                item = (key, ids[: 4 * gap], start, min(gap, size), whole)
                if size > gap:
                    self._put((key, ids[4 * gap :], start + gap, size - gap, whole))
            items.append(item)
            gap -= item[3]
        self._window(items, tier)

    def settle(self) -> None:
        """Full windows of every tier from what waits."""
        left = sum(self.sizes)
        for tier, below in zip(self.tiers, (*self.tiers[1:], 0)):
            while left >= tier and self.sizes and below < self.sizes[-1] <= tier:
                self._fill(tier, self._take(len(self.sizes) - 1))
                left -= tier

    def finish(self) -> None:
        """Everything that waits, the last of it in ever shorter windows of a power of two."""
        self.settle()
        left = sum(self.sizes)
        size = self.tiers[0]
        while left:
            while size > left:
                size //= 2
            self._fill(size, None)
            left -= size


_OUT = (
    "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, tier_no long"
)
_NAMES = ["id", *(x.split()[0] for x in _OUT.split(", "))]
_TYPES = [*[pa.int64()] * 6, pa.int32(), pa.int64()]


def pack(
    docs: DataFrame,
    vocab: str,
    key: str = "doc_id",
    text: str = "text",
    tiers: tuple[int, ...] = TIERS,
) -> DataFrame:
    """One row a piece: ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, tier_no``.

    A document is its ids and ``END_ID``; a null or empty text is the end id alone. ``sequence_id`` is unique over all
    tasks, ``offset`` gapless from 0 within it. ``tier`` is the window's length, ``tier_no`` its
    number among the windows of that length of its task. Repeated rows and null keys are packed like any other; no rows give no rows; other columns of the input
    play no part. Tiers are powers of two, longest first.
    """
    kind = docs.schema[key].dataType

    def run(batches):
        coder = WordIds.of(vocab)
        packer = Packer(TaskContext.get().partitionId(), tiers)

        def flush():
            if packer.rows:
                columns = list(zip(*packer.rows))
                packer.rows = []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], id_type), *(pa.array(c, t) for c, t in zip(columns[1:], _TYPES))], names=_NAMES
                )

        for b in pieces(batches, "text", 1 << 20):
            id_type = b.schema.field(0).type
            ids, first = coder.encode(b.column(1))
            spans = zip(b.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist())
            end = np.array([END_ID], "<u4")
            for k, a, z in spans:
                packer.add(k, np.concatenate([ids[a:z].astype("<u4"), end]))
            packer.settle()
            yield from flush()
        packer.finish()
        yield from flush()

    return (
        docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
        .mapInArrow(run, f"id {kind.simpleString()}, {_OUT}")
        .withColumnRenamed("id", key)
    )


def deal_steps(packed: DataFrame, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """``step_group`` in the place of ``tier_no``, for the pieces of a written table of ``pack``.

    Every group holds windows of one length, ``step_tokens`` tokens of them (one window where that is longer), but the
    last group of each length, which holds what is left. Only the tasks' counts are summed up, a row a task and length;
    pieces stay where they are. No rows give no rows.
    """
    task = F.shiftright("sequence_id", _TASK).alias("task")
    counts = packed.where("offset = 0").groupBy(task, "tier").agg(F.count("*").alias("n"))
    upto = W.partitionBy("tier").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("task", F.col("tier").alias("length_"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    per = F.greatest(F.lit(1), F.floor(F.lit(step_tokens) / F.col("tier")))
    group = F.col("tier").cast("long") * (1 << _TASK) + F.floor((F.col("before") + F.col("tier_no")) / per)
    same = (F.shiftright("sequence_id", _TASK) == F.col("task")) & (F.col("tier") == F.col("length_"))
    return packed.join(before, same).withColumn("step_group", group.cast("long")).drop("task", "length_", "before", "tier_no")


def packed_steps(spark: SparkSession, docs: DataFrame, vocab: str) -> DataFrame:
    """Pieces of the packed documents with their step groups."""
    return deal_steps(table(spark, pack(docs, vocab)))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_steps(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
