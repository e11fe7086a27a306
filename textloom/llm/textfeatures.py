"""Hashed text features and bounded samples of labelled rows, for the classifiers."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORDS, Scratch, few, tidy

_P, _M = np.uint64(1099511628211), np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a text handled at once; longer texts are taken in overlapping pieces.
PIECE = 1 << 20


def char_ngrams(data: bytes, sizes: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """Slots, in a table of 2**bits, of all byte n-grams of the given sizes."""
    shift, most = np.uint64(64 - bits), max(sizes)
    for at in range(0, max(1, len(data)), PIECE):
        b = np.frombuffer(data, np.uint8, min(len(data), at + PIECE + most - 1) - at, at).astype(np.uint64) + np.uint64(1)
        h = b
        for n in range(1, most + 1):
            if n > 1:
                h = h[:-1] * _P + b[n - 1 :]
            if n in sizes:
                # a piece owns the n-grams that start in it
                yield ((h[:PIECE] * _M) >> shift).astype(np.int32)


def word_slots(words: list[bytes], bits: int) -> np.ndarray:
    return (WORDS.of(words) >> np.uint64(64 - bits)).astype(np.int32)


class Distinct:
    """Distinct values of slot arrays, by a scratch table instead of a sort."""

    def __init__(self, bits: int):
        self.last = np.empty(1 << bits, np.int32)

    def __call__(self, slots: np.ndarray) -> np.ndarray:
        order = np.arange(len(slots), dtype=np.int32)
        self.last[slots] = order
        return slots[self.last[slots] == order]


#: UTF-8 bytes of texts on which a classifier is fitted, at most.
SAMPLE_BYTES = 64_000_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, use: Column, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y): at most ``per_class`` labelled rows of each class and ``SAMPLE_BYTES`` of text in all, whole texts.

    The first ones by a hash of their id, then by one of their text; a text
    that no longer fits is passed over.  ``use`` is a condition on ``doc_id``.
    Label rows without a text, an id or a label, and ids that appear with both
    labels, do not count; rows that are equal in id and text count once.
    """
    rows = _judged(labels, label, use, id_col)
    first = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    # at most 2 * per_class ids are broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    near = texts.join(F.broadcast(first[0].unionByName(first[1])), "doc_id").select("doc_id", F.xxhash64("text").alias("hash"), F.octet_length("text").alias("bytes"), "y")
    taken, left = [], SAMPLE_BYTES
    # an id may have any number of texts, so of them, too, only the first come here: at most 2 * per_class rows
    by_class = [near.where(F.col("y") == y).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "hash").limit(per_class).collect() for y in (0, 1)]
    for pair in zip_longest(*by_class):
        for r in filter(None, pair):
            if r["bytes"] <= left:
                taken.append((r["doc_id"], r["hash"], r["y"]))
                left -= r["bytes"]
    wanted = docs.sparkSession.createDataFrame(taken, "doc_id long, hash long, y int")
    return texts.withColumn("hash", F.xxhash64("text")).join(F.broadcast(wanted), ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"]).select("text", "y")


def labelled_rows(s: Scratch, docs: DataFrame, labels: DataFrame, label: str, use: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, hash, y) of every labelled row, whole texts; which rows count is as for ``labelled_sample``."""
    rows = few(s.keep(_judged(labels, label, use, id_col), "judged"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    return texts.join(rows, "doc_id").withColumn("hash", F.xxhash64("text")).dropDuplicates(["doc_id", "hash"]).select("doc_id", "text", "hash", "y")


def _judged(labels: DataFrame, label: str, use: Column, id_col: str) -> DataFrame:
    """(doc_id, y) of the ids in use that have one label."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).where(use)
    return rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("doc_id", "y")


def fitted(sample: DataFrame, fit) -> list[np.ndarray]:
    """What ``fit`` makes of the texts and labels of a bounded sample: float32 arrays.

    Fitting runs in one task, whose input has the sample's bound; only the
    model comes to the driver.
    """

    def run(batches):
        rows = sorted((t, y) for b in batches for t, y in zip(b["text"].to_pylist(), b["y"].to_pylist(), strict=True))
        made = fit([t for t, _ in rows], np.array([y for _, y in rows], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(made)), pa.int32()), pa.array([np.asarray(a, "<f4").tobytes() for a in made], pa.binary())], names=["k", "data"])

    got = sorted(sample.repartition(1).mapInArrow(tidy(run), "k int, data binary").collect())
    # a sample without rows may have no task
    return [np.frombuffer(bytes(r["data"]), "<f4") for r in got] or [np.asarray(a, "<f4") for a in fit([], np.empty(0, np.int64))]


def class_share(labels: DataFrame, label: str, use: Column, least: float, most: float, id_col: str = "doc_id") -> float:
    """The share of class 1 among all labelled rows in use, within bounds."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(use & F.col("y").isin(0, 1))
    share = rows.agg(F.avg("y")).first()[0]
    return min(most, max(least, share if share is not None else least))


def remainder(mod: int) -> Column:
    """crc32 of the id's text, modulo."""
    return F.crc32(F.col("doc_id").cast("string")) % mod


def scored(docs: DataFrame, score, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) from a function of a list of texts."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(score(b["text"]), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, score double")
