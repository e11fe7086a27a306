"""Substring deduplication on a compacted de Bruijn graph of words.

Runs of ``size`` words are the edges of a de Bruijn graph.  An edge is found
through its minimizer, the least-hashed run of ``MINI`` words in it (the first
on ties), so equal edges always have the same one.  Consecutive edges of a text
with one minimizer form a path, kept as one row (a super-k-mer):

1. Paths are counted by their hash.  Through most minimizers leads one path
   only, so it cannot branch: its edges repeat if and only if it occurs twice,
   and it is never taken apart.
2. Where several different paths share a minimizer, a join expands them, one
   occurrence each with the number of its copies, into their edges, and edges
   are counted by the hash of their words.
3. Compaction: paths and edges found twice are joined with their neighbours in
   the same text.  Of two neighbours the first of which never has another
   successor, and the second never another predecessor, nor ever none, every
   occurrence is one piece, so such runs become one maximal nonbranching path.
4. Verification: at the source coordinates of its occurrences the words of each
   compacted path are hashed again as text, with 128 bits.  Where occurrences of
   a path differ, its 64-bit hashes have collided; all edges through its
   minimizers are then judged anew by 128-bit hashes of their words.
5. Each word that the verified paths cover is removed.

All edges of all texts are judged, on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, WORDS, ascii_words, few, mix, signed, tidy, windows

#: Words of a minimizer.
MINI = 8

_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        steps = np.full(max(n + 1, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have


class Runs:
    """Hashes of runs of words of one text."""

    def __init__(self, h: np.ndarray):
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * _power(_BASE, len(h))[: len(h)], out=self.sums[1:])
        self.back = _power(pow(_BASE, -1, 1 << 64), len(h))

    def of(self, start: np.ndarray, words: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + words] - self.sums[start]) * self.back[start] + np.asarray(words).astype(np.uint64))


def paths(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, path, first edge, edges) of the paths of one text's word hashes."""
    mini = min(MINI, size)
    if len(h) < size:
        empty = np.empty(0, np.uint64)
        return empty, empty, np.empty(0, np.int64), np.empty(0, np.int64)
    g = windows(h, mini)
    span, n = size - mini + 1, len(h) - size + 1
    at = np.concatenate([i + sliding_window_view(g[i : i + 65536 + span - 1], span).argmin(1) + np.arange(min(65536, n - i)) for i in range(0, n, 65536)])
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    count = np.diff(np.r_[start, n])
    return g[at[start]], Runs(h).of(start, count + size - 1), start, count


def repeated_words(docs: DataFrame, size: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row for each input row.

    Words (split at ASCII white space, unchanged) covered by a run of ``size``
    words that also starts elsewhere are removed; kept_sha256 is of the others
    joined by a space.  Null and empty texts have no words; shorter texts lose
    none.  Rows with equal ids are separate texts; repeated rows repeat each
    other.  Other columns are ignored.
    """
    spark = docs.sparkSession
    s = Scratch(spark, "debruijn")
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    read = read.withColumn("key", F.xxhash64("doc_id", "text"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, sha, cols = [], [], ([], [], [], [])
            for text in b["text"]:
                w = ascii_words(text.as_py())
                words.append(len(w))
                sha.append(hashlib.sha256(b" ".join(w)).hexdigest())
                m, p, start, count = paths(WORDS.of(w), size)
                for c, v in zip(cols, (signed(m), signed(p), start.astype(np.int32), count.astype(np.int32)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["key"], pa.array(words, pa.int64()), pa.array(sha), *[pa.array(c, pa.list_(t)) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)]],
                names=["doc_id", "key", "n_words", "sha", "mini", "path", "start", "edges"],
            )

    texts = s.keep(read.select("doc_id", "key", "text").mapInArrow(tidy(first), "doc_id long, key long, n_words long, sha string, mini array<long>, path array<long>, start array<int>, edges array<int>"), "texts")

    at = texts.select("key", F.explode(F.arrays_zip("mini", "path", "start", "edges")).alias("p")).select("key", "p.*")
    counted = s.keep(at.groupBy("path", "mini").agg(F.count("*").alias("m")), "counted")
    several = few(s.keep(counted.groupBy("mini").agg(F.count("*").alias("ways")).where("ways > 1").select("mini", F.lit(True).alias("branch")), "several"))
    marked = counted.join(several, "mini", "left").where("m > 1 or branch").select("path", "mini", "m", F.coalesce("branch", F.lit(False)).alias("branch"))
    found = s.keep(at.join(marked, ["path", "mini"]), "found")
    s.drop("counted", "several")

    # one occurrence of each branching path, with the number of its copies
    one = found.where("branch").groupBy("path").agg(F.min(F.struct("key", "start", "edges", "m", "mini")).alias("p")).select("p.*")
    one = s.keep(one.groupBy("key").agg(F.collect_list(F.struct("start", "edges", "m", "mini")).alias("p")), "branching")
    keys = few(s.keep(one.select("key"), "branching_keys"))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text, p in zip(b["key"].to_pylist(), b["text"], b["p"].to_pylist(), strict=True):
                runs = Runs(WORDS.of(ascii_words(text.as_py())))
                start = np.concatenate([np.arange(x["start"], x["start"] + x["edges"]) for x in p])
                m, mini = (np.repeat(np.array([x[c] for x in p], np.int64), [x["edges"] for x in p]) for c in ("m", "mini"))
                yield pa.RecordBatch.from_arrays([pa.array(signed(runs.of(start, size))), pa.array(np.full(len(start), key)), pa.array(start.astype(np.int32)), pa.array(m), pa.array(mini)], names=["edge", "key", "start", "m", "mini"])

    def named(keys: DataFrame, rows: DataFrame) -> DataFrame:
        """``rows``, unique by key, with the texts."""
        return read.select("key", "text").join(keys, "key", "left_semi").dropDuplicates(["key"]).join(rows, "key").select("key", "text", "p")

    edge = s.keep(named(keys, one).mapInArrow(tidy(edges), "edge long, key long, start int, m long, mini long"), "edges")
    twice = few(s.keep(edge.groupBy("edge").agg(F.sum("m").alias("all")).where("`all` > 1").select("edge"), "twice"))
    loose = edge.where("m = 1").join(twice, "edge").select("key", "start", F.lit(1).alias("edges"), F.col("edge").alias("unit"), "mini")
    # rows that are equal have one key
    whole = found.where("m > 1").select("key", "start", "edges", F.col("path").alias("unit"), "mini").dropDuplicates(["key", "start"])
    units = s.keep(whole.unionByName(loose), "units")
    s.drop("found", "edges", "branching", "branching_keys", "twice")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, removed, sha, proof = [], [], [], []
            for text, p in zip(b["text"], b["p"].to_pylist(), strict=True):
                w = ascii_words(text.as_py())
                step = np.zeros(len(w) + 1, np.int64)
                np.add.at(step, [x["start"] for x in p], 1)
                np.add.at(step, [x["start"] + x["edges"] - 1 + size for x in p], -1)
                gone = np.cumsum(step[:-1]) > 0
                words.append(len(w)), removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(b" ".join([w[i] for i in np.flatnonzero(~gone)])).hexdigest())
                proof.append([{"chain": x["chain"], "words": _digest(w[x["start"] : x["start"] + x["edges"] - 1 + size])} for x in p if x["chain"] is not None])
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["key"], pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(proof, _PROOF)], names=["doc_id", "key", "n_words", "n_removed", "kept_sha256", "proof"])

    def judged(spans: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Texts with the words of (key, chain, start, edges) taken out, and the keys of these texts."""
        spans = s.keep(spans.groupBy("key").agg(F.collect_list(F.struct("chain", "start", "edges")).alias("p")), f"{name}_spans")
        hit = few(s.keep(spans.select("key"), f"{name}_hit"))
        touched = read.join(hit, "key", "left_semi").join(spans, "key").select("doc_id", "key", "text", "p")
        schema = "doc_id long, key long, n_words long, n_removed long, kept_sha256 string, proof array<struct<chain:long,words:binary>>"
        return s.keep(touched.mapInArrow(tidy(cut), schema), f"{name}_texts"), hit

    touched, hit = judged(_compacted(s, units), "verified")
    proofs = touched.select(F.explode("proof").alias("p")).groupBy("p.chain").agg(F.min("p.words").alias("x"), F.max("p.words").alias("y"))
    collided = s.keep(proofs.where("x <> y").select("chain"), "collided")
    if collided.count():
        # judged anew: every edge through a minimizer of a path whose occurrences differ
        spans = s.spark.read.parquet(s.path("verified_spans")).select("key", F.explode("p").alias("p")).select("key", "p.*").join(few(collided), "chain", "left_semi")
        spans = spans.select("key", F.col("start").alias("lo"), (F.col("start") + F.col("edges")).alias("hi"))
        bad = few(s.keep(units.join(spans, "key").where("start >= lo and start < hi").select("mini").distinct(), "bad"))
        again = s.keep(at.join(bad, "mini").groupBy("key", "start", "edges").agg(F.count("*").alias("m")), "again")
        listed = s.keep(again.groupBy("key").agg(F.collect_list(F.struct("start", "edges", "m")).alias("p")), "listed")

        def strong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for key, text, p in zip(b["key"].to_pylist(), b["text"], b["p"].to_pylist(), strict=True):
                    w = ascii_words(text.as_py())
                    rows = [(key, k, _digest(w[k : k + size]), x["m"]) for x in p for k in range(x["start"], x["start"] + x["edges"])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.int64()), strict=True)], names=["key", "start", "words", "m"])

        edge = s.keep(named(few(s.keep(listed.select("key"), "listed_keys")), listed).mapInArrow(tidy(strong), "key long, start int, words binary, m long"), "strong")
        twice = few(s.keep(edge.groupBy("words").agg(F.sum("m").alias("all")).where("`all` > 1").select("words"), "strong_twice"))
        none = F.lit(None).cast("long").alias("chain")
        right = edge.join(twice, "words").select("key", none, "start", F.lit(1).alias("edges"))
        spans = units.join(bad, "mini", "left_anti").select("key", none, "start", "edges").unionByName(right).distinct()
        touched, hit = judged(spans, "anew")
    s.drop("units")
    rest = texts.select("doc_id", "key", "n_words", "sha").join(hit, "key", "left_anti")
    return touched.select("doc_id", "n_words", "n_removed", "kept_sha256").unionByName(rest.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256")))


_PROOF = pa.list_(pa.struct([("chain", pa.int64()), ("words", pa.binary())]))


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _compacted(s: Scratch, units: DataFrame) -> DataFrame:
    """(key, run, chain, start, edges): the maximal nonbranching paths of ``units`` (key, start, edges, unit), one row for each occurrence.

    A chain is named by its first unit.  As two joined units are neighbours
    wherever either occurs, a text's run of joined units is the whole chain.
    """
    text = Window.partitionBy("key").orderBy("start")
    after = F.when(F.lead("start").over(text) == F.col("start") + F.col("edges"), F.lead("unit").over(text))
    pairs = s.keep(units.select(F.col("unit").alias("u"), after.alias("v")).groupBy("u", "v").agg(F.count("*").alias("n")), "pairs")
    after = pairs.groupBy("u").agg(F.min("v").alias("v"), F.count("*").alias("ways"), F.sum("n").alias("n"))
    before = pairs.where("v is not null").groupBy("v").agg(F.min("u").alias("u"), F.count("*").alias("ways"), F.sum("n").alias("n"))
    # the sum of what follows a unit is the number of its occurrences
    sole = before.where("ways = 1").join(after.select(F.col("u").alias("v"), F.col("n").alias("all")), "v").where("n = `all`").select("u", "v")
    joined = few(s.keep(sole.join(after.where("ways = 1 and v is not null").select("u", "v"), ["u", "v"]).where("u <> v").select(F.col("v").alias("unit"), F.lit(1).alias("follows")), "joined"))
    s.drop("pairs")
    marked = units.join(joined, "unit", "left").withColumn("run", F.sum(F.when(F.col("follows").isNull(), 1).otherwise(0)).over(text))
    return marked.groupBy("key", "run").agg(F.min_by("unit", "start").alias("chain"), F.min("start").alias("start"), F.sum("edges").cast("int").alias("edges"))
