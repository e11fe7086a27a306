"""Pieces that several operators of this subpackage use.

Scratch tables live under the folder named by ``spark.checkpoint.dir``, which
driver and executors share; a folder of our own is made only where that setting
is absent and Spark runs in one process (tests).  Lineage is cut by writing Parquet there and reading it
back, so a lost executor costs at most the step that was running.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a small side up to which it may be broadcast (16 bytes each at most
#: 16 MB); beyond it the same join is shuffled.
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="textloom-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """A folder of tables for one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._quietly_drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, batch: int = 2000) -> DataFrame:
        """Write a table and return it as read back; earlier shuffles are let go.

        ``batch``: rows of an Arrow batch meanwhile, for steps whose rows are large.
        """
        schema = df.schema
        with _batches(self.spark, batch):
            df.write.mode("overwrite").parquet(self.path(name))
        del df
        gc.collect()
        self.spark._jvm.System.gc()  # lets Spark's cleaner delete shuffle files of finished steps
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads; without names, all."""
        for path in [self.path(n) for n in names] or [self.root]:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def _quietly_drop(self) -> None:
        try:
            self.drop()
        except Exception:  # the session may be gone at exit
            pass


_lock, _held = threading.Lock(), {}


@contextlib.contextmanager
def _batches(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows; of steps that run at the same time the last one restores the setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    with _lock:
        now = spark.conf.get(key)
        held = _held.setdefault(id(spark), {"before": now, "steps": 0})
        held["steps"] += 1
        spark.conf.set(key, str(min(rows, int(now)) if int(now) > 0 else rows))
    try:
        yield
    finally:
        with _lock:
            held["steps"] -= 1
            if not held["steps"]:
                spark.conf.set(key, _held.pop(id(spark))["before"])


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added where ``df`` has such a column already, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def few(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are within ``rows`` (``BROADCAST_ROWS``).

    Only for narrow tables already written by ``Scratch.keep``: counting those
    reads Parquet footers alone.  Beyond the bound both sides of the join get a
    shuffle of their own, which adaptive execution can split where a key is
    hot; an aggregate on the join key that was not written first could not.
    """
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if rows is None else rows) else df


def tidy(run):
    """A mapInArrow function that gives freed memory back to the system when its task ends.

    Python workers are used again by later tasks, and their allocators would
    keep what the largest task so far has needed.
    """

    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


class WordHashes(dict):
    """64-bit hashes of words; emptied when full so that memory stays bounded."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


WORDS = WordHashes()

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S32, _S29 = np.uint64(32), np.uint64(29)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> _S32)) * _M2
    h = (h ^ (h >> _S29)) * _M1
    return h ^ (h >> _S32)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Order-aware 64-bit hashes of every run of n values (empty if fewer).

    Doubling keeps the work at about log2(n) passes: the hash of a run is made
    from the hashes of its two halves.
    """
    if len(h) < n:
        return np.empty(0, np.uint64)
    power, size, out, done = h, 1, None, 0
    left = n
    while left:
        if left & 1:
            m = len(h) - done - size + 1
            part = power[done : done + m]
            out = part if out is None else mix(out[:m] * _M1 + np.uint64(size)) + part
            done += size
        left >>= 1
        if left:
            power = mix(power[: len(power) - size] * _M2 + np.uint64(size)) ^ power[size:] * _M1
            size *= 2
    return mix(out[: len(h) - n + 1] + np.uint64(n))


def shingles(words: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles; of the whole sequence if shorter."""
    if not words:
        return np.empty(0, np.uint64)
    h = WORDS.of(words)
    return np.unique(windows(h, min(n, len(words))))


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h, np.uint64).view(np.int64)


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8, unchanged."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 8192) -> Iterator[pa.Table]:
    """Sorted batches again as tables in which no group of equal keys is cut.

    Memory is bounded by ``rows`` plus the largest group.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        start = group_starts(table, keys)[-1]
        if start:
            yield table.slice(0, start)
            # copied, so that the part that was given out can be freed
            held = table.slice(start).combine_chunks().to_batches()
            held = [pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in b.columns], schema=b.schema) for b in held]
            count = table.num_rows - start
    if held:
        yield pa.Table.from_batches(held)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each run of equal keys (integers without nulls) begins."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        v = table[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def components(scratch: Scratch, links: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) of every node with a link; component is the least node.

    ``links`` has integer columns a and b, without loops.  Alternates large-star
    and small-star steps until no link changes (Kiveris et al., 2014): each step
    is a grouped minimum with map-side combine and then a join with it: by
    broadcast where the links are few enough to bound it, else written first,
    so that adaptive execution can split the join (``few``) and a hub does not
    land in one task.
    """

    def beside(least: DataFrame, name: str) -> DataFrame:
        # a link has two nodes
        return F.broadcast(least) if 2 * size <= BROADCAST_ROWS else few(scratch.keep(least, name))

    now = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}0")
    mark, k, size = None, 0, now.count()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = beside(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), f"{name}{k}a")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.keep(large, f"{name}{k}l")
        least = beside(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}{k}b")
        star = large.join(least, "u")
        small = star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        then = scratch.keep(small, f"{name}{k + 1}")
        scratch.drop(*[f"{name}{k}{x}" for x in ("", "a", "l", "b")])
        found = then.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            break
        mark, now, k, size = tuple(found), then, k + 1, found[0]
    # stable: every link leads from a node to the least of its component
    return then.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(then.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def summed_blocks(parts: DataFrame, length: int, blocks: int) -> np.ndarray:
    """Element sums of partial float64 vectors given as rows (block int, data binary).

    Each task sends its partial vector in ``blocks`` pieces; pieces of the same
    number are added in one place and only the sum, of fixed ``length``, comes
    to the driver.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b["block"].to_pylist(), b["data"].to_pylist(), strict=True):
                v = np.frombuffer(data, np.float64)
                if k in sums:
                    sums[k] += v
                else:
                    sums[k] = v.copy()
        if sums:
            yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()), "data": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    out = np.zeros(length)
    step = -(-length // blocks)
    for r in parts.repartition("block").mapInArrow(tidy(add), "block int, data binary").collect():
        out[r["block"] * step : r["block"] * step + len(r["data"]) // 8] += np.frombuffer(bytes(r["data"]), np.float64)
    return out


def summed_rows(parts: DataFrame, rows: int, width: int) -> np.ndarray:
    """Sums of partial rows given as (k long, data binary of float32): an array of ``rows`` rows.

    For sums of which a task has few rows; only the sums, of fixed size, come
    to the driver.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b["k"].to_pylist(), b["data"].to_pylist(), strict=True):
                v = np.frombuffer(data, np.float32).astype(np.float64)
                if k in sums:
                    sums[k] += v
                else:
                    sums[k] = v
        if sums:
            yield pa.RecordBatch.from_pydict({"k": pa.array(list(sums), pa.int64()), "data": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    out = np.zeros((rows, width))
    got = parts.repartition("k").mapInArrow(tidy(add), "k long, data binary").toArrow()
    for k, data in zip(got["k"].to_pylist(), got["data"].to_pylist(), strict=True):
        out[k] = np.frombuffer(data, np.float64)
    return out


def blocks_of(vector: np.ndarray, blocks: int) -> pa.RecordBatch:
    """One partial vector as the rows that ``summed_blocks`` adds."""
    step = -(-len(vector) // blocks)
    pieces = [vector[i : i + step].astype(np.float64) for i in range(0, len(vector), step)]
    kept = [k for k, p in enumerate(pieces) if p.any()]
    return pa.RecordBatch.from_pydict({"block": pa.array(kept, pa.int32()), "data": pa.array([pieces[k].tobytes() for k in kept], pa.binary())})
