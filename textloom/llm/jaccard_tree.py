"""N-gram Jaccard join by signature trees.

Two texts link when ``100 * |A n B| >= percent * |A u B|`` for their sets of
word n-grams (A-Z lower-cased, words split at ASCII white space; a text with
fewer words has its whole sequence as one n-gram).

1. Equal sets collapse into one *node* before anything is compared.
2. Every node is filed by size class, its own and the one below in which a
   smaller partner can be.  For a class, the space of hashes is cut into more
   parts than linked sets can differ in elements, so they agree in whole parts;
   a node is filed once under the elements of each part.  What can link shares
   a file; most files hold one node and go.  Common n-grams do not make large
   files, as the other elements of a part tell its texts apart; large groups of
   near copies do.  A file with ``SAMPLE_LARGE`` members among about ``SAMPLE``
   nodes is dealt over many tasks instead of being counted in one: which files
   that is decides where rows go, not which of them are compared.
3. Each file becomes a signature tree: leaves of nodes sorted by size, inner
   nodes with OR-combined bitmaps and size ranges.  A dual traversal drops
   pairs of tree nodes whose sizes cannot link or whose maximum possible
   overlap is too small; the same bound is then taken for pairs of leaves'
   members.
4. Surviving pairs are decided exactly on the sets.  A first round, over blocks
   of at most ``BLOCK`` members, takes one surviving partner per member.  After
   that the nodes have components, and the second round takes every surviving
   pair between different components, over pairs of blocks.  A pair inside one
   component cannot change the result, so groups of near copies are not
   expanded into all pairs, and no link between components is lost.

Sets are compared by 64-bit hashes of n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, components, few, group_starts, mix, shingles, signed, tidy, unused, whole_groups

#: Most members of a file that one task compares with each other.
BLOCK = 1024
#: Members of a leaf of a tree, and children of an inner node.
LEAF, FANOUT = 32, 8
#: Nodes, on average, in a sample that finds large files, and members in it from which on a file is one.
SAMPLE, SAMPLE_LARGE = 20_000, 16
#: A size class spans this many steps of the size ratio that links allow.
STEPS = 2


def bits_for(n: int) -> int:
    """Bitmap length, a power of two: at least 8 bits for each n-gram up to 512, else 4."""
    want = max(512, 8 * n if n <= 512 else max(4096, 4 * n))
    return 1 << (want - 1).bit_length()


def bitmap(hashes: np.ndarray) -> bytes:
    m = bits_for(len(hashes))
    flags = np.zeros(m, np.uint8)
    flags[(hashes >> np.uint64(17)) & np.uint64(m - 1)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def folded(data: bytes, words: int) -> np.ndarray:
    """A bitmap OR-folded to so many 64-bit words (positions are taken modulo a power of two)."""
    v = np.frombuffer(data, np.uint64)
    while len(v) > words:
        v = v[: len(v) // 2] | v[len(v) // 2 :]
    return v


def least_overlap(a, b, percent: int):
    """Smallest intersection with which sets of sizes a and b link."""
    return -(-percent * (a + b) // (100 + percent))


def size_class(n: int, percent: int) -> int:
    return int(np.log(n) / (STEPS * np.log(100 / percent)) + 1e-12)


@cache
def parts_of(c: int, percent: int) -> tuple[int, int]:
    """(parts, empty parts that need no file) of a size class.

    A member a of the class and its partner b differ in at most
    ``(100 - percent) / (100 + percent) * (a + b)`` elements.  With that and
    ``spare`` more parts than this they agree in over ``spare`` parts, hence in
    one that is not empty if either has at most ``spare`` empty ones.
    """
    step = STEPS * np.log(100 / percent)
    least, most = max(1, int(np.exp(c * step)) - 2), int(np.exp((c + 1) * step)) + 2
    differ = (100 - percent) * (most + 100 * most // percent) // (100 + percent)
    empty = (differ + 1) * np.exp(-least / (differ + 1))
    spare = int(np.ceil(empty + 4 * np.sqrt(empty) + 1))
    return differ + 1 + spare, spare


def files(h: np.ndarray, c: int, percent: int) -> np.ndarray:
    """Names of the files of a set in a size class."""
    parts, spare = parts_of(c, percent)
    part = ((h >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    at, first = np.unique(part[order], return_index=True)
    sums = np.add.reduceat(mix(h[order]), first)
    if parts - len(at) > spare:
        sums, at = np.append(sums, np.zeros(parts - len(at), np.uint64)), np.append(at, np.setdiff1d(np.arange(parts), at))
    return mix(sums + mix(at.astype(np.uint64) + np.uint64(c << 40)))


def sketches(docs: DataFrame, id_col: str, text_col: str, n_words: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, n, node, filed, bitmap); node is a hash of the set, null if empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, node, filed, maps = [], [], [], []
            for text in b["text"]:
                h = shingles(_lower_words(text.as_py()), n_words)
                n.append(len(h))
                if not len(h):
                    node.append(None), filed.append(None), maps.append(None)
                    continue
                # of the sorted set as a whole: equal sets alone have equal bytes
                node.append(_set_hash(h))
                own = size_class(len(h), percent)
                below = size_class(-(-percent * len(h) // 100), percent)
                filed.append([{"c": c, "home": c == own, "sigs": signed(files(h, c, percent))} for c in sorted({own, below})])
                maps.append(bitmap(h))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["text_hash"], pa.array(n, pa.int32()), pa.array(node, pa.int64()), pa.array(filed, _FILED), pa.array(maps, pa.binary())],
                names=["doc_id", "text_hash", "n", "node", "filed", "bitmap"],
            )

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(tidy(run), "doc_id long, text_hash long, n int, node long, filed array<struct<c:int,home:boolean,sigs:array<bigint>>>, bitmap binary")


_FILED = pa.list_(pa.struct([("c", pa.int32()), ("home", pa.bool_()), ("sigs", pa.list_(pa.int64()))]))


def _lower_words(text: str | None) -> list[bytes]:
    # bytes.lower changes A-Z alone, bytes.split cuts at ASCII white space alone
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _set_hash(h: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)


class Members:
    """Members of files of one size class, sorted by file and size, with bitmaps of one length."""

    def __init__(self, table: pa.Table, percent: int):
        self.percent = percent
        self.node = table["node"].to_numpy()
        self.n = table["n"].to_numpy().astype(np.int64)
        self.home = table["home"].to_numpy()
        data = table["bitmap"].to_pylist()
        self.words = min(map(len, data)) // 8
        self.maps = np.stack([folded(d, self.words) for d in data])
        self.slack = self.n - np.bitwise_count(self.maps).sum(1, dtype=np.int64)

    def possible(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Positions of the pairs that can link: one is at home here, sizes fit, and so does the possible overlap."""
        a, b = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        ok = np.flatnonzero((100 * a >= self.percent * b) & (self.home[i] | self.home[j]))
        kept = []
        for part in np.array_split(ok, max(1, len(ok) * self.words // 1_000_000)):
            x, y = i[part], j[part]
            most = np.minimum(self.slack[x], self.slack[y]) + np.bitwise_count(self.maps[x] & self.maps[y]).sum(1, dtype=np.int64)
            kept.append(part[most >= least_overlap(self.n[x], self.n[y], self.percent)])
        return np.concatenate(kept)


class Tree:
    """Signature tree over the members lo..hi (sorted by size) of one file."""

    def __init__(self, m: Members, lo: int, hi: int):
        self.m, self.levels = m, []
        starts = np.arange(lo, hi, LEAF)
        ends = np.minimum(starts + LEAF, hi)
        level = {
            "from": starts, "to": ends, "least": m.n[starts], "most": m.n[ends - 1],
            "maps": np.bitwise_or.reduceat(m.maps[lo:hi], starts - lo, axis=0), "slack": np.maximum.reduceat(m.slack[lo:hi], starts - lo),
        }
        self.levels.append(level)
        while len(level["from"]) > 1:
            s = np.arange(0, len(level["from"]), FANOUT)
            e = np.minimum(s + FANOUT, len(level["from"]))
            level = {
                "from": s, "to": e, "least": np.minimum.reduceat(level["least"], s), "most": np.maximum.reduceat(level["most"], s),
                "maps": np.bitwise_or.reduceat(level["maps"], s, axis=0), "slack": np.maximum.reduceat(level["slack"], s),
            }
            self.levels.append(level)

    def leaf_pairs(self, other: Tree | None = None) -> Iterator[tuple[int, int, int, int]]:
        """Bounds (from, to, from, to) of the pairs of leaves that the dual traversal leaves over."""
        same, p = other is None, self.m.percent
        o = self if same else other
        a, b = len(self.levels) - 1, len(o.levels) - 1
        x, y = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while True:
            la, lb = self.levels[a], o.levels[b]
            ok = (100 * la["most"][x] >= p * lb["least"][y]) & (100 * lb["most"][y] >= p * la["least"][x])
            x, y = x[ok], y[ok]
            most = np.minimum(la["slack"][x], lb["slack"][y]) + np.bitwise_count(la["maps"][x] & lb["maps"][y]).sum(1, dtype=np.int64)
            ok = most >= least_overlap(la["least"][x], lb["least"][y], p)
            x, y = x[ok], y[ok]
            if a == b == 0:
                for i, j in zip(x, y, strict=True):
                    yield la["from"][i], la["to"][i], lb["from"][j], lb["to"][j]
                return
            if a and (a >= b or same):
                x, y = _children(la, x, y)
                a -= 1
            if b and (same or a < b):
                y, x = _children(lb, y, x)
                b -= 1
            if same:
                keep = x <= y
                x, y = x[keep], y[keep]


def _children(level: dict, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = level["to"][x] - level["from"][x]
    first = np.repeat(level["from"][x] - np.cumsum(size) + size, size)
    return first + np.arange(size.sum()), np.repeat(y, size)


def surviving(m: Members, starts: np.ndarray, sides: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of indices that no bound rules out.  Small files go together, large ones through a tree.

    ``sides`` 0/1, within a file first all 0 then all 1: only pairs across are taken.
    """
    ends = np.append(starts[1:], len(m.n))
    size = ends - starts
    small = np.flatnonzero(size <= LEAF)
    file = np.repeat(np.arange(len(starts)), size)
    in_small = np.repeat(size <= LEAF, size)
    for lag in range(1, int(size[small].max(initial=1))):
        i = np.flatnonzero(in_small[:-lag] & (file[lag:] == file[:-lag]))
        if sides is not None:
            i = i[sides[i] != sides[i + lag]]
        if len(i):
            ok = m.possible(i, i + lag)
            yield i[ok], i[ok] + lag
    for f in np.flatnonzero(size > LEAF):
        lo, hi = starts[f], ends[f]
        cut = hi if sides is None else lo + int((sides[lo:hi] == 0).sum())
        if sides is not None and not lo < cut < hi:
            continue
        left = Tree(m, lo, cut)
        for a, b, c, d in left.leaf_pairs() if sides is None else left.leaf_pairs(Tree(m, cut, hi)):
            i, j = np.repeat(np.arange(a, b), d - c), np.tile(np.arange(c, d), b - a)
            if a == c:
                i, j = i[i < j], j[i < j]
            ok = m.possible(i, j)
            if len(ok):
                yield i[ok], j[ok]


_PAIRS = "a long, b long"


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _by_class(table: pa.Table, keys: list[str], percent: int):
    """(rows, Members, starts of files) for each size class in a sorted table."""
    cls = table["c"].to_numpy()
    edges = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1], True])
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        part = table.slice(lo, hi - lo)
        yield part, Members(part, percent), group_starts(part, keys)


def _first_partners(percent: int):
    keys = ["c", "sig", "block"]

    def run(batches):
        for table in whole_groups(batches, keys):
            for _, m, starts in _by_class(table, keys, percent):
                first = np.full(len(m.n), np.iinfo(np.int64).max)
                for i, j in surviving(m, starts):
                    np.minimum.at(first, j, i)
                j = np.flatnonzero(first < np.iinfo(np.int64).max)
                if len(j):
                    pairs = np.unique(np.sort(np.stack([m.node[first[j]], m.node[j]], 1), axis=1), axis=0)
                    yield _pairs(pairs[:, 0], pairs[:, 1])

    return run


def _across(percent: int):
    keys = ["c", "sig", "bi", "bj"]

    def run(batches):
        for table in whole_groups(batches, keys):
            for part, m, starts in _by_class(table, keys, percent):
                comp, bi, bj = (part[x].to_numpy() for x in ("comp", "bi", "bj"))
                side = part["side"].to_numpy()
                for within in (True, False):
                    rows = np.flatnonzero((bi == bj) == within)
                    if not len(rows):
                        continue
                    sub = part.take(pa.array(rows))
                    mm = Members(sub, percent)
                    for i, j in surviving(mm, group_starts(sub, keys), None if within else side[rows]):
                        ok = comp[rows[i]] != comp[rows[j]]
                        if ok.any():
                            yield _pairs(mm.node[i[ok]], mm.node[j[ok]])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each input row.

    component_id: the smallest id reachable by links, itself included.  A null
    or empty text has n_shingles 0 and its own id.  Rows with equal sets link,
    whatever their ids; a null id stays null unless its component has another
    one.  Repeated ids are separate rows.  Other columns are ignored.
    """
    s = Scratch(docs.sparkSession, "jaccard")
    whole = _labelled(s, docs, id_col, text_col, n_words, percent)
    least = few(s.keep(whole.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least")), "least"))
    return whole.join(least, "comp", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def _labelled(s: Scratch, docs: DataFrame, id_col: str, text_col: str, n_words: int, percent: int) -> DataFrame:
    """(comp, doc_id, text_hash, n), one row for each input row; comp is null where the set is empty."""
    sketch = s.keep(sketches(docs, id_col, text_col, n_words, percent).withColumn("row", F.monotonically_increasing_id()), "sketch")

    # one row of each node
    rows = s.keep(sketch.where("node is not null").groupBy("node").agg(F.min("row").alias("row")).select("row"), "rows")
    one = sketch.join(few(rows), "row", "left_semi")
    share = min(1.0, SAMPLE / max(1, rows.count()))

    def members(nodes: DataFrame) -> DataFrame:
        return nodes.select("node", "n", F.explode("filed").alias("f")).select("node", "n", "f.c", "f.home", F.explode("f.sigs").alias("sig"))

    # a file may hold a third of all nodes: files that a sample shows to be large stay without being counted, and are dealt over many tasks
    some = members(one.where(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < int(share * 1_000_000)))
    large = few(s.keep(some.groupBy("sig").count().where(F.col("count") >= SAMPLE_LARGE).select("sig", F.lit(True).alias("large")), "large"))
    filed = members(one).join(large, "sig", "left").withColumn("deal", F.when(F.col("large"), F.xxhash64("node")).otherwise(0)).drop("large")
    file = Window.partitionBy("c", "sig", "deal")
    filed = filed.withColumn("cnt", F.count("*").over(file)).withColumn("homes", F.count_if("home").over(file))
    filed = s.keep(filed.where("deal <> 0 or (cnt > 1 and homes > 0)").drop("cnt", "homes", "deal"), "filed")
    # files with the same members say the same: one of them stays
    same = filed.groupBy("c", "sig").agg(F.count("*").alias("cnt"), F.sum(F.xxhash64("node", "home").cast("decimal(38,0)")).alias("h"))
    same = same.groupBy("c", "cnt", "h").agg(F.min("sig").alias("sig")).select("c", "sig", "cnt")
    filed = s.keep(filed.join(few(s.keep(same, "same")), ["c", "sig"]), "files")
    s.drop("filed", "large", "same")

    used = few(s.keep(filed.select("node").distinct(), "used"))
    maps = s.keep(one.select("node", "bitmap").join(used, "node", "left_semi"), "maps")

    blocks = F.ceil(F.col("cnt") / BLOCK)
    first = filed.withColumn("block", F.pmod(F.xxhash64("node", "sig"), blocks).cast("int")).join(maps, "node")
    first = first.repartition("c", "sig", "block").sortWithinPartitions("c", "sig", "block", "n", "node")
    tried = s.keep(first.select("c", "sig", "block", "n", "node", "home", "bitmap").mapInArrow(tidy(_first_partners(percent)), _PAIRS).distinct(), "tried")
    links = s.keep(_decided(s, docs, one, text_col, tried, n_words, percent, "first"), "links1")

    if filed.limit(1).count():
        label = few(s.keep(components(s, links), "label"))
        now = filed.join(label, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        several = now.groupBy("c", "sig").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.max("cnt").alias("cnt")).where("x <> y")
        several = few(s.keep(several.select("c", "sig", "cnt"), "several"))
        sizes = now.join(several.where(F.col("cnt") > BLOCK).select("c", "sig"), ["c", "sig"]).groupBy("c", "sig", "comp").count()
        main = few(s.keep(sizes.groupBy("c", "sig").agg(F.max_by("comp", "count").alias("main"), F.max("count").alias("mains")), "main"))
        now = s.keep(now.join(several.select("c", "sig"), ["c", "sig"]).join(main, ["c", "sig"], "left"), "now")
        # members of a large file's largest component need no pairs among themselves
        is_main = F.coalesce(F.col("comp") == F.col("main"), F.lit(False))
        k_rest = F.ceil((F.col("cnt") - F.coalesce("mains", F.lit(0))) / BLOCK).cast("int")
        k_main = F.ceil(F.coalesce("mains", F.lit(0)) / BLOCK).cast("int")
        h = F.xxhash64("node", "sig")
        now = now.withColumn("main_row", is_main).withColumn("kr", k_rest).withColumn("km", k_main)
        now = now.withColumn("b", F.when(F.col("main_row"), F.col("kr") + F.pmod(h, F.col("km"))).otherwise(F.pmod(h, F.col("kr"))).cast("int"))
        others = F.when(F.col("main_row"), F.sequence(F.lit(0), F.col("kr") - 1)).otherwise(F.sequence(F.lit(0), F.col("kr") + F.col("km") - 1))
        now = now.withColumn("o", F.explode(others))
        now = now.select("c", "sig", F.least("b", "o").cast("int").alias("bi"), F.greatest("b", "o").cast("int").alias("bj"), (F.col("b") > F.col("o")).cast("int").alias("side"), "n", "node", "home", "comp")
        now = now.join(maps, "node").repartition("c", "sig", "bi", "bj").sortWithinPartitions("c", "sig", "bi", "bj", "side", "n", "node")
        more = now.select("c", "sig", "bi", "bj", "side", "n", "node", "home", "comp", "bitmap").mapInArrow(tidy(_across(percent)), _PAIRS).distinct()
        more = s.keep(more.join(tried, ["a", "b"], "left_anti"), "more")
        links2 = s.keep(_decided(s, docs, one, text_col, more, n_words, percent, "second"), "links2")
        links = links.unionByName(links2)
    label = few(s.keep(components(s, links), "labels"))
    s.drop("files", "maps", "used", "tried", "now", "more", "label", "links1", "links2", "several", "main")
    whole = sketch.select("doc_id", "text_hash", "n", "node").join(label, "node", "left").select(F.coalesce("component", "node").alias("comp"), "doc_id", "text_hash", "n")
    whole = s.keep(whole, "whole")
    s.drop("sketch", "rows", "labels")
    return whole


def _decided(s: Scratch, docs: DataFrame, one: DataFrame, text_col: str, pairs: DataFrame, n_words: int, percent: int, name: str) -> DataFrame:
    """Those of the pairs of nodes that link, decided on the whole sets, made again from the texts of ``one`` row of each node."""
    wanted = few(s.keep(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), f"{name}_wanted"))
    texts = few(s.keep(one.select("node", "text_hash").join(wanted, "node", "left_semi"), f"{name}_texts"))

    def sets(batches):
        for b in batches:
            out = [shingles(_lower_words(t), n_words).tobytes() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["node"], pa.array(out, pa.binary())], names=["node", "h"])

    found = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text")).join(texts, "text_hash").dropDuplicates(["node"])
    sets_ = s.keep(found.select("node", "text").mapInArrow(tidy(sets), "node long, h binary"), f"{name}_sets")

    def decide(batches):
        for b in batches:
            ok = []
            for x, y in zip(b["x"], b["y"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y)
                shared = both - len(np.unique(np.concatenate([x, y])))
                ok.append(100 * shared >= percent * (both - shared))
            yield pa.RecordBatch.from_arrays([b["a"], b["b"]], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sets_.select(F.col("node").alias("a"), F.col("h").alias("x")), "a").join(sets_.select(F.col("node").alias("b"), F.col("h").alias("y")), "b")
    out = s.keep(both.select("a", "b", "x", "y").mapInArrow(tidy(decide), _PAIRS), f"{name}_links", batch=500)
    s.drop(f"{name}_wanted", f"{name}_texts", f"{name}_sets")
    return out


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, one of each group: that of the smallest id, null being the largest.

    Rows are told apart by id and hash of the text; of several with the same of
    both one stays.  Rows without words belong to no group and stay.  No column
    of the input is changed, whatever its name.
    """
    s = Scratch(docs.sparkSession, "jaccard-kept")
    key = unused(docs, "__id", "__text")
    id_, text_ = key
    whole = _labelled(s, docs, id_col, text_col, n_words, percent).where("comp is not null")
    rows = s.keep(whole.groupBy("comp", F.col("doc_id").alias(id_), F.col("text_hash").alias(text_)).count(), "told")
    first = rows.groupBy("comp").agg(F.min(F.struct(F.col(id_).isNull().alias("none"), *key)).alias("first"))
    first = few(s.keep(first.select(f"first.{id_}", f"first.{text_}"), "first"))

    def same(a: DataFrame, b: DataFrame) -> Column:
        return a[id_].eqNullSafe(b[id_]) & (a[text_] == b[text_])

    gone = few(s.keep(rows.join(first, same(rows, first), "left_anti").select(*key), "gone"))
    several = rows.where("count > 1")
    again = s.keep(several.join(first, same(several, first), "left_semi").select(*key), "again")
    s.drop("told", "first", "whole")
    named = docs.withColumn(id_, F.col(id_col).cast("long")).withColumn(text_, F.xxhash64(text_col))
    kept = named.join(gone, same(named, gone), "left_anti")
    if again.count():
        again = few(again)
        one = named.join(again, same(named, again), "left_semi").dropDuplicates(key)
        kept = kept.join(again, same(kept, again), "left_anti").unionByName(one)
    return kept.drop(*key)
