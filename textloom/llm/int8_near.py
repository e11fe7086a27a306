"""Near-duplicate embeddings by int8 tile products with error bounds.

Vectors are scaled to length one and quantised to int8 with a step of their
own: ``u = s*q + e`` with ``|e| <= r`` measured for each vector.  The integer
product of two tiles then brackets every cosine rigorously::

    |<u, v> - s_u*s_v*<q_u, q_v>|  <=  r_u*|s_v q_v| + r_v*|s_u q_u| + r_u*r_v

Pairs whose bracket lies above the threshold link, pairs whose bracket lies
below do not, and only the others are computed again, in double precision from
the original components.  Integer products run as float32 matrix products, in
which sums of up to 2**24 are exact (dimensions are taken in slices that keep
them so).

Equal vectors of a label collapse first and carry their number.  Distinct ones
are dealt by hash over tiles of about ``TILE`` and quantised once, when a tile
is packed.  Each pair of tiles is a group of two rows of int8 codes, steps and
bounds, about an eighth of the vectors themselves.  It returns counts for each
vector and the links that connect components within the pair: at most one row
for each vector of the two tiles, never all pairs.  The vectors of pairs left
open are fetched in a second round, each once for its pair of tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, components, few, tidy

#: Distinct vectors of a tile, on average; pairs of tiles of a task, on average; rows of a tile multiplied at once.
TILE, TASK_PAIRS, _ROWS = 2048, 4, 256


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, step, bound of the error's length) of unit vectors."""
    step = np.maximum(np.abs(u).max(1), 1e-300) / 127
    q = np.rint(u / step[:, None])
    # the last term covers the rounding of these very sums
    r = np.sqrt(((u - q * step[:, None]) ** 2).sum(1)) * (1 + 1e-9) + 1e-12
    return q.astype(np.int8), step, r


def int_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows."""
    width = (1 << 24) // (127 * 127)
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], width):
        out += a[:, k : k + width].astype(np.float32) @ b[:, k : k + width].astype(np.float32).T
    return out


def bracketed(u: tuple, v: tuple, threshold: float, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, sure) for blocks of rows of two quantised tiles: pairs whose cosine may reach the threshold, and whether it surely does.

    Of one tile with itself, pairs with i < j.
    """
    (qu, su, ru), (qv, sv, rv) = u, v
    nu, nv = (np.sqrt((q.astype(np.float64) ** 2).sum(1)) * s * (1 + 1e-9) for q, s in ((qu, su), (qv, sv)))
    for lo in range(0, len(qu), _ROWS):
        part = slice(lo, lo + _ROWS)
        cos = int_products(qu[part], qv) * su[part, None] * sv[None, :]
        err = ru[part, None] * (nv + rv)[None, :] + nu[part, None] * rv[None, :] + 1e-9
        i, j = np.nonzero(cos + err >= threshold)
        if same:
            i, j = i[i + lo < j], j[i + lo < j]
        yield i + lo, j, cos[i, j] - err[i, j] >= threshold


def _norm(m: np.ndarray) -> np.ndarray:
    # scaled first, so that very large or small components neither overflow nor vanish
    big = np.abs(m).max(1, keepdims=True)
    m = m / big
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _vectors(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(-1, dim)


def near_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each input row.

    Vectors link when their labels and dimensions are equal, the label is not
    null and their cosine in double precision is at least ``threshold``.
    Vectors that are null, empty, zero or hold null or non-finite components
    have no links and their own id.  Rows with equal ids are separate vectors
    (each a link to the other if near); null ids stay null.
    """
    spark = vectors.sparkSession
    s = Scratch(spark, "int8")
    tile, limit = TILE, threshold

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, v = [], b["v"]
            parts, ends = v.values.to_numpy(zero_copy_only=False).astype("<f8"), v.offsets.to_numpy()  # null components become NaN
            there = np.array(v.is_valid()) & np.array(b["label"].is_valid())
            for k in range(b.num_rows):
                a = parts[ends[k] : ends[k + 1]] + 0.0  # -0.0 becomes 0.0
                out.append(a.tobytes() if there[k] and np.isfinite(a).all() and a.any() else None)
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], pa.array(out, pa.binary())], names=["vec_id", "label", "data"])

    # labels stand as their hash, whatever their length
    read = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.md5(F.col(label_col).cast("string").cast("binary")).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = s.keep(read.mapInArrow(tidy(clean), "vec_id long, label string, data binary").withColumn("dim", F.coalesce((F.length("data") / 8).cast("int"), F.lit(0))), "rows")
    # a vector stands for its equals; node is a hash of label and components
    node = F.xxhash64("label", "data")
    distinct = s.keep(rows.where("data is not null").groupBy("label", "dim", "data").agg(F.count("*").alias("copies")).withColumn("node", node), "distinct")

    sizes = s.keep(distinct.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")), "sizes")
    tasks = math.ceil((sizes.agg(F.sum(F.col("tiles").cast("double") * (F.col("tiles") + 1) / 2)).first()[0] or 1) / TASK_PAIRS)
    dealt = distinct.join(few(sizes), ["label", "dim"]).withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))

    def pack(key, table):
        q, step, bound = quantised(_norm(_vectors(b"".join(table["data"].to_pylist()), key[1].as_py())))
        cols = [table["node"].to_numpy().astype("<i8"), table["copies"].to_numpy().astype("<i8"), q, step, bound]
        return pa.table([[key[0].as_py()], pa.array([key[1].as_py()], pa.int32()), pa.array([key[2].as_py()], pa.int32()), table["tiles"][:1], *[pa.array([c.tobytes()], pa.binary()) for c in cols]], names=["label", "dim", "t", "tiles", *_TILE])

    packed = s.keep(dealt.groupBy("label", "dim", "t").applyInArrow(pack, "label string, dim int, t int, tiles int, " + ", ".join(f"{c} binary" for c in _TILE)), "tiles")
    # each tile once for each tile of its label, both of a pair under one key
    dealt = packed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("label", "dim", F.least("t", "o").alias("p"), F.greatest("t", "o").alias("q"), F.col("t").alias("tile"), *_TILE)

    def product(key, table):
        a, b = (table.slice(k) for k in (0, table.num_rows - 1))
        if a["tile"][0].as_py() > b["tile"][0].as_py():
            a, b = b, a
        (n1, c1, *u), (n2, c2, *v) = (_unpacked(x, key[1].as_py()) for x in (a, b))
        same = table.num_rows == 1 and key[2].as_py() == key[3].as_py()
        if table.num_rows == 1 and not same:
            return _rows([], [], [])  # the hash has dealt the other tile nothing
        shift = 0 if same else len(n1)
        nodes, counts, kept, open_ = (n1 if same else np.concatenate([n1, n2])), np.zeros(shift + len(n2)), np.empty((0, 2), np.int64), []
        for i, j, sure in bracketed(u, v, limit, same):
            x, y = i[sure], j[sure]
            counts += np.bincount(x, c2[y], len(counts)) + np.bincount(y + shift, c1[x], len(counts))
            kept = _forest(np.concatenate([kept[:, 0], x]), np.concatenate([kept[:, 1], y + shift]), len(nodes))
            open_.append(np.stack([i[~sure], j[~sure] + shift], 1))
        edges = np.concatenate(open_)
        near = np.unique(edges)
        partner = {k: [] for k in near.tolist()}
        for i, j in edges.tolist():
            partner[i].append(nodes[j])
        name = xxhash.xxh3_64_intdigest(repr([k.as_py() for k in key])) - (1 << 63)
        return _rows(nodes, counts, kept, [(name, nodes[k], p) for k, p in partner.items()])

    pairs = dealt.repartition(tasks, "label", "dim", "p", "q").groupBy("label", "dim", "p", "q")
    found = s.keep(pairs.applyInArrow(product, _FOUND), "found")

    def exact(key, table):
        dim, node = table["dim"][0].as_py(), table["node"].to_numpy()
        order = np.argsort(node, kind="stable")
        node, copies = node[order], table["copies"].to_numpy()[order]
        u = _norm(_vectors(b"".join(table["data"].to_pylist()), dim))[order]
        partners = [np.array(p or [], np.int64) for p in table["partners"].to_pylist()]
        i = np.repeat(np.searchsorted(node, table["node"].to_numpy()), [len(p) for p in partners])
        j = np.searchsorted(node, np.concatenate(partners))
        ok = np.concatenate([(u[x] * u[y]).sum(1) >= limit for x, y in zip(np.array_split(i, len(i) // 10_000 + 1), np.array_split(j, len(j) // 10_000 + 1), strict=True)])
        i, j = i[ok], j[ok]
        return _rows(node, np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node)), _forest(i, j, len(node)))

    again = found.where("pair is not null").select("pair", "node", "partners").join(distinct.select("node", "dim", "data", "copies"), "node")
    exacts = s.keep(again.groupBy("pair").applyInArrow(exact, _FOUND), "exact")
    found = found.where("pair is null").unionByName(exacts)
    links = found.where("other is not null and node <> other").select(F.col("node").alias("a"), F.col("other").alias("b"))
    label = few(s.keep(components(s, links), "label"))
    count = few(s.keep(found.groupBy("node").agg(F.sum("links").alias("links")), "links"))
    about = distinct.select("node", "copies").join(count, "node", "left").join(label, "node", "left")
    about = few(s.keep(about.select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("comp")), "about"))
    whole = s.keep(rows.select("vec_id", F.when(F.col("data").isNotNull(), node).alias("node")).join(about, "node", "left"), "whole")
    s.drop("rows", "tiles", "sizes", "found", "exact", "label", "links", "distinct", "about")
    least = few(s.keep(whole.where("comp is not null").groupBy("comp").agg(F.min("vec_id").alias("least")), "least"))
    out = whole.join(least, "comp", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: Columns of a packed tile.
_TILE = ("nodes", "copies", "codes", "steps", "bounds")
#: A count (links), an edge (other) or, of a pair of tiles, a vector that has pairs left open.
_FOUND = "node long, links long, other long, pair long, partners array<long>"


def _unpacked(row: pa.Table, dim: int) -> tuple[np.ndarray, ...]:
    nodes, copies, codes, steps, bounds = (np.frombuffer(row[c][0].as_buffer(), t) for c, t in zip(_TILE, ("<i8", "<i8", np.int8, "<f8", "<f8"), strict=True))
    return nodes, copies, codes.reshape(-1, dim), steps, bounds


def _rows(nodes, counts, edges, open_=()) -> pa.Table:
    """What a pair of tiles has found, as rows of ``_FOUND``."""
    some = np.flatnonzero(counts)
    rows = [(int(nodes[k]), int(counts[k]), None, None, None) for k in some]
    rows += [(int(nodes[x]), 0, int(nodes[y]), None, None) for x, y in edges]
    rows += [(int(n), None, None, name, p) for name, n, p in open_]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["node", "links", "other", "pair", "partners"])


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Edges (n-1 at most) that connect what the edges i, j connect."""
    label = np.arange(n)
    while True:  # hook to the least label around, then jump
        least = label.copy()
        np.minimum.at(least, i, label[j])
        np.minimum.at(least, j, label[i])
        least = least[least]
        if (least == label).all():
            break
        label = least
    x = np.flatnonzero(label != np.arange(n))
    return np.stack([x, label[x]], 1)
