"""Sharding by a hierarchical weighted hash tree.

A row descends from the root over regions and racks to a shard.  At each node
every child draws from a hash of the row's key and the child's name, and the
child with the least ``-ln(u) / weight`` is taken (weighted rendezvous), where
an inner child's weight is the sum below it.  A draw depends on nothing but key
and name, so a change of weights moves rows only between the changed child and
its siblings; subtrees whose weights stay keep their rows' places inside.

Growth adds a shard in a region of its own: all other weights stay, so rows
move into the new shard alone.  ``even_tree`` grows the same way from its first
shards on, so the tree of a count and that of the next obey the law as well.

Law: ``key``.  Key and tree decide, and nothing else.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mixing import uniform
from .shared import Scratch, few

#: Rows numbered together, on average, when slots are given out.
BUCKET_ROWS = 20_000


@dataclass(frozen=True)
class Node:
    name: str
    weight: float = 1.0
    shard: int | None = None
    children: tuple[Node, ...] = field(default=())

    @property
    def total(self) -> float:
        return sum(c.total for c in self.children) if self.children else self.weight


def even_tree(shards: int, racks: int = 2, per_rack: int = 2, first: int = 8) -> Node:
    """Shards of weight 1: the ``first`` ones so many to a rack and racks to a region, each later one in a region of its own.

    Fewer shards than ``first`` are a first set of their own size.
    """
    start = min(shards, first)
    leaves = [Node(f"shard{k}", shard=k) for k in range(start)]
    racked = [Node(f"rack{k // per_rack}", children=tuple(leaves[k : k + per_rack])) for k in range(0, start, per_rack)]
    tree = Node("root", children=tuple(Node(f"region{k // racks}", children=tuple(racked[k : k + racks])) for k in range(0, len(racked), racks)))
    for k in range(start, shards):
        tree = grown(tree, k)
    return tree


def grown(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region of its own."""
    new = Node(f"region+{shard}", children=(Node(f"rack+{shard}", children=(Node(f"shard{shard}", weight, shard),)),))
    return Node(tree.name, children=(*tree.children, new))


def placed(tree: Node, key: Column, seed: int = 29) -> Column:
    """The shard of a key, as one expression."""
    if not tree.children:
        return F.lit(tree.shard)
    kids = [c for c in tree.children if c.total > 0]
    if len(kids) == 1:
        return placed(kids[0], key, seed)
    # u in (0, 1]: never the logarithm of 0
    draws = [-F.log(F.lit(1.0) - uniform(F.lit(seed), F.lit(c.name), key)) / F.lit(float(c.total)) for c in kids]
    least = F.least(*draws)
    out = placed(kids[-1], key, seed)
    for c, d in reversed(list(zip(kids[:-1], draws, strict=False))):
        out = F.when(d == least, placed(c, key, seed)).otherwise(out)
    return out


def shards(docs: DataFrame, tree: Node, more: Node | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = 29) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard), one row for each input row.

    size: UTF-8 bytes of the text (null: none) plus 1; text_crc32: unsigned, of
    those bytes.  slot: place of the row in its shard, gapless from 0, in order
    of a hash of the id, then id, checksum and size; rows of an id with more
    than ``BUCKET_ROWS`` of them follow the others of their bucket, dealt by
    hash over parts of about that size.  Rows with equal ids lie in one shard;
    null ids are an id of their own (the empty one).  No rows: none.
    """
    s = Scratch(docs.sparkSession, "shards")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key"))
    rows = rows.withColumn("order", uniform(F.lit(seed + 1), F.col("key")))
    rows = rows.withColumn("shard", placed(tree, F.col("key"), seed).cast("int")).withColumn("grown_shard", (placed(more, F.col("key"), seed) if more else F.lit(None)).cast("int"))
    rows = s.keep(rows.drop("key").withColumn("row", F.monotonically_increasing_id()), "rows")
    # buckets are ranges of the order, so slots follow it over all of them; their number follows that of rows
    buckets = max(1, math.ceil(rows.count() / BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.floor(F.col("order") * buckets).cast("int"))
    # an id of very many rows is no bucket's: its rows are dealt over parts of their own
    many = rows.groupBy("order").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET_ROWS)
    many = few(s.keep(many.select("order", F.col("order").alias("many"), F.ceil(F.col("n") / BUCKET_ROWS).alias("parts")), "many"))
    rows = rows.join(many, "order", "left").withColumn("many", F.coalesce("many", F.lit(-1.0))).withColumn("part", F.when(F.col("many") >= 0, F.pmod(F.xxhash64("row"), F.col("parts"))).otherwise(0).cast("int"))
    unit = ["shard", "bucket", "many", "part"]
    sizes = rows.groupBy(*unit).agg(F.count("*").alias("n"))
    base = sizes.withColumn("base", F.sum("n").over(Window.partitionBy("shard").orderBy(*unit[1:])) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy(*unit).orderBy("order", "doc_id", "text_crc32", "size", "row")) - 1
    out = rows.withColumn("rank", rank).join(base, unit)
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank")).cast("long").alias("slot"), "grown_shard")
