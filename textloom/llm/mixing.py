"""Mixing sources to target weights by Poisson replication.

Each document gets a number of copies from a Poisson distribution whose mean is
its source's repetition rate: the source's share of the wanted total over its
number of documents.  The draw inverts the distribution at a uniform number
made from a hash of seed, id and text, so a run that is repeated, or a task
that runs again, draws the same.  Copies are exploded and shuffled globally by
a hash of their own.

A rate is inverted on a table of its distribution around the mean, some twenty
standard deviations wide, made where it is needed and kept for the rates in
use.  Documents of sources with a rate over ``HEAVY`` are exploded in steps of
``CHUNK``, the first of which are dealt over all tasks, so neither a row nor a
task grows with the number of copies of a document.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .shared import Scratch, unused

#: Sources, and bytes of their names, up to which their rates are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SOURCES, BROADCAST_BYTES = 10_000, 16_000_000
#: Rate from which on copies are exploded in steps, and copies of a step.
HEAVY, CHUNK = 1000.0, 4096


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the md5 of the parts joined by '|'; null parts read ''."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


@lru_cache(maxsize=64)
def poisson_table(rate: float) -> tuple[int, np.ndarray, np.ndarray]:
    """(first, P(X <= k), P(X > k)) for k from first on, around the mean; what lies outside has less than 1e-18.

    Probabilities follow from that of the mode by ratios of neighbours and are
    scaled to a sum of 1, so large rates lose no precision; each tail is summed
    from its end.
    """
    width = 10 * np.sqrt(rate) + 60
    first, mode = max(0, int(rate - width)), int(rate)
    k = np.arange(first, int(rate + width) + 1, dtype=np.float64)
    steps = np.log(rate) - np.log(k[1:]) if rate < 1000 else -np.log1p((k[1:] - rate) / rate)
    log = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.exp(log - log[mode - first])
    p /= p.sum()
    return first, np.cumsum(p), np.append(np.cumsum(p[:0:-1])[::-1], 0.0)


def poisson_quantile(u: np.ndarray, rate: float) -> np.ndarray:
    """The least k with P(X <= k) > u; 0 for rates that are not positive."""
    if not rate > 0:
        return np.zeros(len(u), np.int64)
    first, below, above = poisson_table(float(rate))
    low = np.searchsorted(below, u, side="right")
    high = len(above) - np.searchsorted(above[::-1], 1 - u, side="left")
    return first + np.where(u < 0.5, low, high).clip(0, len(below) - 1)


@F.pandas_udf(LongType())
def _inverted(rate: pd.Series, u: pd.Series) -> pd.Series:
    rate, u = rate.to_numpy(np.float64), u.to_numpy(np.float64)
    out = np.zeros(len(u), np.int64)
    for r in np.unique(rate):
        out[rate == r] = poisson_quantile(u[rate == r], r)
    return pd.Series(out)


#: Called non-deterministic so that it is evaluated once for a row, not again in each filter on its result.
_copies = _inverted.asNondeterministic()


def rates(docs: DataFrame, targets: Mapping[str, float] | None, total: float | None, source_col: str) -> DataFrame:
    """(source, rate): wanted documents of a source over those it has.

    Without targets every source gets the same weight; sources that a given
    mapping does not name get none.  Null is a source of its own (named by
    None).  total: wanted number of documents, by default as many as there are.
    """
    sizes = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n"))
    if targets is None:
        weight = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for k, w in targets.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(w))).otherwise(weight)
    sizes = sizes.withColumn("weight", weight)
    # one row of sums
    sums = sizes.agg(F.sum("n").alias("all"), F.sum("weight").alias("weights")).first()
    wanted = float(total if total is not None else sums["all"] or 0)
    scale = wanted / sums["weights"] if sums["weights"] else 0.0
    return sizes.select("source", (F.col("weight") * scale / F.col("n")).alias("rate"))


def mix_sources(docs: DataFrame, targets: Mapping[str, float] | None = None, total: float | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rate_col: str = "mix_rate", copy_col: str = "mix_copy") -> DataFrame:
    """The input's columns with rows repeated or left out, in global random order, plus ``rate_col`` and ``copy_col`` (long, from 0).

    Repeated rows draw the same number, each for itself.  Null ids and texts
    read as '' in the hash.  No rows: none.  Columns of the input that are
    called as the two new ones give way to them; all others stay.
    """
    base = docs.drop(rate_col, copy_col)
    named, n, step, order = unused(base.withColumn(rate_col, F.lit(0)).withColumn(copy_col, F.lit(0)), "mix_source", "mix_n", "mix_step", "mix_order")
    s = Scratch(docs.sparkSession, "mixing")
    table = s.keep(rates(base, targets, total, source_col).select(F.col("source").alias(named), F.col("rate").alias(rate_col)), "rates")
    size = table.agg(F.count("*"), F.sum(F.octet_length(named)), F.max(rate_col)).first()
    if size[0] <= BROADCAST_SOURCES and (size[1] or 0) <= BROADCAST_BYTES:
        table = F.broadcast(table)
    u = uniform(F.lit(seed), F.col(id_col), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))

    def drawn(table: DataFrame) -> DataFrame:
        rows = base.join(table, F.col(source_col).cast("string").eqNullSafe(F.col(named)))
        return rows.withColumn(n, _copies(F.col(rate_col), u)).where(F.col(n) > 0)

    zero = F.lit(0).cast("long")
    rows = drawn(table.where(F.col(rate_col) <= HEAVY)).withColumn(copy_col, F.explode(F.sequence(zero, F.col(n) - 1)))
    if (size[2] or 0) > HEAVY:
        # few documents, as a source's rate goes down with their number
        heavy = drawn(table.where(F.col(rate_col) > HEAVY)).withColumn(step, zero)
        for size_ in (CHUNK * CHUNK, CHUNK):
            last = F.floor((F.col(n) - 1 - F.col(step)) / size_)
            last = F.least(last, F.lit(CHUNK - 1)) if size_ == CHUNK else last
            heavy = heavy.withColumn(step, F.explode(F.sequence(F.col(step), F.col(step) + last * size_, F.lit(size_).cast("long"))))
            heavy = heavy.repartition(F.xxhash64(id_col, step))
        last = F.least(F.lit(CHUNK).cast("long"), F.col(n) - F.col(step)) - 1
        heavy = heavy.withColumn(copy_col, F.explode(F.sequence(F.col(step), F.col(step) + last)))
        rows = rows.unionByName(heavy.drop(step))
    # the order is a hash, so dealing rows by it needs no sample of them
    hashed = F.xxhash64(F.lit(seed + 1), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col), F.col(copy_col))
    rows = rows.withColumn(order, hashed).repartition(order).sortWithinPartitions(order)
    return rows.select(*base.columns, rate_col, copy_col)
