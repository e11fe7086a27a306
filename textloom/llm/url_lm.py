"""URL filter: domain rules, then a character language-model ratio.

Rules decide the URLs they fit.  The URLs they allow and block are the accepted
and rejected examples of two smoothed variable-order Markov models over
characters: a context of up to ``ORDER`` characters is used as far as it has
been seen, each order falling back on the next shorter one.  What no rule fits
is allowed if the length-normalised difference of the log-likelihoods reaches a
threshold calibrated on a held-out fifth of the examples (largest balanced
accuracy).  The models see host and path, without what follows ``?`` or ``#``
(a URL without a host is taken whole); the README has figures for both.

All that the models say of a character follows from it and the ``ORDER`` before
it.  Such a run fits an integer, so counts are exact: a table of the runs of the
input, which grows with it, is made by a grouped sum, shorter contexts are sums
over it, and the logarithms are joined level by level.  Frequent runs, at most
``BROADCAST_ROWS``, go to every task; the others are joined to the URLs by a
shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, Scratch, mix, tidy, windows

ORDER, BITS = 5, 17
PRIOR = 1.0
HELD_OUT = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @classmethod
    def parse(cls, text: str, verdict: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(host.lower(), slash + path, verdict)

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; null or none: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits: its host or a subdomain, and its path as a prefix."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def _slots(texts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Characters (bytes and an end mark) of texts one after another: the text of
    each, and for each order the slots of context and of context plus character."""
    pad = b"\x01" * ORDER
    data = np.frombuffer(b"".join(pad + t.encode("utf-8", "surrogatepass") + b"\x02" for t in texts), np.uint8).astype(np.uint64)
    sizes = np.array([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(sizes.sum()) + ORDER * (owner + 1)
    h, shift, out = mix(data + np.uint64(1)), np.uint64(64 - BITS), []
    for k in range(ORDER + 1):
        both = (windows(h, k + 1)[at - k] >> shift).astype(np.int64)
        context = (windows(h, k)[at - k] >> shift).astype(np.int64) if k else np.zeros(len(at), np.int64)
        out.append((context, both))
    return owner, out, sizes


def _text(batch: pa.RecordBatch) -> list[str]:
    # runs of digits say nothing; a URL without a host is taken whole
    return [re.sub("[0-9]+", "0", (h + p) if h else (u or "")) for u, h, p in zip(batch["url"].to_pylist(), batch["host"].to_pylist(), batch["path"].to_pylist(), strict=True)]


@dataclass
class Models:
    """Counts of contexts and of context plus character: [class, context or both, order, slot].

    The same models in hashed slots in memory, for a few texts; ``filter_urls`` does not use them.
    """

    counts: np.ndarray
    threshold: float

    def ratios(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood of accepted minus rejected URLs, for each character."""
        if not texts:
            return np.empty(0)
        owner, slots, sizes = _slots(texts)
        logs = []
        for side in self.counts:
            p = np.full(len(owner), 1 / 256)
            for k, (context, both) in enumerate(slots):
                p = (side[1, k][both] + PRIOR * p) / (side[0, k][context] + PRIOR)
            logs.append(np.log(np.minimum(p, 1.0)))
        return np.bincount(owner, logs[0] - logs[1], len(texts)) / sizes


def _runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each character with the ``ORDER`` before it as one number (the last in the
    lowest byte), the text it is of, and the sizes of texts; marks as in ``_slots``."""
    coded = [t.encode("utf-8", "surrogatepass") + b"\x02" for t in texts]
    pad = b"\x01" * ORDER
    data = np.frombuffer(b"".join(pad + t for t in coded), np.uint8).astype(np.int64)
    sizes = np.array([len(t) for t in coded])
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(sizes.sum()) + ORDER * (owner + 1)
    runs = np.zeros(len(at), np.int64)
    for j in range(ORDER + 1):
        runs |= data[at - j] << (8 * j)
    return runs, owner, sizes


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of each batch: how often in all, in accepted and in rejected examples."""
    for b in batches:
        texts, side = _text(b), b["side"].to_numpy()
        if not texts:
            continue
        runs, owner, _ = _runs(texts)
        found, place = np.unique(runs, return_inverse=True)
        sums = [np.bincount(place[pick], minlength=len(found)) for pick in (slice(None), side[owner] == 0, side[owner] == 1)]
        yield pa.RecordBatch.from_arrays([pa.array(found), *map(pa.array, sums)], names=["run", "n", "good", "bad"])


def _ratios(s: Scratch, runs: DataFrame) -> DataFrame:
    """(run, n, ratio): log-likelihood of accepted minus rejected for the last character of each run.

    A level's row meets one row for its context and one for its shorter form,
    and each of those at most 256 rows, so no key is hot.
    """
    sums = [F.sum(c).alias(c) for c in ("good", "bad")]
    levels = {ORDER: runs}
    for k in range(ORDER - 1, -1, -1):
        shorter = levels[k + 1].groupBy(F.col("run").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("run")).agg(*sums)
        levels[k] = s.keep(shorter, f"level{k}")
    p = None
    for k in range(ORDER + 1):
        context = levels[k].groupBy(F.shiftright("run", 8).alias("context")).agg(F.sum("good").alias("of_good"), F.sum("bad").alias("of_bad"))
        now = levels[k].withColumn("context", F.shiftright("run", 8)).join(context, "context")
        if p is None:
            now = now.withColumn("p_good", F.lit(1 / 256)).withColumn("p_bad", F.lit(1 / 256))
        else:
            now = now.withColumn("short", F.col("run").bitwiseAND(F.lit((1 << 8 * k) - 1))).join(p, "short")
        better = [((F.col(c) + PRIOR * F.col(f"p_{c}")) / (F.col(f"of_{c}") + PRIOR)).alias(f"p_{c}") for c in ("good", "bad")]
        p = now.select(F.col("run").alias("short"), *(["n"] if k == ORDER else []), *better)
    out = s.keep(p.select(F.col("short").alias("run"), "n", (F.log("p_good") - F.log("p_bad")).alias("ratio")), "ratios")
    s.drop(*[f"level{k}" for k in range(ORDER)])
    return out


def _least_count(ratios: DataFrame) -> int:
    """The least count of a frequent run: a power of two, or 0 if all runs may go to every task."""
    if ratios.count() <= BROADCAST_ROWS:
        return 0
    total, least = 0, 1 << 62
    # counts of runs by the power of two below them: at most 63 rows
    for r in sorted(ratios.groupBy(F.floor(F.log2("n") + 1e-9).cast("int").alias("power")).count().collect(), reverse=True):
        total += r["count"]
        if total > BROADCAST_ROWS:
            break
        least = 1 << r["power"]
    return least


def _scored(s: Scratch, rows: DataFrame, ratios: DataFrame) -> DataFrame:
    """``rows`` with their score: the mean of the ratios of their characters."""
    least = _least_count(ratios)
    frequent = ratios.where(F.col("n") >= least).select("run", "ratio").toArrow()  # at most BROADCAST_ROWS rows
    order = np.argsort(frequent["run"].to_numpy())
    shared = rows.sparkSession.sparkContext.broadcast((frequent["run"].to_numpy()[order], frequent["ratio"].to_numpy()[order]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, value = shared.value
        for b in batches:
            texts = _text(b)
            if not texts:
                continue
            runs, owner, sizes = _runs(texts)
            at = np.minimum(np.searchsorted(known, runs), max(0, len(known) - 1))
            there = known[at] == runs if len(known) else np.zeros(len(runs), bool)
            part = np.bincount(owner[there], value[at[there]], len(texts)) if there.any() else np.zeros(len(texts))
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner[~there], minlength=len(texts)))])
            rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(runs[~there]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part), pa.array(sizes), rest], names=[*b.schema.names, "part", "size", "rest"])

    kept = [f.name for f in rows.schema.fields]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    rated = rows.mapInArrow(tidy(score), f"{schema}, part double, size long, rest array<bigint>")
    if least:
        rated = s.keep(rated, "parts")
        # rare runs alone, so that no key is hot
        rare = rated.select("key", F.explode("rest").alias("run")).join(ratios.where(F.col("n") < least).select("run", "ratio"), "run")
        rated = rated.join(rare.groupBy("key").agg(F.sum("ratio").alias("more")), "key", "left")
    else:
        rated = rated.withColumn("more", F.lit(0.0))
    return rated.select(*kept, ((F.col("part") + F.coalesce("more", F.lit(0.0))) / F.col("size")).alias("score"))


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score), one row for each input row.

    A rule's verdict holds where one fits, else the models' (score is theirs for
    every URL).  A null or empty URL has score 0 but for its end mark.  Where the rules
    accept or reject no URL at all there is nothing to learn and the undecided
    are allowed.  Repeated rows are counted as often as they occur; other
    columns are ignored.
    """
    spark = pages.sparkSession
    s = Scratch(spark, "urls")
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("verdict", verdict)
    held_out = F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0
    side = F.when(held_out | F.col("verdict").isNull(), -1).when(F.col("verdict") == "allow", 0).otherwise(1)
    rows = s.keep(rows.withColumn("side", side.cast("int")).withColumn("key", F.monotonically_increasing_id()), "rows")

    runs = rows.select("url", "host", "path", "side").mapInArrow(tidy(_counted), "run long, n long, good long, bad long")
    runs = s.keep(runs.groupBy("run").agg(*[F.sum(c).alias(c) for c in ("n", "good", "bad")]), "runs")
    seen = runs.agg(F.sum("good"), F.sum("bad")).first()
    rated = s.keep(_scored(s, rows, _ratios(s, runs)), "rated")
    s.drop("rows", "runs", "ratios", "parts")
    threshold = -float("inf")
    if seen[0] and seen[1]:
        bins = rated.where("verdict is not null").where(held_out).groupBy(F.floor(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), "score")) * 100).alias("bin"), "verdict").count().collect()
        threshold = calibrated([(r["bin"] / 100, r["verdict"] == "allow", r["count"]) for r in bins])
    judged = F.coalesce("verdict", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return rated.select("page_id", "host", "path", "rule", judged.alias("verdict"), "score")


def calibrated(bins: list[tuple[float, bool, int]]) -> float:
    """The threshold of the largest balanced accuracy, from (lower edge, accepted, number)."""
    good, bad = (max(1, sum(n for _, a, n in bins if a == side)) for side in (True, False))
    best, at = -1.0, 0.0
    edges = sorted({e for e, _, _ in bins})
    for lo, t in zip([None, *edges], [*edges, None], strict=True):
        if t is None:
            continue
        gain = sum(n for e, a, n in bins if a and e >= t) / good + sum(n for e, a, n in bins if not a and e < t) / bad
        if gain > best + 1e-12:
            best, at = gain, t if lo is None else (lo + t) / 2
    return at
