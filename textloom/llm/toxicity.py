"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

After Wang and Manning (2012): presence of each hashed n-gram is multiplied by
the log ratio of its smoothed class counts, and a logistic regression is fitted
on that by adaptive stochastic gradient descent.  Fitting uses every labelled
row in use: class counts are exact sums over all of them; for the regression
the rows are dealt at random into parts of about ``PART_ROWS``, each row into
one, and the parts' weights are averaged (McDonald, Hall and Mann, 2010), a
slot's in proportion to the rows that have it.  Every row is scored on its
whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, blocks_of, summed_blocks, tidy
from .textfeatures import Distinct, char_ngrams, class_share, labelled_rows, remainder, scored

SIZES = (3, 4, 5, 6)
BITS = 18
#: Standard errors below which a log-count ratio counts as none; chosen by ``noise_by_folds`` on training rows alone.
NOISE = 3.0
#: Rows, and bytes of text, of the parts on which the regression is fitted, on average.
PART_ROWS, PART_BYTES = 4000, 16_000_000
#: Averages are summed in units of 1 / _UNITS, so that the order of the parts changes nothing.
_PIECES, _UNITS = 128, float(1 << 20)


def features(text: str | None) -> np.ndarray:
    """Distinct slots of the character n-grams of a whole text, A-Z in lower case."""
    data = b" " + (text or "").encode("utf-8", "surrogatepass").lower() + b" "
    return _distinct(np.concatenate([_distinct(g) for g in char_ngrams(data, SIZES, BITS)]))


_distinct = Distinct(BITS)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        f = features(text)
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[f].sum(dtype=np.float64), -500, 500))))


def constant(n: int, ones: int) -> Model:
    """For rows with nothing to tell apart: the class seen, or unlikely."""
    return Model(np.zeros(1 << BITS, np.float32), float(np.log((0.5 + ones) / (0.5 + n - ones))) if n else -5.0)


def ratios(with_: np.ndarray, without: np.ndarray, ones: int, zeros: int, alpha: float = 1.0, noise: float | None = None) -> np.ndarray:
    """Log-count ratios of the slots, from the rows of class 1 and of class 0 that have them."""
    p, q = with_ + alpha, without + alpha
    ratio = np.log(p / (ones + 2 * alpha)) - np.log(q / (zeros + 2 * alpha))
    # a ratio within its own error of sampling says nothing, nor does one that smoothing alone makes where classes differ in size
    ratio[(np.abs(ratio) < (NOISE if noise is None else noise) * np.sqrt(1 / p + 1 / q)) | (ratio * (with_ / ones - without / zeros) <= 0)] = 0.0
    return ratio


def descended(slots: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, share: float, mean: float, steps: int = 16_000, rate: float = 0.05, decay: float = 1e-5, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights of the scaled slots and bias; ``mean``: the share of class 1 among all rows fitted on."""
    weight = np.where(y == 1, share / mean, (1 - share) / (1 - mean))
    w, b = np.full(1 << BITS, 0.01), np.log(share / (1 - share))
    seen, seen_b, rng = np.full(1 << BITS, 1e-2), 1e-2, np.random.default_rng(seed)
    # few rows are gone over more often
    for _ in range(min(40, max(4, steps // len(y)))):
        for i in rng.permutation(len(y)):
            f = slots[i]
            r = ratio[f]
            z = b + w[f] @ r
            g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[i]) * weight[i]
            d = g * r + decay * w[f]
            seen[f] += d * d
            w[f] -= rate * d / np.sqrt(seen[f])
            seen_b += g * g
            b -= rate * g / np.sqrt(seen_b)
    return w, float(b)


def fit(slots: list[np.ndarray], y: np.ndarray, share: float, noise: float | None = None, **how) -> Model:
    """Fit on feature sets; ``share`` is the share of class 1 among all rows to be scored."""
    ones = int(y.sum())
    if not 0 < ones < len(y):
        return constant(len(y), ones)
    p, q = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for f, c in zip(slots, y, strict=True):
        (p if c else q)[f] += 1
    ratio = ratios(p, q, ones, len(y) - ones, noise=noise)
    w, b = descended([f[ratio[f] != 0] for f in slots], y, ratio, share, ones / len(y), **how)
    return Model((w * ratio).astype(np.float32), b)


def noise_by_folds(slots: list[np.ndarray], y: np.ndarray, share: float, choices: tuple[float, ...] = (0.0, 1.0, 2.0, 3.0, 4.0), folds: int = 4) -> dict[float, float]:
    """For each choice of ``NOISE``, the mean log loss over folds of the training rows, classes weighted to their share."""
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    fold = np.random.default_rng(0).permutation(len(y)) % folds
    out = {}
    for noise in choices:
        loss = 0.0
        for k in range(folds):
            rest, held = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            m = fit([slots[i] for i in rest], y[rest], share, noise=noise)
            z = np.array([m.bias + m.weights[slots[i]].sum(dtype=np.float64) for i in held])
            loss += float((weight[held] * np.logaddexp(0, np.where(y[held] == 1, -z, z))).sum())
        out[noise] = loss / float(weight.sum())
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 4, left_out: int = 2, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on all rows of ``labels`` whose id's crc32 modulo ``mod`` is not ``left_out``."""
    use = remainder(mod) != left_out
    share = class_share(labels, label, use, 0.01, 0.9, id_col)
    s = Scratch(docs.sparkSession, "toxicity")
    rows = s.keep(labelled_rows(s, docs, labels, label, use, id_col, text_col), "rows")
    n, ones, size = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0)), F.sum(F.octet_length("text").cast("long"))).first()
    if not 0 < ones < n:
        s.drop()
        return constant(n, ones)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS))
        for b in batches:
            for t, y in zip(b["text"], b["y"].to_pylist(), strict=True):
                counts[y, features(t.as_py())] += 1
        yield blocks_of(counts.ravel(), _PIECES)

    without, with_ = summed_blocks(rows.select("text", "y").mapInArrow(tidy(counted), "block int, data binary"), 2 << BITS, _PIECES).reshape(2, -1)
    ratio = ratios(with_, without, ones, n - ones)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # 2 MB, whatever the data
    parts = max(-(-n // PART_ROWS), -(-size // PART_BYTES))

    def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, part, slots, ys = np.zeros((1 << BITS) + 1), None, [], []

        def add() -> None:
            w, b = descended(slots, np.array(ys), shared.value, share, ones / n)
            have = np.bincount(np.concatenate(slots), minlength=1 << BITS)
            sums[:-1] += np.rint(have * w * _UNITS)
            sums[-1] += np.rint(len(ys) * b * _UNITS)

        for batch in batches:
            for k, t, y in zip(batch["part"].to_pylist(), batch["text"], batch["y"].to_pylist(), strict=True):
                if k != part and ys:
                    add()
                    slots, ys = [], []
                f = features(t.as_py())
                slots.append(f[shared.value[f] != 0])
                ys.append(y)
                part = k
        if ys:
            add()
        yield blocks_of(sums, _PIECES)

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "hash", F.lit(1)), F.lit(parts)).cast("int"))
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "hash", "doc_id").select("part", "text", "y")
    sums = summed_blocks(dealt.mapInArrow(tidy(averaged), "block int, data binary"), (1 << BITS) + 1, _PIECES) / _UNITS
    s.drop()
    return Model((sums[:-1] / np.maximum(with_ + without, 1) * ratio).astype(np.float32), float(sums[-1] / n))


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row.  Null texts score as empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # 1 MB, whatever the data

    def score(texts):
        m = Model(*shared.value)
        return [m.score(t.as_py()) for t in texts]

    return scored(docs, score, id_col, text_col).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def clean(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = Model(*shared.value)
        return texts.map(lambda t: m.score(t if isinstance(t, str) else None)).astype("float64")

    return docs.where(score(F.col(text_col).cast("string")) < threshold)
