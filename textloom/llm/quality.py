"""Quality: supervised subword embeddings.

Learned vectors of hashed words and character n-grams are averaged over a
document and go to a softmax, as in Joulin et al. (2016); both layers are
trained by numpy stochastic gradient descent on at most ``per_class`` labelled
rows of each class.  Scoring folds the output layer into the embedding table,
so a document costs one table look-up for each of its features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textfeatures import char_ngrams, class_share, fitted, labelled_sample, remainder, scored, word_slots

SIZES = (3, 4, 5)
BITS, DIM = 17, 16


def slots(text: str | None) -> list[np.ndarray]:
    """Slots of every word and character n-gram of a whole text, with repeats."""
    data = b" " + (text or "").encode("utf-8", "surrogatepass") + b" "
    return [word_slots(data.split(), BITS), *char_ngrams(data, SIZES, BITS)]


@dataclass
class Model:
    embedding: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def folded(self) -> tuple[np.ndarray, float]:
        """For each slot, the difference of the two outputs; and that of the biases."""
        return (self.embedding @ (self.output[:, 1] - self.output[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def score(text: str | None, table: np.ndarray, bias: float) -> float:
    """Softmax probability of class 1."""
    total, n = 0.0, 0
    for s in slots(text):
        total += table[s].sum(dtype=np.float64)
        n += len(s)
    return float(1 / (1 + np.exp(-np.clip(bias + total / max(n, 1), -500, 500))))


def fit(features: list[np.ndarray], counts: list[np.ndarray], y: np.ndarray, share: float, steps: int = 24_000, rate: float = 0.5, seed: int = 1) -> Model:
    """Softmax regression on averaged embeddings; ``share``: of class 1 among all rows."""
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    w, b = np.zeros((DIM, 2)), np.zeros(2)
    if len(set(y.tolist())) < 2:
        if len(y):
            b[y[0]] = 2.0
        return Model(e, w, b)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    epochs = min(40, max(6, steps // len(y)))  # few rows are gone over more often
    step, total = 0, epochs * len(y)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            f, c = features[i], counts[i]
            part = (c / c.sum()).astype(np.float32)
            mean = part @ e[f]
            z = mean @ w + b
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y[i]] -= 1
            g *= rate * (1 - step / total) * weight[i]
            back = w @ g
            w -= np.outer(mean, g)
            b -= g
            # each slot moves by its share of the average, scaled as if features had equal shares
            e[f] -= np.outer(part * min(len(f), 500), back).astype(np.float32)
            step += 1
    return Model(e, w, b)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 3, left_out: int = 1, per_class: int = 1500, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on rows of ``labels`` whose id's crc32 modulo ``mod`` is not ``left_out``."""
    use = remainder(mod) != left_out
    sample = labelled_sample(docs, labels, label, use, per_class, id_col, text_col)
    share = class_share(labels, label, use, 0.05, 0.95, id_col)

    def make(texts, y):
        found = [np.unique(np.concatenate(slots(t)), return_counts=True) for t in texts]
        m = fit([f for f, _ in found], [c for _, c in found], y, share)
        return [m.embedding.ravel(), m.output.ravel(), m.bias]

    embedding, output, bias = fitted(sample, make)
    return Model(embedding.reshape(-1, DIM), output.reshape(DIM, 2), bias)


def quality(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row.  Null texts score as empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model.folded())  # half a MB, whatever the data

    def run(texts):
        table, bias = shared.value
        return [score(t.as_py(), table, bias) for t in texts]

    return scored(docs, run, id_col, text_col).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
