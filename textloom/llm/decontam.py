"""Benchmark decontamination by latent semantic retrieval.

The benchmark's words span the vector space; documents are seen as passages, as
wide as the widest of ``WIDTHS`` that the item sought has words for.  Over all
passages of all documents:

1. frequencies of the vocabulary (distributed sums);
2. a randomised factorisation of their TF-IDF matrix A in one pass: with a
   Gaussian test matrix W, ``Z = A'(A W)`` is summed over the tasks, and the
   Nystroem form ``A'A ~ Z (W'Z)^-1 Z'`` gives the leading right singular
   vectors and values (Halko, Martinsson and Tropp, 2011).  The items and all
   passages of all documents count in it;
3. each overlapping passage of every document is projected and compared by cosine with the
   projected benchmark passages; passages most of whose TF-IDF weight lies
   outside the vocabulary are not candidates.

Candidates are decided on words: the longest common subsequence of the item
and the text around the passage covers ``copy`` of the item, or it covers
``paraphrase`` of it and the item's answer is there.  An item's answer is its
column ``answer`` or else its last ``ANSWER_WORDS`` words.

The benchmark is a query set; it comes in blocks of about ``BLOCK_WORDS`` words,
each of which passes over all documents.  Sums have the size of a block's
vocabulary times ``RANK``, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, blocks_of, few, summed_blocks, summed_rows, tidy, unused

BLOCK_WORDS, RANK, ANSWER_WORDS = 500_000, 64, 8
#: None: the latent space is fitted on all documents.  A number makes it about so many words of them, chosen by a hash of the text.
FIT_WORDS: int | None = None
#: Words of the passages that are compared, widest first; items shorter than all take the last.
WIDTHS = (24, 12, 8)
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PIECES = 128
#: Words of documents taken at once, whatever their lengths, and passages of items compared at once.
_PIECE, _QUERIES = 40_000, 2048
#: Words of documents whose products are summed at once; small enough for the cache.
_SUMMED = 20_000


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(None, _PUNCTUATION).split()


def common_subsequence(item: list[bytes], text: list[bytes]) -> int:
    """Length of the longest common subsequence, bit-parallel over the item."""
    places: dict[bytes, int] = {}
    for k, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    v = full
    for w in text:
        u = v & places.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


class Block:
    """A block of benchmark items, its vocabulary and its passages."""

    def __init__(self, items: list[tuple[int, str, str | None]]):
        self.ids = [i for i, _, _ in items]
        self.words = [words_of(t) for _, t, _ in items]
        self.answers = [words_of(a) if a else w[-ANSWER_WORDS:] for (_, _, a), w in zip(items, self.words, strict=True)]
        self.widths = [next((x for x in WIDTHS if x <= len(w)), WIDTHS[-1]) for w in self.words]
        self.number = {w: k for k, w in enumerate(sorted({w for ws in self.words for w in ws}))}
        self.passages = []  # (item, first word)
        for k, w in enumerate(self.words):
            last = max(0, len(w) - self.widths[k])
            # along the whole item: any part of it may be all that a document holds
            self.passages += [(k, o) for o in sorted({*range(0, last, self.widths[k] // 2), last})] if w else []

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))

    def fit(self, docs: DataFrame, text_col: str, seed: int) -> None:
        """Inverse document frequencies, projection and projected items."""
        d, number, width = len(self.number), self.numbers, WIDTHS[0]
        count = docs.sparkSession.sparkContext.broadcast(self.number)

        def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got, sums, passages = count.value.get, np.zeros(d + 1), 0
            for b in batches:
                for text in b["text"]:
                    w = words_of(text.as_py())
                    # words outside of the vocabulary are counted where the number of passages goes then
                    sums += np.bincount(np.fromiter(map(got, w, repeat(d)), np.int64, len(w)), minlength=d + 1)
                    passages += -(-len(w) // width)
            sums[d] = passages
            yield blocks_of(sums, _PIECES)

        texts = docs.select(F.col(text_col).cast("string").alias("text"))
        sums = summed_blocks(texts.mapInArrow(tidy(frequencies), "block int, data binary"), d + 1, _PIECES)
        # the items are passages of the corpus as well
        own = [number(self.words[k][o : o + self.widths[k]]) for k, o in self.passages]
        total = sums[d] + len(own)
        # a word seldom stands twice in a passage, so its occurrences stand for the passages that hold it
        self.idf = np.log((total + 1) / (sums[:d] + np.bincount(np.concatenate([np.empty(0, np.int64), *own]), minlength=d) + 0.5)).clip(0)
        self.unknown = float(np.log((total + 1) / 1.5))
        rank = min(RANK, d)
        test = np.random.default_rng(seed).normal(size=(d, rank))
        # words in more than a twentieth of all passages tell little and are most of the text
        rare = self.idf > np.log(20)
        weight = np.where(rare, self.idf, 0.0).astype(np.float32)
        shared = docs.sparkSession.sparkContext.broadcast((self.number, np.append(rare, False), weight[:, None] * test.astype(np.float32)))

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, known, w = shared.value
            z = np.zeros((d, rank), np.float32)
            numbers, owners, size, at = [], [], 0, 0
            for b in batches:
                for text in b["text"]:
                    ws = words_of(text.as_py())
                    n = np.fromiter(map(names.get, ws, repeat(d)), np.int32, len(ws))
                    k = np.flatnonzero(known[n])
                    for lo in range(0, len(k), _SUMMED):
                        part = k[lo : lo + _SUMMED]
                        numbers.append(n[part]), owners.append(at + part // width)
                        size += len(part)
                        if size >= _SUMMED:
                            _gram(np.concatenate(numbers), np.concatenate(owners), w, z)
                            numbers, owners, size = [], [], 0
                    at += -(-len(ws) // width)
            if numbers:
                _gram(np.concatenate(numbers), np.concatenate(owners), w, z)
            touched = np.flatnonzero(z.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(touched, pa.int64()), pa.array([z[k].tobytes() for k in touched], pa.binary())], names=["k", "data"])

        if FIT_WORDS is not None and FIT_WORDS < sums[d] * width:
            texts = texts.where(F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1_000_000)) < int(FIT_WORDS / (sums[d] * width) * 1_000_000))
        z = summed_rows(texts.mapInArrow(tidy(products), "k long, data binary"), d, rank)
        if own:
            _gram(np.concatenate(own), np.repeat(np.arange(len(own)), [len(n) for n in own]), weight[:, None] * test, z)
        # a word's own weight is a factor of its whole row
        z *= weight[:, None]
        core = test.T @ z
        values, vectors = np.linalg.eigh((core + core.T) / 2)
        good = values > values.max(initial=0) * 1e-8
        left, size, _ = np.linalg.svd(z @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
        keep = size > size.max(initial=0) * 1e-4
        # folding in: V times the inverse of the singular values, so that no direction of the corpus dominates
        self.project = (self.idf[:, None] * left[:, keep] / size[keep]).astype(np.float32)
        q = np.stack([self.project[n].sum(0) for n in own]) if own else np.zeros((0, self.project.shape[1]), np.float32)
        self.queries = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-20)


def _gram(numbers: np.ndarray, owners: np.ndarray, w: np.ndarray, z: np.ndarray) -> None:
    """Adds B'(B w) to z, where B counts the given words in their passages; owners ascend."""
    if not len(numbers):
        return
    first = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
    sizes = np.diff(np.r_[first, len(numbers)])
    # longest passages first: those that have a next word are a prefix
    longest = np.argsort(-sizes, kind="stable")
    begin, falling = first[longest], -sizes[longest]
    y = w[numbers[begin]]
    for k in range(1, -falling[0]):
        m = np.searchsorted(falling, -k)
        y[:m] += w[numbers[begin[:m] + k]]
    place = np.empty(len(first), np.int64)
    place[longest] = np.arange(len(first))
    order = np.argsort(numbers, kind="stable")
    sorted_ = numbers[order]
    at = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    z[sorted_[at]] += np.add.reduceat(y[np.repeat(place, sizes)[order]], at, axis=0)


def _sums(weights: np.ndarray, s: int) -> np.ndarray:
    """Sums of every four blocks of ``s`` weights."""
    sums = np.concatenate([[0.0], np.cumsum(weights)])[::s]
    return sums[4:] - sums[:-4]


class Search:
    """What a task needs to search documents for a block's items."""

    def __init__(self, block: Block, cosine: float, coverage: float, copy: float, paraphrase: float):
        self.words, self.answers, self.ids, self.passages = block.words, block.answers, block.ids, block.passages
        self.number, self.widths = block.number, block.widths
        # for each width, the passages of that width
        self.kinds = [(x, np.flatnonzero([block.widths[k] == x for k, _ in block.passages])) for x in sorted(set(block.widths))]
        # the last rows stand for words outside of the vocabulary and for no word
        self.project = np.vstack([block.project, np.zeros((2, block.project.shape[1]), np.float32)])
        self.weights = np.append(block.idf, [0.0, 0.0]), np.append(block.idf, [block.unknown, 0.0])
        self.queries = block.queries
        self.cosine, self.coverage, self.copy, self.paraphrase = cosine, coverage, copy, paraphrase
        self.sets = [set(w) for w in self.words]

    def candidates(self, texts: list[list[bytes]]) -> Iterator[tuple[int, int, int]]:
        """(text, item, where in the text it would begin) of passages near a benchmark passage."""
        pad, held, size = len(self.number) + 1, [], 0
        for t, words in enumerate(texts):
            n = np.fromiter(map(self.number.get, words, repeat(pad - 1)), np.int32, len(words))
            for at in range(0, len(n), _PIECE):
                part = n[at : at + _PIECE + WIDTHS[0]]
                held.append((t, at, part))
                size += len(part)
                if size >= _PIECE:
                    yield from self._near(held, pad)
                    held, size = [], 0
        if held:
            yield from self._near(held, pad)

    def _near(self, pieces: list[tuple[int, int, np.ndarray]], pad: int) -> Iterator[tuple[int, int, int]]:
        for width, queries in self.kinds:
            s = width // 4
            # whole blocks of words, then three empty blocks, so that no passage joins two texts
            blocks = np.array([-(-min(len(n), _PIECE) // s) for _, _, n in pieces])
            filled = np.array([-(-len(n) // s) for _, _, n in pieces])
            begin = np.concatenate([[0], np.cumsum(filled + 3)])
            flat = np.full(begin[-1] * s, pad, np.int32)
            for b, (_, _, n) in zip(begin, pieces, strict=False):
                flat[b * s : b * s + len(n)] = n
            known, mass = (_sums(w[flat], s) for w in self.weights)
            piece = np.repeat(np.arange(len(pieces)), blocks)
            start = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            at = begin[piece] + start
            # (sums differ by rounding where there is no known word at all)
            ok = (known[at] >= self.coverage * mass[at]) & (known[at] > 1e-6)
            at, piece, start = at[ok], piece[ok], start[ok]
            if not len(at):
                continue
            # only the blocks of such passages are projected
            needed = np.zeros(begin[-1], bool)
            for k in range(4):
                needed[at + k] = True
            place = np.cumsum(needed) - 1
            words = flat.reshape(-1, s)[needed]
            parts = self.project[words[:, 0]]
            for k in range(1, s):
                parts += self.project[words[:, k]]
            v = parts[place[at]]
            for k in range(1, 4):
                v += parts[place[at + k]]
            least = self.cosine * np.sqrt((v * v).sum(1))[:, None] + 1e-20
            for lo in range(0, len(queries), _QUERIES):
                some = queries[lo : lo + _QUERIES]
                near = v @ self.queries[some].T >= least
                for k, q in zip(*divmod(np.flatnonzero(near), len(some)), strict=True):
                    item, first = self.passages[some[q]]
                    t, offset, _ = pieces[piece[k]]
                    yield t, item, offset + int(start[k]) * s - first

    def found(self, texts: list[str | None]) -> list[dict[int, tuple[int, str]]]:
        """For each text and item found in it: words in common and whether it is a copy or a paraphrase."""
        words = [words_of(t) for t in texts]
        out: list[dict[int, tuple[int, str]]] = [{} for _ in texts]
        for t, item, at in self.candidates(words):
            w = self.words[item]
            if out[t].get(item, (0, ""))[0] == len(w):
                continue
            around = words[t][max(0, at - self.widths[item]) : at + len(w) + len(w) // 4 + self.widths[item]]
            if len(self.sets[item].intersection(around)) < self.paraphrase * len(self.sets[item]):
                continue
            n = common_subsequence(w, around)
            a = self.answers[item]
            kind = "copy" if n >= self.copy * len(w) else "paraphrase" if n >= self.paraphrase * len(w) and common_subsequence(a, around) >= 0.75 * len(a) else None
            if kind and n > out[t].get(item, (0, ""))[0]:
                out[t][item] = n, kind
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, cosine: float = 0.5, coverage: float = 0.4, copy: float = 0.75, paraphrase: float = 0.5, seed: int = 5) -> DataFrame:
    """(doc_id, item_id, common_words, item_words, kind), one row for each row of ``docs`` and item found in it.

    kind is copy or paraphrase.  Null or empty texts and items without words
    match nothing; items with equal texts are all reported; repeated and null
    ids are rows of their own.  Other columns are ignored.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, common_words int, item_words int, kind string"
    answer = F.col(answer_col) if answer_col else F.lit(None)
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t"), answer.cast("string").alias("a")).where("t is not null").orderBy("i", "t")
    out, block, size = None, [], 0

    def searched(block: list) -> DataFrame:
        b = Block(block)
        b.fit(docs, text_col, seed)
        shared = spark.sparkContext.broadcast(Search(b, cosine, coverage, copy, paraphrase))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = shared.value
            for r in batches:
                rows = []
                for lo in range(0, r.num_rows, 256):
                    part = r.slice(lo, 256)
                    for d, hits in zip(part["doc_id"].to_pylist(), search.found(part["text"].to_pylist()), strict=True):
                        rows += [(d, search.ids[k], n, len(search.words[k]), kind) for k, (n, kind) in sorted(hits.items())]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["doc_id", "item_id", "common_words", "item_words", "kind"])

        return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), schema)

    for r in items.toLocalIterator():
        if n := len(words_of(r["t"])):
            block.append((r["i"], r["t"], r["a"]))
            size += n
        if size >= BLOCK_WORDS:
            part, block, size = searched(block), [], 0
            out = part if out is None else out.unionByName(part)
    if block:
        part = searched(block)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str | None = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found.

    Rows are judged by their text (its 64-bit hash), whatever ids they share.
    Rows with a null id stay; without ``id_col`` every row is judged.  Columns
    stay as they are, whatever their names.
    """
    s = Scratch(docs.sparkSession, "decontam")
    (name,) = unused(docs, "__gone")
    key = F.xxhash64(F.col(text_col).cast("string"))
    found = contaminated(docs.select(key.alias("__key"), F.col(text_col).alias("__text")), benchmark, "__key", "__text", **how)
    gone = few(s.keep(found.select(F.col("doc_id").alias(name)).distinct(), "gone"))
    leaks = key == F.col(name)
    return docs.join(gone, leaks & F.col(id_col).isNotNull() if id_col else leaks, "left_anti")
