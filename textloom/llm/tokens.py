"""Token ids as flat binary files.

A dataset is a folder with, for each shard, two flat files and one manifest:

``ids-NNNNN.bin``      token ids, unsigned little-endian 16 or 32 bit, one
                       document after another, each closed by the end id
``offsets-NNNNN.bin``  unsigned 64 bit: for each document the number of ids
                       before it in the whole dataset, then that of its end
``docs-NNNNN.bin``     signed 64 bit document ids in the same order
``manifest.json``      id width, and documents and ids of each shard

Documents lie in ascending id order over all shards.  Shards are range
partitions, so only per-shard totals meet on the driver: their prefix sums are
the shards' bases.  Files appear under their final names by rename, so a task
that runs again after a lost executor writes the same file again.  Local and
mounted folders are memory-mapped; other stores are read through Arrow's file
systems.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import tidy

#: A space between two characters that are no white space: the tokenizer's
#: pre-tokenizer always cuts before it, so the pieces are encoded alone.
_CUT = re.compile(r"(?<=\S) (?=\S)")


_MARKS = ".,;:!?"


class _ByteLevel(dict):
    """For str.translate: a character as its UTF-8 bytes in the alphabet of byte-level vocabularies.

    Bytes with a visible Latin-1 character stand for it, the others follow
    from U+0100 on.
    """

    def __init__(self):
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.byte = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}

    def __missing__(self, code: int) -> str:
        value = self[code] = "".join(self.byte[b] for b in chr(code).encode("utf-8", "surrogatepass"))
        return value


class Encoder:
    """Whole-text encoding with a byte-level BPE of the tokenizers library.

    Pieces between single spaces are encoded once and kept in a bounded cache;
    texts with a special token's opening are encoded whole.
    """

    def __init__(self, path: str, most: int = 700_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.cache: dict[str, bytes] = {}
        self.most = most
        self.code = "H" if self.type.itemsize == 2 else "I"
        # splitting is known to be right for this pre-tokenizer only
        pre = json.loads(self.tokenizer.to_str())
        kind = pre.get("pre_tokenizer") or {}
        self.splits = pre.get("normalizer") is None and kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space")
        self.letters = _ByteLevel()
        self.space = self.letters[ord(" ")]

    def ids(self, text: str | None) -> bytes:
        """The ids of a text as little-endian bytes (null: as empty)."""
        if not text:
            return b""
        if not self.splits or "<|" in text:
            return self._whole([text])[0]
        out = self._joined(text.split(" "), False)
        return self._joined(_CUT.split(text), True) if out is None else out

    def _joined(self, pieces: list[str], cut: bool) -> bytes | None:
        """Ids of pieces with spaces between; None where a plain split cut beside other white space."""
        first, *rest = pieces
        if not cut and (not first or first[-1].isspace()):
            return None
        cache = self.cache
        got = list(map(cache.get, rest))
        if None in got:
            # what is in the cache neither begins nor ends with white space
            new = list({p for p, g in zip(rest, got, strict=True) if g is None})
            odd = {p for p in new if not p or p[0].isspace() or p[-1].isspace()}
            if odd and not cut:
                return None
            ids = dict(zip(new, self._pieces(new), strict=True))
            got = [ids[p] if g is None else g for p, g in zip(rest, got, strict=True)]
            if len(cache) + len(ids) > self.most:
                cache.clear()
            cache.update(ids if not odd else {p: v for p, v in ids.items() if p not in odd})
        return b"".join([self._whole([first])[0], *got])

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that follow a space.

        A run of letters is one pre-token, and so is a mark after it: these go
        to the tokenizer's model at once.
        """
        out: list[bytes | None] = []
        for p in pieces:
            if p.isalpha():
                out.append(self._word(p))
            elif p[-1] in _MARKS and p[:-1].isalpha():
                word = self.cache.get(p[:-1])
                out.append((word or self._word(p[:-1])) + self._model(p[-1]))
            else:
                out.append(None)
        left = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(left, self._whole([" " + pieces[k] for k in left]), strict=True):
            out[k] = ids
        return out

    def _word(self, letters: str) -> bytes:
        return self._model(self.space + letters.translate(self.letters))

    def _model(self, token: str) -> bytes:
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(token)]).tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _write_file(uri: str, chunks: Iterator[bytes]) -> None:
    store, path = _open(uri)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        for c in chunks:
            out.write(c)
    store.move(part, path)


def _map(uri: str, dtype) -> np.ndarray:
    """A file as an array: memory-mapped where the folder is local or mounted."""
    store, path = _open(uri)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> list[dict]:
    """Write a dataset and return its manifest's shards.

    Null and empty texts become a document of the end id alone.  Rows with
    equal ids are separate documents, ordered by a hash of the text and dealt
    over shards by it; null ids come first and are stored as the least 64-bit integer.  Other columns are not read.  No
    rows: no shards.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows, keys = rows.withColumn("h", F.xxhash64("text")), ["id", "h"]
    rows = (rows.repartitionByRange(shards, *keys) if shards else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys, "text").select("id", "text")
    store, path = _open(folder)
    store.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, ids, sizes = _encoder(tokenizer_path), TaskContext.get().partitionId(), [], []
        end = np.array([end_id], enc.type).tobytes()

        def chunks():
            for b in batches:
                ids.extend(b["id"].to_pylist())
                for text in b["text"]:
                    data = enc.ids(text.as_py())
                    sizes.append(len(data) // enc.type.itemsize + 1)
                    yield data + end

        _write_file(f"{folder}/ids-{part:05d}.bin", chunks())
        if ids:
            _write_file(f"{folder}/docs-{part:05d}.bin", iter([np.array(ids, "<i8").tobytes()]))
            _write_file(f"{folder}/offsets-{part:05d}.bin", iter([np.cumsum([0, *sizes], dtype="<u8").tobytes()]))
            yield pa.RecordBatch.from_pydict({"shard": pa.array([part], pa.int32()), "docs": pa.array([len(ids)], pa.int64()), "ids": pa.array([sum(sizes)], pa.int64()), "width": pa.array([enc.type.itemsize], pa.int32())})

    # one row for each shard
    parts = sorted((r.asDict() for r in rows.mapInArrow(tidy(run), "shard int, docs long, ids long, width int").collect()), key=lambda r: r["shard"])
    bases = [0, *accumulate(p["ids"] for p in parts)]
    parts = [p | {"base": b} for p, b in zip(parts, bases, strict=False)]

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b["id"].to_pylist():
                p = parts[i]
                name = f"{folder}/offsets-{p['shard']:05d}.bin"
                local = _map(name, "<u8")
                # of a task that runs again the offsets may be global already
                _write_file(name, iter([(local - local[0] + np.uint64(p["base"])).astype("<u8").tobytes()]))
            yield b

    if parts:
        docs.sparkSession.range(0, len(parts), 1, len(parts)).mapInArrow(shift, "id long").count()
    _write_file(f"{folder}/manifest.json", iter([json.dumps({"end_id": end_id, "shards": parts}).encode()]))
    return parts


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) for each document of a dataset, read from its files."""
    store, path = _open(f"{folder}/manifest.json")
    with store.open_input_file(path) as f:
        parts = json.loads(f.read())["shards"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int"
    if not parts:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b["id"].to_pylist():
                p = parts[i]
                ids = _map(f"{folder}/ids-{p['shard']:05d}.bin", f"<u{p['width']}")
                at = _map(f"{folder}/offsets-{p['shard']:05d}.bin", "<u8").astype(np.int64)
                doc = _map(f"{folder}/docs-{p['shard']:05d}.bin", "<i8")
                for lo in range(0, len(doc), 10_000):
                    hi = min(lo + 10_000, len(doc))
                    crc = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(at[lo:hi] - p["base"], at[lo + 1 : hi + 1] - p["base"], strict=True)]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(np.array(doc[lo:hi]), mask=np.array(doc[lo:hi] == -(1 << 63))), "start": pa.array(at[lo:hi]), "n_tokens": pa.array(at[lo + 1 : hi + 1] - at[lo:hi]),
                        "ids_crc32": pa.array(crc, pa.int64()), "shard": pa.array([p["shard"]] * (hi - lo), pa.int32()),
                    })

    return spark.range(0, len(parts), 1, len(parts)).mapInArrow(tidy(run), schema)


def token_ids(spark: SparkSession, folder: str, shard: int) -> np.ndarray:
    """The ids of one shard, memory-mapped where possible."""
    store, path = _open(f"{folder}/manifest.json")
    with store.open_input_file(path) as f:
        parts = {p["shard"]: p for p in json.loads(f.read())["shards"]}
    return _map(f"{folder}/ids-{shard:05d}.bin", f"<u{parts[shard]['width']}")
