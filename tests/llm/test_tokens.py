import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textloom.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "a b", " a  b ", "x\n y\n\nz", "it's  we'll\t tab", "naïve café ñ 中文 字 　 wide space", "1 22 333 !? ... 'd", "<|endoftext|> and <| b", "a\x1cb \x1c c \x85 d", "w " * 5000, "\n\n a\n b \n", "é" * 9000, "a b"]


def test_pieces_equal_whole_encoding():
    t = Tokenizer.from_file(PATH)
    enc = tokens.Encoder(PATH, most=20)
    for text in TEXTS * 2:
        assert np.frombuffer(enc.ids(text), enc.type).tolist() == t.encode(text or "", add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("shards", [None, 3, 40])
def test_round_trip(spark, tmp_path, shards):
    t = Tokenizer.from_file(PATH)
    rows = [(i * 7 % 16, x, "clash") for i, x in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string").repartition(5)
    folder = f"file://{tmp_path}/set"
    tokens.write_tokens(df, folder, PATH, 2, shards=shards)
    got = sorted(tokens.read_tokens(spark, folder).collect())
    start = 0
    for r, (d, x, _) in zip(got, sorted(rows), strict=True):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        assert tuple(r)[:4] == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_ties_null_ids_and_no_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (None, "c")], "doc_id long, text string")
    tokens.write_tokens(df, f"{tmp_path}/a", PATH, 2)
    assert [r[:2] for r in sorted(map(tuple, tokens.read_tokens(spark, f"{tmp_path}/a").collect()), key=lambda r: r[1])] == [(None, 0), (1, 2), (1, 4), (1, 6)]
    tokens.write_tokens(df.limit(0), f"{tmp_path}/b", PATH, 2)
    assert tokens.read_tokens(spark, f"{tmp_path}/b").count() == 0
