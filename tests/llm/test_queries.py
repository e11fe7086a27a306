"""The queries of this subpackage against their SQL in DuckDB, and rows of them that the contracts fix."""

import pytest
from compare import differences

from textloom.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_duckdb(spark, name):
    assert differences(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name], FOLDER) == ""


@pytest.mark.parametrize(("name", "columns"), [
    ("op2_token_files", "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"),
    ("op3_jaccard_join", "doc_id bigint, n_shingles bigint, component_id bigint"),
    ("op5_url_filter", "page_id bigint, host string, path string, rule string, verdict string"),
    ("op7_toxicity", "doc_id bigint, held_out boolean, score double, predicted int"),
    ("op8_quality", "doc_id bigint, held_out boolean, score double, predicted int"),
    ("op10_sharding", "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int"),
])
def test_columns_and_rows(spark, name, columns):
    got = queries.QUERIES[name](spark, FOLDER)
    assert ", ".join(f"{n} {t}" for n, t in got.dtypes).startswith(columns)
    table = "pages" if name == "op5_url_filter" else "documents"
    assert got.count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
