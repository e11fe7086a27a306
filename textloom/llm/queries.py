"""The thin queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import debruijn, decontam, int8_near, jaccard_tree, mixing, quality, sharding, textfeatures, tokens, toxicity, url_lm
from .shared import Scratch


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_token_files(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    folder = Scratch(spark, "tokens").path("files")
    tokens.write_tokens(_read(spark, sf_dir, "documents"), folder, vocabulary or public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tokens.read_tokens(spark, folder)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_tree.near_duplicates(_read(spark, sf_dir, "documents"), n_words=3, percent=90)


def op4_embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return int8_near.near_embeddings(_read(spark, sf_dir, "embeddings"), threshold=0.93)


#: (rule, verdict)
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lm.filter_urls(_read(spark, sf_dir, "pages"), [url_lm.Rule.parse(*r) for r in URL_RULES])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.repeated_words(_read(spark, sf_dir, "documents"), size=35)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"), mod=4, left_out=2)
    return toxicity.toxicity(docs, model, 0.3).select("doc_id", F.coalesce(textfeatures.remainder(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality.train(docs, _read(spark, sf_dir, "labels"), mod=3, left_out=1)
    return quality.quality(docs, model, 0.5).select("doc_id", F.coalesce(textfeatures.remainder(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents")).withColumn("mix_copy", F.col("mix_copy").cast("int"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.even_tree(8)
    rows = sharding.shards(_read(spark, sf_dir, "documents"), tree, sharding.grown(tree, 8))
    return rows.withColumn("law", F.lit("key")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_token_files, op3_jaccard_join, op4_embedding_neighbours, op5_url_filter, op6_substring_dedup, op7_toxicity, op8_quality, op9_mixing, op10_sharding)}

_WORDS = "list_filter(regexp_split_to_array({0}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _drawn(key: str, *parts: str) -> str:
    """The number in [0, 1) that ``mixing.uniform`` makes of literals and a key."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(repr(p) for p in parts)}{', ' if parts else ''}{key})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


def _placed(tree: sharding.Node, key: str, seed: int = 29) -> str:
    """The shard of a key in a tree, as SQL."""
    if not tree.children:
        return str(tree.shard)
    if len(tree.children) == 1:
        return _placed(tree.children[0], key, seed)
    draws = [f"(-ln(1.0::DOUBLE - {_drawn(key, str(seed), c.name)}) / {c.total!r}::DOUBLE)" for c in tree.children]
    cases = " ".join(f"WHEN {d} THEN {_placed(c, key, seed)}" for d, c in zip(range(1, len(draws) + 1), tree.children, strict=True))
    return f"(CASE list_position([{', '.join(draws)}], least({', '.join(draws)})) {cases} END)"


#: crc32 (reflected, 0xEDB88320) of the bytes of a text's hexadecimal digits, a byte at a time over a table.
_CRC = """list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, b: xor(c >> 8, list_extract(t, (xor(c, b) & 255) + 1)))"""

ORACLE_SQL = {
    "op3_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 2], ' ')) AS s FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 1, 2))) AS i) WHERE len(ws) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM both_ JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * x >= 90 * (p.n + q.n - x)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT a AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(b) AS component_id FROM reach LEFT JOIN n ON a = n.doc_id GROUP BY a
    """,
    "op10_sharding": f"""
        WITH bits AS (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i)),
        crc AS (SELECT list(v ORDER BY i) AS t FROM bits),
        d AS (SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size, xor({_CRC}, 4294967295)::BIGINT AS text_crc32, coalesce(doc_id::VARCHAR, '') AS key FROM documents, crc),
        placed AS (SELECT *, {_placed(sharding.even_tree(8), "key")}::INTEGER AS shard, {_placed(sharding.grown(sharding.even_tree(8), 8), "key")}::INTEGER AS grown_shard, {_drawn("key", "30")} AS u FROM d)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY u, doc_id, text_crc32, size) - 1)::BIGINT AS slot, grown_shard FROM placed
    """,
    "op4_embedding_neighbours": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
        n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM comp LEFT JOIN n USING (vec_id)
    """,
    "op6_substring_dedup": """
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        runs AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS run FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 33)) AS i)),
        twice AS (SELECT run FROM runs GROUP BY run HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, i + j AS i FROM runs SEMI JOIN twice USING (run), (SELECT unnest(range(0, 35)) AS j)),
        words AS (SELECT doc_id, i, ws[i] AS word FROM w, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i)),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
        lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
        FROM w LEFT JOIN kept k USING (doc_id) LEFT JOIN lost USING (doc_id)
    """,
    "op9_mixing": """
        WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
        sums AS (SELECT (SELECT count(*) FROM documents)::DOUBLE / count(*)::DOUBLE AS scale FROM sizes),
        rates AS (SELECT source, 1.0::DOUBLE * scale / n AS rate FROM sizes, sums),
        points AS (SELECT source, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM rates, (SELECT unnest(range(0, 300)) AS k) ks),
        cdf AS (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM points),
        drawn AS (SELECT *, ('0x' || substr(md5(concat_ws('|', '17', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents)
        SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.rate AS mix_rate, c.k::INTEGER AS mix_copy
        FROM drawn d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source AND c.c <= d.u
    """,
}
