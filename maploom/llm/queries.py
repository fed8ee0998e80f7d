"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_join

    return jaccard_join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sentencepiece_codec import encode

    return encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens", "ids_crc32", "round_trip", "n_differ")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_files import token_files

    return token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, plain_specials=False)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .paragraph_dedup import paragraph_dedup

    return paragraph_dedup(_table(spark, sf_dir, "documents"), passages=True).select("doc_id", "n_removed", "n_shared", "removed_of", "kept_sha256")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    return line_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import reshard

    return reshard(_table(spark, sf_dir, "documents"), old_shards=6, new_shards=8)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_ALPHABET = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _shingles(table: str, key: str) -> str:
    """SQL: key, g of each distinct five-word shingle (the whole sequence of fewer words)."""
    words = _WORDS.format(f"translate(coalesce(text, ''), {_ALPHABET})")
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g
    FROM (SELECT {key}, {words} AS ws FROM {table})"""


SQL = {
    "op1_ngram_jaccard_join": f"""
WITH RECURSIVE s AS MATERIALIZED ({_shingles("documents", "doc_id")}),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * p.k >= 75 * (u.k + v.k - p.k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a)
SELECT d.doc_id, coalesce(n.k, 0) AS n_shingles, (SELECT min(c) FROM r WHERE r.id = d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op2_warc": """
WITH r AS (SELECT page_id, encode(coalesce(html, '')) AS p FROM pages), d AS (SELECT page_id, octet_length(p) AS n, sha1(p) AS h FROM r),
m AS (SELECT h, max(page_id) AS top FROM d WHERE n >= 1000 GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, d.h AS payload_digest, CASE WHEN top > page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN top > page_id THEN top END AS refers_to
FROM d LEFT JOIN m ON d.h = m.h AND d.n >= 1000""",
    "op8_line_dedup": rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS MATERIALIZED (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS MATERIALIZED (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_ALPHABET}) AS key FROM l),
hot AS (SELECT key FROM k WHERE length(key) > 0 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (FROM hot)) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key NOT IN (FROM hot)), '')) AS kept_sha256
FROM k GROUP BY r, doc_id""",
    "op10_benchmark_decontamination": f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, * FROM documents), b AS MATERIALIZED (SELECT row_number() OVER () AS q, * FROM benchmark),
s AS ({_shingles("d", "r")}), i AS ({_shingles("b", "q")}),
n AS (SELECT q, count(*) AS n_item FROM i GROUP BY q),
p AS (SELECT r, q, count(*) AS n_shared FROM s JOIN i USING (g) GROUP BY ALL)
SELECT doc_id, item_id::BIGINT AS item_id, n_item, n_shared FROM p JOIN n USING (q) JOIN d USING (r) JOIN b USING (q) WHERE 100 * n_shared >= 75 * n_item""",
}

QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_warc, op3_toxicity, op4_sentencepiece, op5_quality_rules, op6_token_files, op7_paragraph_dedup, op8_line_dedup, op9_sharding, op10_benchmark_decontamination)}
