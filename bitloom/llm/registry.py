"""The registered queries of this subpackage and their DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from bitloom.llm import bloom_lm, bpe, cotraining, mixing, partenum, quality_rules, rpforest, toxicity, warc, wavelet
from bitloom.llm.shared import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.quality_cotraining(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.held_out_scores(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op8_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_files(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpforest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.near_duplicates(table(spark, sf_dir, "documents"))


#: SHA-1 in base32: each 5 hex digits are 4 letters of the alphabet.
OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, octet_length(encode(body)) AS n, sha1(body) AS hex FROM p),
f AS (SELECT hex, min(page_id) AS first_id FROM h GROUP BY hex)
SELECT h.page_id, CAST(h.n AS BIGINT) AS payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h.hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1), '' ORDER BY i)
   FROM range(32) AS r(i)) AS payload_digest,
  CASE WHEN h.page_id = f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN h.page_id = f.first_id THEN NULL ELSE f.first_id END AS refers_to
FROM h JOIN f USING (hex)
"""


#: Pairs are counted on shared shingles; components spread from each document to what it reaches.
OP10_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS ss FROM w),
e AS (SELECT doc_id, unnest(ss) AS sh FROM s),
n AS (SELECT doc_id, CAST(len(ss) AS BIGINT) AS n_shingles FROM s),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (
  SELECT p.x, p.y FROM p JOIN n nx ON nx.doc_id = p.x JOIN n ny ON ny.doc_id = p.y
  WHERE 100 * shared >= 80 * (nx.n_shingles + ny.n_shingles - shared)),
r AS (SELECT doc_id AS node, doc_id AS reach FROM n UNION SELECT r.node, l.y FROM r JOIN l ON l.x = r.reach)
SELECT n.doc_id, n.n_shingles, min(r.reach) AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n.n_shingles
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_quality_rules, op2_quality_cotraining, op3_toxicity, op4_warc, op5_mixing, op6_bloom_lm, op7_bpe, op8_wavelet, op9_rp_forest, op10_partenum]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": OP4_SQL, "op10_partenum": OP10_SQL}
