"""The queries of the corpus operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimforge.llm.common import few_texts, table
from claimforge.llm.cuckoo import exact_groups
from claimforge.llm.jaccard import similar_groups
from claimforge.llm.knn import nearest
from claimforge.llm.license import license_scan
from claimforge.llm.linedup import site_line_dedup
from claimforge.llm.mixing import mix
from claimforge.llm.packing import pack
from claimforge.llm.quality import fit, score
from claimforge.llm.urlfilter import judge
from claimforge.llm.warc import read_archives, write_archives
from claimforge.operators.storage import scratch_path


def op1_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).drop("url", "refers_to_url")


def op2_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies")


def op4_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"), k=3, percent=90)


def op6_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("row")


def op7_block_join_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op8_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = site_line_dedup(table(spark, sf_dir, "pages"))
    return cleaned.select("page_id", "site", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op9_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    few_texts(spark)
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc_revisit, op2_redirect_equivalence, op3_source_mixing, op4_best_two_fit, op5_ngram_jaccard, op6_cuckoo_dedup, op7_block_join_knn, op8_site_lines, op9_weak_label_quality, op10_license_scan)}

SQL = {
    "op3_source_mixing": r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, source_size * 3 AS cap, rn,
         CASE (rn - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS w
  FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM totals)),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM totals) - coalesce(sum(cap) OVER (ORDER BY cap / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(w) OVER (ORDER BY cap / w, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed),
chosen AS (
  SELECT *, first_value(CASE WHEN level * w <= cap THEN level END IGNORE NULLS) OVER (ORDER BY cap / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lam FROM levels),
targets AS (
  SELECT source, source_size, CASE WHEN lam IS NULL THEN cap::DOUBLE ELSE lam * w END AS target,
         ('0x' || substr(md5('17|' || coalesce(source, chr(0))), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM chosen),
salts AS (SELECT greatest(1, ceil(sqrt(count(*)::DOUBLE) / 4)) AS k FROM sized),
placed AS (
  SELECT d.*, length(d.size::VARCHAR) * 10 + substr(d.size::VARCHAR, 1, 1)::INT AS stratum,
         floor(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|17'), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE * k)::INT AS salt
  FROM sized d, salts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY stratum, salt, size, doc_id) AS rank FROM placed),
rated AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, r.rank, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 1.0::DOUBLE END AS rate
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * least(floor(rank * rate + u) - floor((rank - 1) * rate + u), ceil(rate)))::BIGINT AS taken
FROM rated""",
    "op6_cuckoo_dedup": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
k AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w AS rn
  FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(x) DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM k""",
    "op1_warc_revisit": r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS x, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, strlen(x)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - i % 4 * 5)::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to,
       true AS digest_ok
FROM g""",
}
