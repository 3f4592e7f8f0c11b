"""The registered queries of the training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.bpe_lexicon import bpe_report
from tessera.llm.divergence import divergence_report
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.itq_dedup import vector_groups
from tessera.llm.language_id import language_report
from tessera.llm.license_scan import license_report
from tessera.llm.minhash import near_groups
from tessera.llm.orchard import cluster_report
from tessera.llm.packing import pack_documents
from tessera.llm.piece_bpe import round_trip_report
from tessera.llm.secret_scan import secret_report
from tessera.llm.token_codec import token_files
from tessera.llm.warc_zip import package_report


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(_table(spark, sf_dir, "documents"))


def op2_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_groups(_table(spark, sf_dir, "embeddings"))


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return package_report(_table(spark, sf_dir, "pages"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents"))


def op5_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(_table(spark, sf_dir, "documents"))


def op7_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_report(_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(_table(spark, sf_dir, "documents"))


def op9_token_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_report(_table(spark, sf_dir, "documents"))


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_report(_table(spark, sf_dir, "documents"))


def op13_orchard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op10_exact_dedup": op10_exact_dedup,
    "op1_license_scan": op1_license_scan,
    "op2_itq_dedup": op2_itq_dedup,
    "op3_warc_zip": op3_warc_zip,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_lexical_packing": op5_lexical_packing,
    "op6_language_id": op6_language_id,
    "op7_bpe_lexicon": op7_bpe_lexicon,
    "op8_secret_scan": op8_secret_scan,
    "op9_token_codec": op9_token_codec,
    "op11_source_divergence": op11_source_divergence,
    "op12_piece_bpe": op12_piece_bpe,
    "op13_orchard_clusters": op13_orchard_clusters,
}


def _cluster_sql(rounds: int = 3, k: int = 16) -> str:
    """The SQL of op13: a round's distances, choices, sums and new centroids are four of its tables."""
    floor = "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS MATERIALIZED (
  SELECT v.row, c.cluster, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::HUGEINT AS distance
  FROM v, c{r} c),
a{r} AS MATERIALIZED (
  SELECT row, cluster, distance FROM d{r} QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1),
s{r} AS (
  SELECT cluster, dim, {floor} AS x
  FROM (SELECT a.cluster, unnest(v.x)::HUGEINT AS x, generate_subscripts(v.x, 1) AS dim FROM a{r} a JOIN v USING (row))
  GROUP BY cluster, dim),
m{r} AS (SELECT cluster, list(x ORDER BY dim) AS x FROM s{r} GROUP BY cluster),
c{r + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (cluster))""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda y: floor(64 * y::DOUBLE)::HUGEINT) AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS cluster, x
  FROM v WHERE vec_id IS NOT NULL QUALIFY cluster < {k}),{",".join(steps)}
SELECT v.vec_id, a.cluster::INT AS cluster, a.distance::BIGINT AS distance,
       (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(a.distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (row) JOIN c{rounds} c ON c.cluster = a.cluster
"""


SQL = {
    "op3_warc_zip": r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (
  SELECT page_id, octet_length(b) AS payload_bytes, payload_digest,
         max(page_id) OVER (PARTITION BY b) AS first
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM w
""",
    "op10_exact_dedup": r"""
WITH k AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm,
         length(coalesce(text, '')) AS n
  FROM documents),
w AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM k)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM w
""",
    "op11_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
t AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (
  SELECT g.lang, g.source, k.term, count(t.term) AS n
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term
  GROUP BY g.lang, g.source, k.term),
p AS (
  SELECT lang, source, term, n,
         1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER w + 2 * count(*) OVER w) AS p
  FROM c WINDOW w AS (PARTITION BY lang, source)),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER w + 2 * count(*) OVER w) AS q
  FROM k WINDOW w AS (PARTITION BY lang)),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, ((p.p - q.q) * (p.p - q.q)) // (p.p + q.q)
  FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, value::BIGINT AS value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM r QUALIFY part = 'pair' OR rank <= 10
""",
    "op13_orchard_clusters": _cluster_sql(),
}
