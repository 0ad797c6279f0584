"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import arc, bpe, hamming_topk, html_text, jaccard_join, language_id, mixing, periodic_runs, quality_rules, secret_scan, source_divergence, token_counts, url_filter
from sparkloom.llm.common import new_path, table

#: (verdict, host, path) of the url filter's production entries.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    back = arc.archive_pages(pages.select(F.col("page_id").alias("id"), "url", payload.alias("payload")), new_path(spark, "warc"))
    page_id = F.when(F.col("key") != "-", F.col("key").cast("long"))
    return back.select(page_id.alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.fitted(docs, table(spark, sf_dir, "labels"))


def op3_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming_topk.sign_code(F.col("embedding")).alias("code"))
    return hamming_topk.search(rows, rows.filter(F.col("id") % 50 == 0), k=10, segments=4)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out())
    heads = language_id.train(docs.filter(~F.col("held_out")).select("doc_id", "lang", "text"))
    found = language_id.predict(docs.select("doc_id", "held_out", "text"), heads)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.with_copies(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return docs.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.detect(periodic_runs.with_periods(table(spark, sf_dir, "documents"))))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_arc_to_warc, op2_quality_rules, op3_hamming_topk, op4_jaccard_join, op5_secret_scan, op6_url_filter, op7_language_id, op8_source_mix, op9_bpe,
        op10_html_text, op11_periodic_runs, op12_source_divergence, op13_token_counts,
    )
    return {f.__name__: f for f in own}


OP1_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(p.h, 1 + 5 * (k // 4)::INTEGER, 5))::BIGINT) >> (15 - 5 * (k % 4))::INTEGER) & 31)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN m USING (h)
"""

OP6_SQL = r"""
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(verdict, rhost, rpath) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
hits AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC) AS k
  FROM u JOIN r ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT u.page_id, u.host, u.path, h.rule, coalesce(h.verdict, 'allow') AS verdict
FROM u LEFT JOIN (SELECT DISTINCT * FROM hits WHERE k = 1) h
  ON h.page_id = u.page_id AND h.host = u.host AND h.path = u.path
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(doc_id::VARCHAR, '-' || md5(coalesce(text, ''))) AS key, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3] AS w FROM s0),
s2 AS (
  SELECT *, 2.0::DOUBLE * source_size / w AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS due FROM s1),
s3 AS (
  SELECT *,
    coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done,
    sum(w) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
  FROM s2),
s4 AS (SELECT *, ratio * w_left <= due - done AS capped FROM s3),
s5 AS (
  SELECT source, source_size,
    CASE WHEN capped THEN 2.0::DOUBLE * source_size
         ELSE (due - sum(CASE WHEN capped THEN 2.0::DOUBLE * source_size ELSE 0 END) OVER ()) * w
              / sum(CASE WHEN capped THEN 0 ELSE w END) OVER () END AS target
  FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM s5),
c AS (
  SELECT d.doc_id, d.size, s6.source_size, s6.target,
    (floor(rate) + CASE WHEN ('0x' || substr(md5('mix-1:' || d.key), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
                        < rate - floor(rate) THEN 1 ELSE 0 END)::INTEGER AS copies
  FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""


OP3_SQL = """
WITH v AS (SELECT DISTINCT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
p AS (
  SELECT q.vec_id AS query_id, v.vec_id AS neighbour_id,
         list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: ((q.embedding[i] > 0) <> (v.embedding[i] > 0))::INTEGER))::INTEGER AS distance
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, neighbour_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id)::INTEGER AS rank FROM p) WHERE rank <= 10
"""


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (
  SELECT lang, source, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS n, count(DISTINCT r) AS docs
  FROM t GROUP BY 1, 2, 3),
k AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n AS n_lang
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT lang, source, term, cells.n,
         1 + 1000000000 * (cells.n + 2) // (sum(cells.n) OVER (PARTITION BY lang, source) + 2 * v.v)::HUGEINT AS p,
         1 + 1000000000 * (n_lang + 2) // (v.n + 2 * v.v) AS q
  FROM cells JOIN v USING (lang)),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM rows)
WHERE part = 'pair' OR rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_arc_to_warc": OP1_SQL, "op3_hamming_topk": OP3_SQL, "op6_url_filter": OP6_SQL, "op8_source_mix": OP8_SQL, "op12_source_divergence": OP12_SQL}
