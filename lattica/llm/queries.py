"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from lattica.llm import ann, chat, decontamination, licenses, lm, mixing, sharding, simhash, toxicity, urls, vectorcodes, warc, whitening

QUERIES = {}
ORACLE_SQL = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles = warc.write_bundles(table(spark, sf_dir, "pages"))
    return warc.read_bundles(bundles, with_payload=False).drop("payload", "url")


ORACLE_SQL["op1_warc"] = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
coded AS (
  SELECT *, list_transform(range(40), lambda k: instr('0123456789abcdef', hex[k + 1]) - 1) AS h FROM payloads),
named AS (
  SELECT page_id, payload_bytes, min(page_id) OVER (PARTITION BY hex) AS first,
         array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((h[5 * k // 4 + 1] * 16 + coalesce(h[5 * k // 4 + 2], 0)) >> (3 - 5 * k % 4)) & 31) + 1, 1)), '') AS payload_digest
  FROM coded)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM named
"""


def _spans_text(spans: str) -> Column:
    """``start-end`` of each span, comma-joined."""
    parts = F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


@query
def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    rows = chat.preferences(turns, chat.adjacent_pairs(turns))
    return rows.withColumns({name: _spans_text(name) for name in ("chosen_spans", "rejected_spans")})


ORACLE_SQL["op2_chat"] = r"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n,
         '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered
  FROM turns),
pairs AS (
  SELECT conv_id // 2 AS pair_id, min(conv_id) AS chosen_id, max(conv_id) AS rejected_id
  FROM turns GROUP BY conv_id // 2 HAVING min(conv_id) <> max(conv_id)),
both_sides AS (
  SELECT pair_id, n, c.role AS c_role, c.text AS c_text, r.role AS r_role, r.text AS r_text
  FROM (SELECT pair_id, n, role, text FROM numbered JOIN pairs ON conv_id = chosen_id) c
  FULL JOIN (SELECT pair_id, n, role, text FROM numbered JOIN pairs ON conv_id = rejected_id) r USING (pair_id, n)),
prefix AS (
  SELECT pair_id, coalesce(min(n) FILTER (WHERE c_role IS DISTINCT FROM r_role OR c_text IS DISTINCT FROM r_text) - 1,
                           max(n)) AS k
  FROM both_sides GROUP BY pair_id),
completions AS (
  SELECT pair_id, conv_id, role, text, rendered, n,
         coalesce(sum(length(rendered)) OVER (PARTITION BY pair_id, conv_id ORDER BY n
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM numbered JOIN pairs ON conv_id IN (chosen_id, rejected_id) JOIN prefix USING (pair_id) WHERE n > k),
spans AS (
  SELECT *, (begins + length(role) + 5)::BIGINT || '-' || (begins + length(rendered))::BIGINT AS span FROM completions),
texts AS (
  SELECT pair_id, conv_id, string_agg(rendered, '' ORDER BY n) AS completion,
         coalesce(string_agg(span, ',' ORDER BY n) FILTER (WHERE role = 'assistant'), '') AS spans
  FROM spans GROUP BY pair_id, conv_id),
prompts AS (
  SELECT pair_id, string_agg(rendered, '' ORDER BY n) AS prompt
  FROM numbered JOIN pairs ON conv_id = chosen_id JOIN prefix USING (pair_id) WHERE n <= k GROUP BY pair_id)
SELECT pair_id, chosen_id, rejected_id, k::INTEGER AS prefix_turns, coalesce(prompt, '') AS prompt,
       coalesce(c.completion, '') AS chosen, coalesce(r.completion, '') AS rejected,
       coalesce(c.spans, '') AS chosen_spans, coalesce(r.spans, '') AS rejected_spans
FROM pairs JOIN prefix USING (pair_id) LEFT JOIN prompts USING (pair_id)
LEFT JOIN texts c ON c.pair_id = pairs.pair_id AND c.conv_id = chosen_id
LEFT JOIN texts r ON r.pair_id = pairs.pair_id AND r.conv_id = rejected_id
"""


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


ORACLE_SQL["op3_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT
           || '|' || (row_number() OVER (PARTITION BY source, doc_id, coalesce(text, '')) - 1)), 1, 15))::BIGINT AS h
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, source_size::DOUBLE * 3 AS cap,
         ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM sources),
levels AS (
  SELECT *, row_number() OVER fill AS place,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER ()
            - coalesce(sum(weight) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed WINDOW fill AS (ORDER BY cap / weight, source ASC NULLS LAST)),
targets AS (
  SELECT source, source_size,
         least(cap, coalesce((SELECT arg_min(level, place) FROM levels WHERE level * weight <= cap) * weight, cap))
           AS target
  FROM levels),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS whole
  FROM targets),
hashes AS (
  SELECT source, h, sum(size) AS size FROM sized GROUP BY source, h),
running AS (
  SELECT b.source, h, size, greatest(target - whole * source_size, 0) AS budget,
         sum(size) OVER (PARTITION BY b.source ORDER BY h) AS upto
  FROM hashes JOIN budgets b ON hashes.source IS NOT DISTINCT FROM b.source),
ends AS (
  SELECT source, min(h) AS h FROM running WHERE budget > 0 AND upto >= budget GROUP BY source),
thresholds AS (
  SELECT r.source, r.h + CASE WHEN upto - size + size / 2 <= budget THEN 1 ELSE 0 END AS threshold
  FROM running r JOIN ends e ON r.source IS NOT DISTINCT FROM e.source AND r.h = e.h),
copies AS (
  SELECT doc_id, s.source, size, source_size, target,
         whole + CASE WHEN s.h < coalesce(threshold, 0) THEN 1 ELSE 0 END AS copies
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
  LEFT JOIN thresholds t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target, copies, size * copies AS taken FROM copies
"""


@query
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op6_decontamination"] = r"""
WITH document_words AS (
  SELECT doc_id, row_number() OVER () AS r,
         coalesce(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
item_words AS (
  SELECT item_id::VARCHAR AS item_id,
         regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s : s + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM item_words WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT k FROM windows),
places AS (
  SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM document_words, lengths WHERE len(w) >= k),
hits AS (
  SELECT p.r, p.s, p.k, i.item_id
  FROM (SELECT r, s, k, array_to_string(w[s : s + k - 1], ' ') AS win FROM places) p
  JOIN windows i ON p.k = i.k AND p.win = i.win),
hit_words AS (
  SELECT r, count(DISTINCT a) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS a FROM hits) GROUP BY r),
hit_items AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM document_words LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""


@query
def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


@query
def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.codes(table(spark, sf_dir, "embeddings"))


@query
def op13_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
