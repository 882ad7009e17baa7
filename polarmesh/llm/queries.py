"""The contract queries of this subpackage and, where SQL can express one, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polarmesh.llm import chat, decontaminate, exact_dedup, html_extract, langid, near_dedup, packing, quality, source_audit, token_counts, toxicity, url_filter, vector_codes
from polarmesh.llm.shared import held_out, table


# The rules of the contract.
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 4096, 1)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return quality.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_examples(chat.preference_segments(chat.other_replies(table(spark, sf_dir, "conversations"))))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out()))
    return langid.identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = decontaminate.match_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 13)
    return decontaminate.contamination(matches)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.source_divergence(table(spark, sf_dir, "documents"), 30, 5, 3, 50)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), held_out(divisor=5, rest=0)
    model = toxicity.train(docs.where(~held), table(spark, sf_dir, "labels").where(~held))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"), 4, 256, 4, 1024)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_best_fit_packing, op3_exact_dedup, op4_quality, op5_chat_formatting, op6_html_extraction, op7_near_dedup, op8_url_filters, op9_language_id, op10_decontamination, op11_source_divergence, op12_toxicity, op13_vector_codes)
}

def _lloyd_sql() -> str:
    """Four rounds and the last assignment, unrolled."""
    step = """,
a{k} AS MATERIALIZED (
  SELECT n, part, min(struct_pack(far := far, entry := entry)) AS best FROM (
    SELECT v.n, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x)) AS far FROM v JOIN b{k} AS b ON b.part = v.part AND b.place = v.place GROUP BY 1, 2, 3)
  GROUP BY 1, 2)"""
    book = """,
b{next} AS MATERIALIZED (
  SELECT b.part, b.entry, b.place, coalesce(s.x, b.x) AS x FROM b{k} AS b LEFT JOIN (
    SELECT a.part, a.best.entry AS entry, v.place, CAST(floor(sum(v.x)::DOUBLE / count(*)) AS BIGINT) AS x FROM a{k} AS a JOIN v ON v.n = a.n AND v.part = a.part GROUP BY 1, 2, 3) AS s
  ON s.part = b.part AND s.entry = b.entry AND s.place = b.place)"""
    rounds = "".join((step + book).format(k=k, next=k + 1) for k in range(4)) + step.format(k=4)
    return f"""
WITH r AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS n, vec_id, label, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 1024) AS BIGINT)) AS xs
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
v AS MATERIALIZED (SELECT n, (k * 4) // len(xs) AS part, k % (len(xs) // 4) AS place, xs[k + 1] AS x FROM r, unnest(range(len(xs))) AS t(k)),
b0 AS MATERIALIZED (SELECT part, n AS entry, place, x FROM v WHERE n < 256){rounds},
c AS (SELECT n, string_agg(lower(printf('%02x', best.entry)), '' ORDER BY part) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM a4 GROUP BY n),
h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM b4)
SELECT r.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY r.label) AS BIGINT) AS label_error, h.codebooks_sha256
FROM r JOIN c ON c.n = r.n CROSS JOIN h
"""


ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
""",
    "op5_chat_formatting": r"""
WITH c AS (
  SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, max(turn) AS last FROM c WHERE role = 'assistant' GROUP BY conv_id),
y AS (SELECT c.conv_id, max(c.text) AS reply FROM c JOIN l ON c.conv_id = l.conv_id AND c.turn = l.last WHERE c.role = 'assistant' GROUP BY c.conv_id),
k AS (
  SELECT c.conv_id, c.turn, c.role, c.text, y.reply, c.role = 'assistant' AND c.turn = l.last AS replaced
  FROM c LEFT JOIN l ON l.conv_id = c.conv_id LEFT JOIN y ON y.conv_id = c.conv_id + 1),
m AS (
  SELECT conv_id AS pair_id, 0 AS odd, turn, role, text FROM c
  UNION ALL
  SELECT DISTINCT conv_id, 1, turn, role, CASE WHEN replaced THEN reply ELSE text END FROM k WHERE NOT coalesce(replaced, false) OR reply IS NOT NULL),
t AS (
  SELECT pair_id, turn, string_agg(CASE WHEN odd = 0 THEN role || chr(1) || text END, chr(2) ORDER BY role, text) AS c,
    string_agg(CASE WHEN odd = 1 THEN role || chr(1) || text END, chr(2) ORDER BY role, text) AS r
  FROM m GROUP BY pair_id, turn),
e AS (SELECT pair_id, min(CASE WHEN c IS DISTINCT FROM r THEN turn END) AS stop FROM t GROUP BY pair_id),
s AS (
  SELECT m.pair_id, CASE WHEN e.stop IS NULL OR m.turn < e.stop THEN 'prompt' WHEN m.odd = 0 THEN 'chosen' ELSE 'rejected' END AS part,
    m.odd, m.turn, m.role, m.text, '<|' || m.role || '|>' || chr(10) AS head, m.text || '<|end|>' || chr(10) AS body
  FROM m JOIN e ON m.pair_id = e.pair_id),
o AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY pair_id, part ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS after
  FROM s WHERE part <> 'prompt' OR odd = 0),
x AS (
  SELECT pair_id, part, string_agg(head || body, '' ORDER BY turn, role, text) AS rendered,
    string_agg(CASE WHEN part <> 'prompt' AND role = 'assistant' THEN CAST(CAST(after - length(body) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(after AS BIGINT) AS VARCHAR) END, ',' ORDER BY turn, role, text) AS mask
  FROM o GROUP BY pair_id, part)
SELECT e.pair_id, coalesce(p.rendered, '') AS prompt, coalesce(c.rendered, '') AS chosen, coalesce(r.rendered, '') AS rejected,
  coalesce(c.mask, '') AS chosen_mask, coalesce(r.mask, '') AS rejected_mask
FROM e
LEFT JOIN x AS p ON p.pair_id = e.pair_id AND p.part = 'prompt'
LEFT JOIN x AS c ON c.pair_id = e.pair_id AND c.part = 'chosen'
LEFT JOIN x AS r ON r.pair_id = e.pair_id AND r.part = 'rejected'
""",
    "op11_source_divergence": r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS MATERIALIZED (SELECT n, lang, source, term, count(*) AS c FROM (SELECT n, lang, source, unnest(terms) AS term FROM d) GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT n) >= 30),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT g.lang, g.source, k.term, coalesce(s.c, 0) AS c FROM g JOIN k ON k.lang = g.lang
  LEFT JOIN (SELECT lang, source, term, sum(c) AS c FROM t GROUP BY ALL) AS s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term),
w AS (SELECT *, sum(c) OVER (PARTITION BY lang, source) AS own, sum(c) OVER (PARTITION BY lang) AS whole, sum(c) OVER (PARTITION BY lang, term) AS together FROM c),
p AS MATERIALIZED (
  SELECT w.lang, source, term, c, CAST(1 + (1000000000 * CAST(c + 5 AS HUGEINT)) // (own + 5 * v) AS BIGINT) AS p, CAST(1 + (1000000000 * CAST(together + 5 AS HUGEINT)) // (whole + 5 * v) AS BIGINT) AS q
  FROM w JOIN v ON v.lang = w.lang),
o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.f, 0) AS BIGINT) AS value FROM g AS a JOIN g AS b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS other, sum(abs(a.p - b.p)) AS f FROM p AS a JOIN p AS b ON b.lang = a.lang AND b.term = a.term GROUP BY 1, 2, 3) AS x
    ON x.lang = a.lang AND x.source = a.source AND x.other = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM o QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 50
""",
    "op13_vector_codes": _lloyd_sql(),
}
