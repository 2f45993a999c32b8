"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.llm import bpe, fill_in_middle, html_text, langid, line_dedup, merkle, minhash, packing, personal_data, simhash, token_counts, topk, url_filter
from turnweave.llm.common import read

URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=5, scale=256, every=50)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.with_near(simhash.edited_fingerprints(read(spark, sf_dir, "documents")))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.token_digests(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = langid.crc_held_out()
    filters = langid.learn_filters(documents, held_out)
    predicted = langid.predict_languages(documents, filters)
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read(spark, sf_dir, "pages").select("page_id", "html"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), words=3, percent=85)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return packing.pack_documents(documents, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=2048)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(documents).select("doc_id", "text", "n_lines", "n_deleted")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(read(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = fill_in_middle.transform(read(spark, sf_dir, "documents"), seed=42, percent=50, spm_percent=80)
    back = fill_in_middle.restore(there)
    digests = [F.sha2(x, 256).alias(f"{x}_sha256") for x in ("output", "restored")]
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.span_digests(read(spark, sf_dir, "documents"))


_ALL = (
    op1_url_filter,
    op2_top_k,
    op3_simhash,
    op4_byte_bpe,
    op5_token_counts,
    op6_language_id,
    op7_html_text,
    op8_near_duplicates,
    op9_packing,
    op10_line_dedup,
    op11_merkle,
    op12_fill_in_middle,
    op13_personal_data,
)
QUERIES = {query.__name__: query for query in _ALL}

SQL = {
    "op1_url_filter": """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id,
    translate(CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, 1, strpos(rest, '/') - 1) ELSE rest END,
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path
  FROM cut),
rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host) DESC, length(r.path) DESC) AS place
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND f.place = 1
""",
    "op2_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op11_merkle": r"""
WITH RECURSIVE
ids AS (
  SELECT *, doc_id::VARCHAR AS i FROM documents),
fields AS (
  SELECT *, coalesce(strlen(i)::VARCHAR || ':' || i, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-')
      || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS head,
    replace(text, chr(10), '') AS cut,
    -- CRC-32, a bit at a time: steps 0, 8, 16 ... take in a character.
    coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, range(0, 8 * length(i))), lambda c, k:
      xor(xor(c, CASE WHEN k % 8 = 0 THEN ascii(i[k // 8 + 1])::BIGINT ELSE 0 END) >> 1,
          CASE WHEN xor(c, CASE WHEN k % 8 = 0 THEN ascii(i[k // 8 + 1])::BIGINT ELSE 0 END) % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END)),
      4294967295::BIGINT) % 2 = 0, false) AS hit
  FROM ids),
leaves AS (
  SELECT row_number() OVER () AS r, doc_id, source, sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
    CASE WHEN hit THEN sha256(head || coalesce(strlen(cut)::VARCHAR || ':' || cut, '-')) ELSE sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) END AS claimed
  FROM fields),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM leaves),
up(source, level, place, digest, n) AS (
  SELECT source, 0::BIGINT, place, leaf, n FROM placed
  UNION ALL
  SELECT source, level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (any_value(n) + 2) // 3
  FROM up WHERE n > 1 GROUP BY source, level, place // 3),
subroots AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM up WHERE n = 1),
top(level, place, digest, n) AS (
  SELECT 0::BIGINT, place, subroot, n FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (any_value(n) + 2) // 3
  FROM top WHERE n > 1 GROUP BY level, place // 3),
-- Siblings of each node, as texts left and right of it.
low AS (
  SELECT a.source, a.level, a.place, string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place) AS l, string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place) AS r
  FROM up a JOIN up b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.place // 3 = b.place // 3 WHERE a.n > 1 GROUP BY ALL),
high AS (
  SELECT a.level, a.place, string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place) AS l, string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place) AS r
  FROM top a JOIN top b ON a.level = b.level AND a.place // 3 = b.place // 3 WHERE a.n > 1 GROUP BY ALL),
climb(row, source, level, place, folded, siblings) AS (
  SELECT r, source, 0::BIGINT, place, claimed, '' FROM placed
  UNION ALL
  SELECT c.row, c.source, c.level + 1, c.place // 3, sha256(coalesce(s.l, '') || c.folded || coalesce(s.r, '')), c.siblings || coalesce(s.l, '') || coalesce(s.r, '')
  FROM climb c JOIN low s ON c.source IS NOT DISTINCT FROM s.source AND c.level = s.level AND c.place = s.place),
half AS (
  SELECT row, source, arg_max(folded, level) AS folded, arg_max(siblings, level) AS siblings FROM climb GROUP BY row, source),
climb_top(row, level, place, folded, siblings) AS (
  SELECT h.row, 0::BIGINT, s.place, h.folded, h.siblings FROM half h JOIN subroots s ON h.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT c.row, c.level + 1, c.place // 3, sha256(coalesce(s.l, '') || c.folded || coalesce(s.r, '')), c.siblings || coalesce(s.l, '') || coalesce(s.r, '')
  FROM climb_top c JOIN high s ON c.level = s.level AND c.place = s.place),
whole AS (
  SELECT row, arg_max(folded, level) AS folded, arg_max(siblings, level) AS siblings FROM climb_top GROUP BY row)
SELECT p.doc_id, p.leaf, s.subroot, t.digest AS root, sha256(w.siblings) AS proof_sha256, w.folded AS folded_root, w.folded = t.digest AS verified
FROM placed p JOIN whole w ON p.r = w.row JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source JOIN top t ON t.n = 1
""",
    "op12_fill_in_middle": r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
drawn AS (
  SELECT *, len(units)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
         WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (
  SELECT *, array_to_string(units[1:least(a, b)], '') AS p, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS m,
    array_to_string(units[greatest(a, b) + 1:], '') AS s FROM drawn),
made AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM parts),
found AS (
  SELECT *, strpos(output, '<P>') AS at_p, strpos(output, '<S>') AS at_s, strpos(output, '<M>') AS at_m FROM made)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN substr(output, 4, at_s - 4) || substr(output, at_m + 3) || substr(output, at_s + 3, at_m - at_s - 3)
    ELSE substr(output, at_p + 3, at_m - at_p - 3) || substr(output, at_m + 3) || substr(output, 4, at_p - 4) END) AS restored_sha256
FROM found
""",
}
