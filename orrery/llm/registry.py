"""The queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from orrery.llm import collocations, decontaminate, html_extract, language_id, line_dedup, near_dup, pii, sentencepiece_codec, sharding, token_align, toxicity, transport_stream, url_filter
from orrery.llm.common import table

#: The rules that every page's URL is judged by.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encoded_and_back(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 16)


def op5_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(line_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.passages_report(line_dedup.remove_passages(table(spark, sf_dir, "documents")))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.stored_and_read(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark, URL_RULES))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.alignment_report(table(spark, sf_dir, "documents"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sentencepiece, op2_decontaminate, op3_html, op4_shards, op5_repeated_lines, op5_repeated_passages, op6_near_duplicates, op7_media, op8_toxicity, op9_url_rules, op10_personal_data, op11_token_alignment, op12_language, op13_collocations, pipeline)
}

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS} AS w FROM benchmark),
starts AS (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS win FROM starts),
lens AS (SELECT DISTINCT m FROM win),
spots AS (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, lens WHERE len(w) >= m),
dw AS (SELECT rid, m, s, array_to_string(w[s : s + m - 1], ' ') AS win FROM spots),
hit AS (SELECT rid, m, s, item FROM dw JOIN win USING (m, win)),
pos AS (SELECT DISTINCT rid, unnest(range(s, s + m)) AS p FROM hit),
n AS (SELECT rid, count(*) AS n_hit FROM pos GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN it USING (rid)""",
    "op5_repeated_lines": r"""
WITH d AS (SELECT doc_id, text, sha256(text) AS digest, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, list_transform(lines, lambda x: CAST('0x' || substr(md5(x), 1, 7) AS BIGINT)) AS h FROM (SELECT DISTINCT * FROM d)),
c AS (
  SELECT doc_id, digest, lines, list_filter(range(1, len(lines) + 1), lambda i: i = len(lines)
    OR ((CASE WHEN i > 1 THEN h[i - 1] ELSE 0 END % 2147483647 * 1000003 + h[i]) % 2147483647) % 3 = 0) AS ends
  FROM h),
k AS (SELECT doc_id, digest, lines, ends, unnest(range(1, len(ends) + 1)) AS k FROM c),
p AS (SELECT doc_id, digest, k, CASE WHEN k = 1 THEN 1 ELSE ends[k - 1] + 1 END AS s, ends[k] AS e, lines FROM k),
t AS (SELECT doc_id, digest, s, e - s + 1 AS n, array_to_string(lines[s : e], chr(10)) AS t FROM p),
r AS (SELECT *, (n > 1 AND regexp_matches(t, '\S') AND row_number() OVER (PARTITION BY t, n > 1 ORDER BY doc_id NULLS LAST, digest, s) > 1) AS gone FROM t),
o AS (
  SELECT doc_id, digest, sum(n) AS n_lines, coalesce(sum(n) FILTER (gone), 0) AS n_removed, count(*) FILTER (gone) AS n_chunks_removed,
         coalesce(string_agg(t, chr(10) ORDER BY s) FILTER (NOT gone), '') AS text
  FROM r GROUP BY ALL)
SELECT d.doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_chunks_removed AS BIGINT) AS n_chunks_removed,
       sha256(o.text) AS text_sha256, o.text
FROM d JOIN o ON d.doc_id IS NOT DISTINCT FROM o.doc_id AND d.digest = o.digest
UNION ALL SELECT doc_id, 0, 0, 0, NULL, NULL FROM documents WHERE text IS NULL""",
    "op6_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
spots AS (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS s FROM w WHERE len(w) > 0),
e AS (SELECT DISTINCT rid, array_to_string(w[s : s + 3], ' ') AS e FROM spots),
n AS (SELECT rid, count(*) AS n FROM e GROUP BY rid),
shared AS (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM e x JOIN e y ON x.e = y.e AND x.rid < y.rid GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT rid, rid FROM w UNION SELECT reach.a, sides.b FROM reach JOIN sides ON sides.a = reach.b),
least AS (SELECT reach.a AS rid, min(doc_id) AS component_id FROM reach JOIN w ON w.rid = reach.b GROUP BY reach.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM w JOIN least USING (rid) LEFT JOIN n USING (rid)""",
    "op9_url_rules": r"""
WITH parts AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
u AS (
  SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*(/[^?#]*)', 1) AS path FROM parts),
r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (
  SELECT page_id, host, path, max_by(struct_pack(rule := h || p, v := v), length(h || p)) AS b
  FROM (SELECT DISTINCT page_id, host, path FROM u) JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY ALL)
SELECT u.page_id, u.host, u.path, b.rule AS rule, coalesce(b.v, 'allow') AS verdict
FROM u LEFT JOIN best USING (page_id, host, path)""",
    "op13_collocations": rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOW}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS s FROM w),
runs AS (SELECT lang, s, w, unnest(range(1, least(4, len(w) - s + 1) + 1)) AS k FROM starts),
f AS (SELECT lang, w[s : s + k - 1] AS w, k, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, w, k, f AS a, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
scored AS (
  SELECT c.lang, c.w, c.k, c.a, c.cut, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f) AS BIGINT) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.w = c.w[1 : c.cut] JOIN f y ON y.lang = c.lang AND y.w = c.w[c.cut + 1 : c.k]),
least_cut AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, cut) = 1),
inner_parts AS (
  SELECT lang, w[s : s + k2 - 1] AS w, a AS longer FROM (
    SELECT lang, w, k, f AS a, k2, unnest(range(1, k - k2 + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS k2 FROM f WHERE k > 2))),
within AS (SELECT lang, w, max(longer) AS longer FROM inner_parts GROUP BY ALL),
stays AS (SELECT t.* FROM least_cut t LEFT JOIN within i ON i.lang = t.lang AND i.w = t.w WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * t.a),
ranked AS (SELECT *, array_to_string(w, ' ') AS phrase FROM stays)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score
FROM ranked JOIN total USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000""",
}
