"""The registered queries over the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm import chat, contamination, fingerprints, html, lines, lm, mixing, near, toxicity, urls
from strandflow.llm.common import load

URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_classes(load(spark, sf_dir, "documents").select("doc_id", "text")).drop("k1", "k2")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(load(spark, sf_dir, "pages"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    turns = chat.canonical_turns(chat.records_of(rows.unionByName(more)))
    return chat.digest(chat.format_turns(turns))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(load(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = toxicity.train(*toxicity.training_sample(docs, load(spark, sf_dir, "labels")))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted",
                         "worst_sentence", "worst_score", "offending")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(load(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(load(spark, sf_dir, "pages"), URL_RULES)


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_line_dedup": op1_line_dedup,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_html_extraction": op3_html_extraction,
    "op4_chat_format": op4_chat_format,
    "op5_decontamination": op5_decontamination,
    "op6_fingerprints": op6_fingerprints,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_lm_score": op9_lm_score,
    "op10_url_filters": op10_url_filters,
}

ORACLES = {
    "op1_line_dedup": r"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS raw,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
t AS (SELECT doc_id, text, pos, raw, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM l),
f AS (SELECT line, length(line) AS n, min(struct_pack(doc_id := doc_id, pos := pos)) AS first FROM t WHERE line <> '' GROUP BY line),
h AS (SELECT line, first, n, m, 'p' AS kind, substr(line, 1, (m // 2)::INT) AS half FROM f, LATERAL (SELECT unnest([n, n - 1]) AS m) WHERE n >= 16
      UNION ALL
      SELECT line, first, n, m, 's', right(line, (m - m // 2)::INT) FROM f, LATERAL (SELECT unnest([n, n - 1]) AS m) WHERE n >= 16),
near AS (SELECT DISTINCT a.line FROM h a JOIN h b ON a.m = b.m AND a.kind = b.kind AND a.half = b.half
         WHERE b.first < a.first AND a.line <> b.line AND abs(a.n - b.n) <= 1 AND levenshtein(a.line, b.line) <= 1),
k AS (SELECT t.*, (t.line <> '' AND (near.line IS NOT NULL OR struct_pack(doc_id := t.doc_id, pos := t.pos) > f.first)) AS gone
      FROM t LEFT JOIN f ON t.line = f.line LEFT JOIN near ON t.line = near.line)
SELECT doc_id, CASE WHEN any_value(text) IS NULL THEN NULL ELSE coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') END AS text,
       count(*)::INT AS n_lines, (count(*) FILTER (gone))::INT AS n_dropped,
       coalesce(length(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone)), 0)::BIGINT AS n_chars
FROM k GROUP BY doc_id
""",
    "op4_chat_format": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
esc AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g') AS body,
         regexp_replace(replace(replace(role, chr(92), chr(92) || 's'), chr(10), chr(92) || 'n'),
                        '([<\[])(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g') AS head FROM rows)
SELECT conv_id, 'messages' AS layout, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(head) + length(body) + 24)::BIGINT AS formatted_chars
FROM esc GROUP BY conv_id
""",
    "op8_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM documents),
base AS (
  SELECT *, (('0x' || substr(md5('20:' || coalesce(doc_id::VARCHAR, '') || '|' || digest || '|' || coalesce(source, '') || '|' || (row_number() OVER (PARTITION BY doc_id, digest, source))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u,
         round(-2 * log2(greatest(size, 1)))::INT AS grade
  FROM sized),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source COLLATE "binary" ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
             3.0::DOUBLE * source_size AS cap FROM src),
f AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS total,
             coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS cap_before,
             sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM w),
l AS (SELECT *, (total - cap_before) / w_left AS level FROM f),
m AS (SELECT max(level) AS final FROM l WHERE level * w <= cap),
t AS (SELECT source, source_size, coalesce(least(cap, final * w), cap) AS target FROM l, m),
cls AS (SELECT b.source, grade, sum(size)::BIGINT AS words, any_value(t.target) AS target, pow(2.0::DOUBLE, grade / 8.0::DOUBLE) AS w
        FROM base b JOIN t ON b.source IS NOT DISTINCT FROM t.source GROUP BY b.source, grade),
lv AS (SELECT *, (target - 3.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY source ORDER BY grade DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / nullif(sum(w * words) OVER (PARTITION BY source ORDER BY grade DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level FROM cls),
ex AS (SELECT source, grade, least(coalesce(max(level) FILTER (level * w <= 3) OVER (PARTITION BY source) * w, 3.0::DOUBLE), 3.0::DOUBLE) AS expected FROM lv),
r AS (SELECT b.*, t.source_size, t.target, ex.expected FROM base b JOIN t ON b.source IS NOT DISTINCT FROM t.source
      JOIN ex ON ex.source IS NOT DISTINCT FROM b.source AND ex.grade = b.grade),
p AS (SELECT *, floor(expected)::BIGINT AS copies, expected - floor(expected) AS p FROM r),
q AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM p),
c AS (SELECT *, target - sum(copies * size) OVER (PARTITION BY source) AS rest,
             coalesce(sum(size) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size, u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM q),
x AS (SELECT *, CASE WHEN q IS NOT NULL AND earlier + size / 2 <= rest THEN 1 ELSE 0 END AS extra FROM c)
SELECT doc_id, source, size, source_size, target, copies, extra, ((copies + extra) * size)::BIGINT AS taken FROM x
""",
    "op9_lm_score": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
t AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT rid, w, lag(w) OVER k AS v, lag(w, 2) OVER k AS u FROM t WINDOW k AS (PARTITION BY rid ORDER BY i)),
o1 AS (SELECT rid, w, count(*) AS o FROM g GROUP BY ALL), c1 AS (SELECT w, sum(o) AS c FROM o1 GROUP BY ALL),
o2 AS (SELECT rid, v, w, count(*) AS o FROM g WHERE v IS NOT NULL GROUP BY ALL), c2 AS (SELECT v, w, sum(o) AS c FROM o2 GROUP BY ALL),
o3 AS (SELECT rid, u, v, w, count(*) AS o FROM g WHERE u IS NOT NULL GROUP BY ALL), c3 AS (SELECT u, v, w, sum(o) AS c FROM o3 GROUP BY ALL),
r1 AS (SELECT rid, w, (c - o)::DOUBLE AS n FROM o1 JOIN c1 USING (w)),
r2 AS (SELECT rid, v, w, (c - o)::DOUBLE AS n FROM o2 JOIN c2 USING (v, w)),
r3 AS (SELECT rid, u, v, w, (c - o)::DOUBLE AS n FROM o3 JOIN c3 USING (u, v, w)),
x AS (SELECT g.rid, g.u, g.v, r3.n AS n3, r2.n AS n2, r1.n AS n1, b2.n AS b2, b1.n AS b1 FROM g
      JOIN r1 ON r1.rid = g.rid AND r1.w = g.w LEFT JOIN r2 ON r2.rid = g.rid AND r2.v = g.v AND r2.w = g.w
      LEFT JOIN r3 ON r3.rid = g.rid AND r3.u = g.u AND r3.v = g.v AND r3.w = g.w
      LEFT JOIN r2 b2 ON b2.rid = g.rid AND b2.v = g.u AND b2.w = g.v LEFT JOIN r1 b1 ON b1.rid = g.rid AND b1.w = g.v),
s AS (SELECT x.rid, sum(CASE WHEN n3 > 0 THEN ln(n3) - ln(b2) ELSE CASE WHEN u IS NULL THEN 0 ELSE ln(0.4::DOUBLE) END
             + CASE WHEN n2 > 0 THEN ln(n2) - ln(b1) ELSE CASE WHEN v IS NULL THEN 0 ELSE ln(0.4::DOUBLE) END
             + CASE WHEN n1 > 0 THEN ln(n1) ELSE ln(0.4::DOUBLE) END - ln(greatest((SELECT count(*) FROM t) - len(ws), 1)::DOUBLE) END END) AS total
      FROM x JOIN d USING (rid) GROUP BY x.rid)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, round(coalesce(s.total, 0.0::DOUBLE), 6) AS log_score,
       CASE WHEN len(ws) > 0 THEN round(s.total / len(ws), 6) END AS mean_log_score
FROM d LEFT JOIN s ON d.rid = s.rid
""",
    "op10_url_filters": r"""
WITH RECURSIVE pg AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
tags AS (SELECT url AS a, regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0) AS link,
                regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0) AS meta FROM pg WHERE url IS NOT NULL),
found AS (SELECT a, regexp_extract(link, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1) AS t FROM tags
          UNION ALL SELECT a, regexp_extract(meta, '(?is)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1) FROM tags),
links AS (SELECT a, replace(CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN regexp_extract(a, '(?s)^(.*?:)//', 1) || t
                                 WHEN starts_with(t, '/') THEN regexp_extract(a, '(?s)^(.*?://[^/?#]*)', 1) || t END, '&amp;', '&') AS b FROM found WHERE t <> ''),
us AS (SELECT DISTINCT u FROM (SELECT url AS u FROM pg UNION ALL SELECT b FROM links) WHERE u IS NOT NULL),
bare AS (SELECT u, regexp_replace(u, '(?s)#.*$', '') AS bare, regexp_extract(u, '(?s)^.*?://(.*)$', 1) AS rest FROM us),
part AS (SELECT u, bare, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM bare),
named AS (SELECT *, CASE WHEN contains(bare, '://') THEN lower(regexp_extract(bare, '(?s)^(.*?)://', 1)) || '://' || host || CASE WHEN starts_with(tail, '/') THEN tail ELSE '/' || tail END ELSE bare END AS node
          FROM (SELECT *, regexp_extract(bare, '(?s)^.*?://[^/?#]*(.*)$', 1) AS tail FROM part)),
r AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                            ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS v(action, rhost, rpath)),
ruled AS (SELECT u, node, host, path, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(action, length(rhost || rpath)) AS action
          FROM named LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL),
e0 AS (SELECT DISTINCT x.node AS a, y.node AS b FROM links JOIN named x ON x.u = links.a JOIN named y ON y.u = links.b WHERE x.node <> y.node),
e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
reach AS (SELECT a AS x, b AS y FROM e UNION SELECT reach.x, e.b FROM reach JOIN e ON reach.y = e.a),
acts AS (SELECT node, min(action) AS action FROM ruled GROUP BY node),
alias AS (SELECT x AS node, CASE WHEN bool_or(action = 'allow') THEN 'allow' WHEN bool_or(action = 'block') THEN 'block' END AS alias FROM reach JOIN acts ON acts.node = y GROUP BY x)
SELECT page_id, url, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(action, alias, 'allow') AS verdict, action IS NULL AND alias IS NOT NULL AS by_alias
FROM pg LEFT JOIN ruled ON ruled.u = pg.url LEFT JOIN alias USING (node)
""",
}
