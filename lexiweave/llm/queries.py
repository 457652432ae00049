"""The operators of this subpackage as queries: each takes (spark, sf_dir) and covers its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweave.llm import decontam, embed, hmm, langid, license, quality, sentencepiece, simhash, substring, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents)
), runs AS (
  SELECT doc_id, pos, word,
         count(*) OVER w AS n, string_agg(word, ' ') OVER w AS run
  FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), late AS (
  SELECT doc_id, pos, word,
         CASE WHEN n = 20 AND row_number() OVER (PARTITION BY n, run ORDER BY doc_id, pos) > 1 THEN 1 ELSE 0 END AS late
  FROM runs
), covered AS (
  SELECT doc_id, pos, word,
         max(late) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM late
), kept AS (
  SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed,
         string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0) AS kept
  FROM covered GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def _op3_sql() -> str:
    """The rules as rows, and the same scan without the keywords' gate on whole texts."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rules = ", ".join(f"({n}, {quoted(label)}, {quoted('  '.join(k.split()))}, {p}, {quoted(pattern)})" for n, label, k, p, pattern in license.rules())
    phrases = ", ".join(f"({quoted(phrase.split()[0])}, {quoted(phrase.split()[1])}, {quoted(' '.join(phrase.split()[2:]))}, {quoted(label)})" for phrase, label in license.BASE.items())
    sure = " ".join(f"WHEN {p} THEN {c}" for p, c in license.CONFIDENCE.items())
    return rf"""
WITH lists AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
), words AS (
  SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) - 1 AS pos FROM lists
), triples AS (
  SELECT doc_id, pos, a, lead(a) OVER w AS b, lead(a, 2) OVER w AS c FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), phrases(a, b, c, label) AS (VALUES {phrases}), base AS (
  SELECT doc_id, count(*) AS n, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels
  FROM triples t JOIN phrases p ON t.a = p.a AND t.b = p.b AND (p.c = '' OR t.c = p.c) GROUP BY doc_id
), norms AS (
  SELECT doc_id, '  ' || array_to_string(ws, '  ') || '  ' AS w FROM lists
), rules(rule, label, keyword, priority, pattern) AS (VALUES {rules}), met AS (
  SELECT doc_id, rule, label, priority, substr(w, 2, length(w) - 2) AS w, pattern FROM norms JOIN rules ON contains(w, ' ' || keyword || ' ')
), cut AS (
  SELECT doc_id, rule, label, priority, unnest(regexp_extract_all(w, pattern)) AS hit, unnest(string_split_regex(w, pattern)) AS gap, generate_subscripts(string_split_regex(w, pattern), 1) AS k FROM met
), sized AS (
  SELECT doc_id, rule, label, priority, k, (length(gap) - length(replace(gap, ' ', ''))) // 2 AS before, (length(hit) - length(replace(hit, ' ', ''))) // 2 AS n FROM cut WHERE hit IS NOT NULL
), spans AS (
  SELECT doc_id, rule, label, priority, sum(before + n) OVER (PARTITION BY doc_id, rule ORDER BY k) - n AS s, sum(before + n) OVER (PARTITION BY doc_id, rule ORDER BY k) AS e FROM sized
), stand AS (
  SELECT * FROM spans x WHERE NOT EXISTS (
    SELECT 1 FROM spans y WHERE y.doc_id = x.doc_id AND y.s <= x.s AND y.e >= x.e AND y.priority >= x.priority
      AND (y.s < x.s OR y.e > x.e OR y.priority > x.priority OR y.rule < x.rule))
), found AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(CASE priority {sure} END) AS sure FROM stand GROUP BY doc_id
)
SELECT l.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ',') AS labels,
       CAST(CASE WHEN n > 0 THEN 1 ELSE coalesce(sure, 0) END AS DOUBLE) AS score
FROM lists l LEFT JOIN base b USING (doc_id) LEFT JOIN found f USING (doc_id)
"""


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sentencepiece.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = F.coalesce("decoded", F.lit("")) == F.replace(F.coalesce("text", F.lit("")), F.lit(sentencepiece.SPACE), F.lit(" "))
    return done.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"), back.alias("round_trip"))


#: Host, path and verdict of the listed rules.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


OP5_SQL = r"""
WITH rests AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM rests
), parts AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM hosts
), rules(h, p, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), best AS (
  SELECT page_id, arg_max(h || p, length(h) + length(p)) AS rule, arg_max(v, length(h) + length(p)) AS v
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)
"""


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP6_SQL = r"""
WITH ws AS (
  SELECT 'd' AS kind, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), lists AS (
  SELECT kind, id, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM ws
), words AS (
  SELECT kind, id, len(ws) AS total, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM lists
), sizes AS (
  SELECT DISTINCT least(10, total) AS size FROM words WHERE kind = 'b'
), runs AS (
  SELECT kind, id, pos, total, size,
         array_to_string(list(word) OVER (PARTITION BY kind, id, size ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)[1:size], ' ') AS run
  FROM words, sizes
), patterns AS (
  SELECT DISTINCT id AS item, size, run FROM runs WHERE kind = 'b' AND size = least(10, total) AND pos + size - 1 <= total
), hits AS (
  SELECT r.id, r.pos, r.size, p.item FROM runs r JOIN patterns p USING (size, run) WHERE r.kind = 'd' AND r.pos + r.size - 1 <= r.total
), hit_words AS (
  SELECT id, count(DISTINCT w) AS n_hit FROM (SELECT id, unnest(range(pos, pos + size)) AS w FROM hits) GROUP BY id
), items AS (
  SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT id, CAST(item AS VARCHAR) AS item FROM hits) GROUP BY id
)
SELECT l.id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lists l LEFT JOIN hit_words h ON h.id = l.id LEFT JOIN items i ON i.id = l.id WHERE l.kind = 'd'
"""


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(table(spark, sf_dir, "embeddings"))


OP10_SQL = r"""
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), named AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), counts AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM named LEFT JOIN counts USING (vec_id)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_simhash_near_dedup, op2_substring_dedup, op3_license_scan, op4_sentencepiece, op5_url_filter, op6_benchmark_decontamination, op7_quality_classifier, op8_lm_scoring, op9_language_id, op10_embedding_near_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": OP2_SQL, "op3_license_scan": _op3_sql(), "op5_url_filter": OP5_SQL, "op6_benchmark_decontamination": OP6_SQL, "op10_embedding_near_dedup": OP10_SQL}
