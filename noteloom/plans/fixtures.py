"""The retrieval model over the star-schema tables, and the same as SQL.

documents are pages (tags, related pages and links are derived from the ids),
embeddings are sections of concepts, conversations are pages with a heading a
turn, parts are symbols, events are freshness, hits and hook events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = "hashed-words-d64"
NOW = "2024-02-01 00:00:00"
QUERIES = ((1, "the and of error"), (2, "les des une rapport"), (3, "worthless bug and scum"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _doc(number) -> F.Column:
    return F.concat(F.lit("doc-"), number.cast("string"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    links = F.concat("text", F.lit(" [["), _doc(i * 7 % 1300), F.lit("|see]] [["), _doc(i * 3 + 1), F.lit("]]"))
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "documents").select(
        _doc(i).alias("name"),
        F.concat("source", F.lit("/"), _doc(i), F.lit(".md")).alias("path"),
        F.col("source").alias("category"),
        F.array("lang", F.concat(F.lit("t"), F.floor(i / 6).cast("string"))).alias("tags"),
        F.when(i % 5 == 0, F.array(F.concat(F.lit("[["), _doc(i + 2), F.lit("]]")))).otherwise(none).alias("related"),
        (i % 4 != 0).alias("has_header"),
        links.alias("content"),
        "text",
    )


PAGES_SQL = """
pg AS (
  SELECT 'doc-' || doc_id AS name, source AS category, [lang, 't' || CAST(floor(doc_id / 6) AS BIGINT)] AS tags,
         CASE WHEN doc_id % 5 = 0 THEN 'doc-' || (doc_id + 2) END AS related, doc_id % 4 <> 0 AS has_header, text,
         text || ' [[doc-' || (doc_id * 7 % 1300) || '|see]] [[doc-' || (doc_id * 3 + 1) || ']]' AS content
  FROM documents)"""

LINKS_SQL = PAGES_SQL + """,
lk AS (SELECT name, unnest(regexp_extract_all(content, '\\[\\[([^\\]|]+)(?:\\|[^\\]]+)?\\]\\]', 1)) AS target FROM pg),
le AS (SELECT DISTINCT name AS src, target AS dst FROM lk WHERE name <> target AND target IN (SELECT name FROM pg)),
fe AS (SELECT DISTINCT name AS src, related AS dst FROM pg WHERE related IN (SELECT name FROM pg)),
tg AS (SELECT DISTINCT name, unnest(tags) AS tag FROM pg),
tm AS (SELECT name, tag FROM tg WHERE tag IN (SELECT tag FROM tg GROUP BY tag HAVING count(*) BETWEEN 2 AND 16)),
te AS (SELECT a.name AS src, b.name AS dst, a.tag FROM tm a JOIN tm b ON a.tag = b.tag AND a.name < b.name),
ev AS (
  SELECT src, dst, 1 AS p, 'frontmatter' AS source FROM fe
  UNION ALL SELECT src, dst, 2, 'wikilink' FROM le
  UNION ALL SELECT src, dst, 3, 'tag:' || tag FROM te),
ed AS (
  SELECT a, b, CASE WHEN p < 3 THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence, source FROM (
    SELECT least(src, dst) AS a, greatest(src, dst) AS b, p, source,
           row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY p, source) AS r FROM ev)
  WHERE r = 1),
nb AS (SELECT a AS name, b AS neighbour FROM ed UNION ALL SELECT b, a FROM ed WHERE a <> b)"""

TFIDF_SQL = PAGES_SQL + """,
tk AS (
  SELECT name, unnest(regexp_extract_all(lower(name || ' ' || text || ' ' || array_to_string(tags, ' ')), '[\\p{L}\\p{N}_]+')) AS term FROM pg),
tf AS (SELECT name, term, count(*) AS tf FROM tk GROUP BY ALL),
mx AS (SELECT name, max(tf) AS most FROM tf GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
ix AS (
  SELECT term, name, CAST(tf AS DOUBLE) / most * ln((SELECT count(*) FROM pg) / CAST(1 + df AS DOUBLE)) AS weight
  FROM tf JOIN mx USING (name) JOIN df USING (term))"""

QUERIES_SQL = "qs(query_id, text) AS (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in QUERIES) + ")"

KEYWORD_SQL = TFIDF_SQL + f""",
{QUERIES_SQL},
qt AS (SELECT query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM qs),
ks AS (SELECT query_id, name, round(sum(weight), 3) AS score FROM qt JOIN ix USING (term) GROUP BY ALL),
kr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS INTEGER) AS rank FROM ks)"""


def queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERIES, "query_id int, text string")


def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose content is the document's text alone."""
    return pages(spark, sf_dir).withColumn("content", F.col("text"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("label-"), F.col("label").cast("string")).alias("concept"), F.col("vec_id").cast("string").alias("section"), F.col("embedding").alias("vec"), F.lit(MODEL).alias("model_version"), "vec_id"
    )


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


VECTOR_SQL = """
sc AS (SELECT vec_id, 'label-' || label AS concept, CAST(vec_id AS VARCHAR) AS section, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
vs AS (
  SELECT q.vec_id AS query_id, s.concept, s.section, round(list_cosine_similarity(q.v, s.v), 6) AS score
  FROM sc q JOIN sc s ON q.vec_id % 50 = 0),
vr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, concept, section) AS INTEGER) AS rank FROM vs)"""


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page a conversation; a turn is a heading (system level 2, user 3,
    assistant 4) and its text."""
    level = F.when(F.col("role") == "system", 2).when(F.col("role") == "user", 3).otherwise(4)
    part = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), "text")
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))).alias("ts"))
    return turns.select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("name"), F.array_join("ts.part", "\n").alias("content"))


CONVERSATION_SQL = """
tn AS (
  SELECT 'conv-' || conv_id AS name, turn, CASE role WHEN 'system' THEN 2 WHEN 'user' THEN 3 ELSE 4 END AS level, role || ' ' || turn AS section, role, text,
         CAST(coalesce(sum(2 + length(text) - length(replace(text, chr(10), ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS line
  FROM conversations),
tp AS (SELECT *, repeat('#', level) || ' ' || section || chr(10) || text AS part FROM tn),
en AS (SELECT a.name, a.turn, min(b.turn) AS stop FROM tp a LEFT JOIN tp b ON a.name = b.name AND b.turn > a.turn AND b.level <= a.level GROUP BY ALL),
ck AS (
  SELECT a.name, a.line, a.section, a.turn, a.level, a.role,
         regexp_replace(string_agg(b.part, chr(10) ORDER BY b.turn), '^\\s+|\\s+$', '', 'g') AS chunk
  FROM tp a JOIN en USING (name, turn) JOIN tp b ON b.name = a.name AND b.turn >= a.turn AND (en.stop IS NULL OR b.turn < en.stop)
  GROUP BY ALL)"""


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "class").when(F.col("p_size") % 3 == 1, "function").otherwise("method")
    camel = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    return p.select(
        F.col("p_partkey").alias("id"), F.lit("warehouse").alias("repo"), F.concat("p_brand", F.lit("::"), "p_name").alias("qualified_name"), camel.alias("short_name"), kind.alias("symbol_type"),
        F.concat(F.lower("p_brand"), F.lit("/"), F.lower("p_type"), F.lit(".py")).alias("file_path"), F.col("p_size").alias("lineno"), F.concat("p_type", F.lit(" "), "p_name").alias("docstring"), "p_name",
    )


SYMBOLS_SQL = """
sy AS (
  SELECT p_partkey AS id, 'warehouse' AS repo, p_brand || '::' || p_name AS qualified_name, p_name,
         array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '') AS short_name,
         CASE p_size % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'function' ELSE 'method' END AS symbol_type,
         lower(p_brand) || '/' || lower(p_type) || '.py' AS file_path, p_size AS lineno, p_type || ' ' || p_name AS docstring
  FROM part),
wa AS (SELECT id, unnest(list_distinct(string_split(p_name, ' '))) AS w, len(list_distinct(string_split(p_name, ' '))) AS n FROM sy),
wb AS (SELECT concept, unnest(list_distinct(string_split(concept, ' '))) AS w, len(list_distinct(string_split(concept, ' '))) AS n FROM (SELECT DISTINCT p_name AS concept FROM sy)),
nm AS (
  SELECT id AS symbol_id, concept, 'name_match' AS link_type, round(greatest(s / na, s / nb), 6) AS score FROM (
    SELECT a.id, b.concept, CAST(count(*) AS DOUBLE) AS s, any_value(a.n) AS na, any_value(b.n) AS nb
    FROM wa a JOIN wb b ON a.w = b.w WHERE length(a.w) >= 3 GROUP BY ALL)
  WHERE greatest(s / na, s / nb) >= 0.5),
kn AS (
  SELECT p.id AS symbol_id, s.concept, s.section, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), s.v) AS score
  FROM sy p JOIN embeddings e ON e.vec_id = p.id JOIN (SELECT 'label-' || label AS concept, vec_id AS section, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) s ON e.vec_id % 50 = 0 AND s.section <> e.vec_id),
k30 AS (SELECT * FROM kn QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY round(score, 6) DESC, concept, CAST(section AS VARCHAR)) <= 30),
em AS (
  SELECT symbol_id, concept, 'embedding_match' AS link_type, round(score, 6) AS score FROM (
    SELECT symbol_id, concept, max(round(score, 6)) AS score FROM k30 GROUP BY ALL) WHERE score >= 0.3
  QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY score DESC, concept) <= 3),
ml AS (
  SELECT symbol_id, concept, link_type, score FROM (SELECT * FROM nm UNION ALL SELECT * FROM em)
  QUALIFY row_number() OVER (PARTITION BY symbol_id, concept ORDER BY score DESC, CASE link_type WHEN 'name_match' THEN 0 ELSE 1 END) = 1)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session"), F.col("event_type").alias("kind"), "ts", "value")


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freshness: a section an event, of the concept of its user."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("doc-"), F.col("user_id").cast("string")).alias("concept"), F.col("event_type").alias("category"), F.col("ts").cast("timestamp").alias("content_changed_at"), F.lit(MODEL).alias("model_version")
    )


RECENCY_SQL = """
rs AS (SELECT 'doc-' || user_id AS concept, max(event_type) AS category, max(ts) AS changed_at FROM events GROUP BY ALL)"""
