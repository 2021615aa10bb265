"""Registered queries of the retrieval engine, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteloom.functions import scoring, text
from noteloom.operators import codegraph, graph, index, moments, ranking, recall, sections, vectors
from noteloom.plans import fixtures as fx
from noteloom.sources import pages as page_source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# -- text ---------------------------------------------------------------------

_CJK_SAMPLES = ((1, "caché 設計文件ab說 x_1"), (2, "知識圖譜 graph"), (3, "a"), (4, ""))


@query("""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM documents)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_tokens, CAST(count(DISTINCT term) AS BIGINT) AS n_terms FROM t GROUP BY doc_id""")
def tokenize(spark, sf_dir):
    terms = fx.table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    return terms.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


@query("""
WITH s AS (SELECT doc_id AS id, ['caché 設計文件ab說 x_1', '知識圖譜 graph', 'a', ''][doc_id % 4 + 1] || ' ' || lang AS x FROM documents),
w AS (SELECT id, unnest(regexp_extract_all(lower(x), '[\\p{L}\\p{N}_]+')) AS t FROM s),
c AS (SELECT id, t, regexp_replace(t, '[^\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}]', '', 'g') AS c FROM w)
SELECT id, t AS token FROM c UNION ALL SELECT id, unnest(list_transform(range(1, length(c)), lambda i: substr(c, i, 2))) FROM c WHERE length(c) > 1""")
def tokenize_cjk(spark, sf_dir):
    sample = F.element_at(F.array(*(F.lit(x) for _, x in _CJK_SAMPLES)), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat_ws(" ", sample, "lang").alias("x"))
    return rows.select("id", F.explode(text.tokens(F.col("x"))).alias("token"))


@query("WITH " + fx.TFIDF_SQL + " SELECT term, name, round(weight, 6) AS weight FROM ix")
def tfidf_index(spark, sf_dir):
    return index.postings(fx.search_pages(spark, sf_dir)).select("term", "name", F.round("weight", 6).alias("weight"))


_SNIPPET = "coalesce(regexp_replace(list_filter(string_split({0}, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '' AND NOT starts_with(x, '#') AND NOT starts_with(x, '---'))[1], '^\\s+|\\s+$', '', 'g')[:200], '')"


@query("WITH " + fx.KEYWORD_SQL + " SELECT query_id, rank, kr.name, category, score, " + _SNIPPET.format("text") + " AS snippet FROM kr JOIN pg USING (name) WHERE rank <= 10")
def keyword_search(spark, sf_dir):
    pages, asked = fx.search_pages(spark, sf_dir), fx.queries(spark)
    return index.keyword_search(index.postings(pages, asked), pages, asked)


@query("SELECT doc_id, " + _SNIPPET.format("text") + " AS snippet FROM documents")
def snippet(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query("SELECT doc_id, sha256(text) AS content_hash, left(sha1(text), 16) AS file_hash FROM documents")
def content_hash(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), text.file_hash(F.col("text")).alias("file_hash"))


_CLEAN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '<system-reminder>.*?</system-reminder>', ' ', 'gs'), '<command-(?:name|message|args)>.*?</command-(?:name|message|args)>', ' ', 'gs'), '</?(?:channel|pasted_content)\\b[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


@query("WITH c AS (SELECT conv_id, turn, " + _CLEAN.format("'<channel a=1>' || text || '</channel><system-reminder>' || role || '</system-reminder>'") + " AS cleaned FROM conversations) SELECT conv_id, turn, cleaned, length(cleaned) >= 12 AND NOT starts_with(cleaned, '/') AS passes FROM c")
def clean_prompt(spark, sf_dir):
    raw = F.concat(F.lit("<channel a=1>"), "text", F.lit("</channel><system-reminder>"), "role", F.lit("</system-reminder>"))
    rows = fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.clean_prompt(raw).alias("cleaned"))
    return rows.withColumn("passes", text.prompt_passes(F.col("cleaned")))


_COMMANDS = ("git commit -m \"x\"", "git -C /a push origin", "docker compose -f a.yml up -d", "kubectl apply -f x", "ls deployment", "./deploy now", "git log", "docker-compose down; echo up")


@query("WITH c AS (SELECT conv_id, turn, [" + ", ".join(f"'{c}'" for c in _COMMANDS) + """][(conv_id + turn) % 8 + 1] || ' # ' || role AS cmd FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(cmd, '\\bgit\\s+(?:-C\\s+\\S+\\s+)?commit\\b') THEN 'commit' WHEN regexp_matches(cmd, '\\bgit\\s+(?:-C\\s+\\S+\\s+)?push\\b') THEN 'push'
  WHEN regexp_matches(cmd, 'docker[\\s-]compose\\b[^|;&]*\\bup\\b|\\bkubectl\\s+apply\\b|\\bdeploy\\b') THEN 'deploy' END AS kind FROM c""")
def decision_kind(spark, sf_dir):
    command = F.concat(F.element_at(F.array(*(F.lit(c) for c in _COMMANDS)), ((F.col("conv_id") + F.col("turn")) % 8 + 1).cast("int")), F.lit(" # "), "role")
    return fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.decision_kind(command).alias("kind"))


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace('## ' || lang || chr(10) || text, '^#+\\s[^\\n]*\\n', ''), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')[:180] AS snippet FROM documents")
def recall_snippet(spark, sf_dir):
    chunk = F.concat(F.lit("## "), "lang", F.lit("\n"), "text")
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.recall_snippet(chunk).alias("snippet"))


@query("SELECT c_custkey, coalesce(nullif(regexp_replace(c_name || '/é ' || c_custkey, '[^A-Za-z0-9_-]', '_', 'g')[:80], ''), 'unknown') AS session FROM customer")
def safe_session(spark, sf_dir):
    named = F.concat("c_name", F.lit("/é "), F.col("c_custkey").cast("string"))
    return fx.table(spark, sf_dir, "customer").select("c_custkey", text.safe_session(named).alias("session"))


@query("SELECT doc_id, source AS category FROM documents")
def path_category(spark, sf_dir):
    path = F.concat(F.lit("a/b/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.path_category(path).alias("category"))


@query("SELECT p_partkey, w AS token FROM (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS w FROM part) WHERE length(w) >= 3")
def name_tokens(spark, sf_dir):
    return fx.symbols(spark, sf_dir).select(F.col("id").alias("p_partkey"), F.explode(text.name_tokens(F.concat("short_name", F.lit("-v2.1")))).alias("token"))


# -- graph --------------------------------------------------------------------


@query("WITH " + fx.LINKS_SQL + " SELECT name, target, CAST(count(*) AS BIGINT) AS n FROM lk GROUP BY ALL")
def wikilinks(spark, sf_dir):
    found = fx.pages(spark, sf_dir).select("name", F.explode(text.wikilinks(F.col("content"))).alias("target"))
    return found.groupBy("name", "target").agg(F.count("*").alias("n"))


@query("WITH " + fx.LINKS_SQL + " SELECT src, dst FROM le")
def link_edges(spark, sf_dir):
    return graph.link_edges(fx.pages(spark, sf_dir))


@query("WITH " + fx.LINKS_SQL + " SELECT name, target FROM lk WHERE target NOT IN (SELECT name FROM pg)")
def broken_links(spark, sf_dir):
    return graph.broken_links(fx.pages(spark, sf_dir))


@query("WITH " + fx.LINKS_SQL + " SELECT src, dst, tag FROM te")
def tag_edges(spark, sf_dir):
    return graph.tag_edges(fx.pages(spark, sf_dir))


@query("WITH " + fx.LINKS_SQL + " SELECT a, b, confidence, source FROM ed")
def graph_edges(spark, sf_dir):
    return graph.graph_edges(fx.pages(spark, sf_dir))


@query("WITH " + fx.LINKS_SQL + " SELECT name, neighbour FROM nb")
def neighbors(spark, sf_dir):
    return graph.neighbours(graph.graph_edges(fx.pages(spark, sf_dir)))


@query("WITH " + fx.LINKS_SQL + " SELECT name FROM pg WHERE name NOT IN (SELECT src FROM fe UNION SELECT dst FROM fe)")
def orphans(spark, sf_dir):
    pages = fx.pages(spark, sf_dir)
    return graph.orphans(pages, graph.frontmatter_edges(pages).toDF("a", "b"))


@query("WITH " + fx.LINKS_SQL + """, bl AS (SELECT 'broken_link' AS kind, name || ' -> ' || target AS name FROM lk WHERE target NOT IN (SELECT name FROM pg)
  UNION ALL SELECT 'no_header', name FROM pg WHERE NOT has_header
  UNION ALL SELECT 'orphan', name FROM pg WHERE name NOT IN (SELECT src FROM fe UNION SELECT dst FROM fe)),
nr AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY name) AS r, count(*) OVER (PARTITION BY kind) AS n FROM bl)
SELECT kind, n, string_agg(name, '|' ORDER BY name) AS names FROM nr WHERE r <= 100 GROUP BY kind, n""")
def diagnostic_lists(spark, sf_dir):
    pages = fx.pages(spark, sf_dir)
    found = graph.diagnostic_lists(pages, graph.frontmatter_edges(pages).toDF("a", "b"))
    return found.select("kind", "n", F.array_join("names", "|").alias("names"))


@query("WITH " + fx.LINKS_SQL + """, n AS (SELECT count(*) AS n FROM pg), e AS (SELECT count(*) AS m, count(*) FILTER (confidence = 'EXTRACTED') AS x, count(*) FILTER (confidence = 'INFERRED') AS i FROM ed)
SELECT n AS pages, m AS edges, x AS extracted, i AS inferred, CASE WHEN n > 1 THEN round(2.0::DOUBLE * m / (n * (n - 1)), 4) ELSE 0.0::DOUBLE END AS density FROM n, e""")
def graph_stats(spark, sf_dir):
    pages = fx.pages(spark, sf_dir)
    return graph.graph_stats(pages, graph.graph_edges(pages))


@query("SELECT source AS category, count(*) AS pages FROM documents GROUP BY ALL")
def category_counts(spark, sf_dir):
    return graph.category_counts(fx.pages(spark, sf_dir))


@query("WITH " + fx.LINKS_SQL + """ SELECT (SELECT count(*) FROM pg WHERE name NOT IN (SELECT name FROM nb)) AS orphans,
 (SELECT count(*) FROM lk WHERE target NOT IN (SELECT name FROM pg)) AS broken_links, (SELECT count(*) FROM pg WHERE NOT has_header) AS no_header""")
def diagnostics(spark, sf_dir):
    pages = fx.pages(spark, sf_dir)
    return graph.diagnostics(pages, graph.graph_edges(pages))


_ASKED = ("small ring", "RING", "a very hot gear indeed", "nothing at all")


@query("WITH a(asked) AS (VALUES " + ", ".join(f"('{a}')" for a in _ASKED) + """), n AS (SELECT DISTINCT p_name AS name FROM part)
SELECT asked, coalesce((SELECT name FROM n WHERE name = asked), (SELECT min(name) FROM n WHERE contains(lower(name), lower(asked)) OR contains(lower(asked), lower(name)))) AS name FROM a""")
def concept_lookup(spark, sf_dir):
    names = fx.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    return graph.concept_lookup(names, spark.createDataFrame([(a,) for a in _ASKED], "asked string"))


# -- sections -----------------------------------------------------------------


@query("WITH " + fx.CONVERSATION_SQL + " SELECT name, line, section, CAST(1 AS INTEGER) AS occurrence, chunk, sha256(chunk) AS content_hash FROM ck")
def chunk_sections(spark, sf_dir):
    return sections.chunk_sections(fx.conversation_pages(spark, sf_dir))


@query("WITH " + fx.CONVERSATION_SQL + " SELECT name, line, section, level, name || '#' || section AS address FROM tn")
def section_outline(spark, sf_dir):
    return sections.outline(fx.conversation_pages(spark, sf_dir))


@query("WITH " + fx.CONVERSATION_SQL + """ SELECT name, 'ASSISTANT' AS asked, section, level, chunk AS content FROM ck WHERE role = 'assistant'
QUALIFY row_number() OVER (PARTITION BY name ORDER BY turn) = 1""")
def section_read(spark, sf_dir):
    pages = fx.conversation_pages(spark, sf_dir)
    return sections.section_read(pages, pages.select("name", F.lit("ASSISTANT").alias("asked")))


_SYNC_SQL = """
o AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h, source AS cat,
        TIMESTAMP '2024-01-01' AS up, CASE WHEN doc_id % 11 <> 0 THEN TIMESTAMP '2024-01-01' END AS ch FROM documents WHERE doc_id % 10 <> 0),
n AS (SELECT doc_id, sha256(text) AS h, CASE WHEN doc_id % 13 <> 0 THEN lang END AS cat, TIMESTAMP '2023-12-01' AS mt FROM documents WHERE doc_id % 9 <> 0),
b AS (
  SELECT doc_id, CASE WHEN n.h IS NULL THEN 'keep' WHEN o.h IS NULL THEN 'insert' WHEN o.h = n.h THEN 'touch' ELSE 'update' END AS action,
         coalesce(n.h, o.h) AS content_hash, o.cat AS oc, n.cat AS nc, o.up, o.ch, n.mt, n.h IS NOT NULL AS seen FROM o FULL JOIN n USING (doc_id)),
s AS (
  SELECT 'doc-' || doc_id AS concept, content_hash, CASE WHEN action = 'update' THEN nc ELSE coalesce(nc, oc) END AS category,
         CASE WHEN seen THEN TIMESTAMP '2024-02-01' ELSE up END AS updated_at,
         CASE WHEN action IN ('insert', 'update') THEN TIMESTAMP '2024-02-01' WHEN action = 'touch' THEN coalesce(ch, mt) ELSE ch END AS content_changed_at, action FROM b)"""
_SYNC_OUT = "concept, content_hash, category, CAST(updated_at AS VARCHAR) AS updated_at, CAST(content_changed_at AS VARCHAR) AS content_changed_at"


def _synced(spark, sf_dir) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents")
    key = [F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("concept"), F.lit("__page__").alias("section"), F.lit(fx.MODEL).alias("model_version")]
    first = F.lit("2024-01-01 00:00:00").cast("timestamp")
    old = docs.where("doc_id % 10 <> 0").select(
        *key, F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash"), F.col("source").alias("category"), first.alias("updated_at"), F.when(F.col("doc_id") % 11 != 0, first).alias("content_changed_at")
    )
    new = docs.where("doc_id % 9 <> 0").select(*key, F.sha2("text", 256).alias("content_hash"), F.when(F.col("doc_id") % 13 != 0, F.col("lang")).alias("category"), F.lit("2023-12-01 00:00:00").cast("timestamp").alias("source_mtime"))
    return sections.upsert(old, new, F.lit(fx.NOW).cast("timestamp"))


def _shown(store: DataFrame, *more: str) -> DataFrame:
    return store.select("concept", "content_hash", "category", F.col("updated_at").cast("string").alias("updated_at"), F.col("content_changed_at").cast("string").alias("content_changed_at"), *more)


@query(f"WITH {_SYNC_SQL} SELECT {_SYNC_OUT}, action FROM s")
def section_upsert(spark, sf_dir):
    return _shown(_synced(spark, sf_dir), "action")


@query(f"WITH {_SYNC_SQL} SELECT {_SYNC_OUT} FROM s WHERE action = 'touch'")
def section_touch(spark, sf_dir):
    return _shown(_synced(spark, sf_dir).where("action = 'touch'"))


@query(f"WITH {_SYNC_SQL} SELECT {_SYNC_OUT} FROM s WHERE updated_at >= TIMESTAMP '2024-02-01'")
def orphan_sweep(spark, sf_dir):
    return _shown(sections.sweep(_synced(spark, sf_dir), fx.MODEL, F.lit(fx.NOW).cast("timestamp")))


# -- vectors ------------------------------------------------------------------


def _vector_hits(spark, sf_dir, k: int = 15, which: str = "true") -> DataFrame:
    """which: of the query vectors, those to search for."""
    return vectors.vector_search(fx.sections(spark, sf_dir), fx.vector_queries(spark, sf_dir).where(which), k, fx.MODEL, decimals=6)


@query("WITH " + fx.VECTOR_SQL + " SELECT query_id, rank, concept, section, round(score, 4) AS score FROM vr WHERE rank <= 15")
def vector_search(spark, sf_dir):
    return _vector_hits(spark, sf_dir).select("query_id", "rank", "concept", "section", F.round("score", 4).alias("score"))


@query("WITH " + fx.VECTOR_SQL + " SELECT query_id, concept, section, round(score, 4) AS score FROM vr WHERE rank <= 15 QUALIFY row_number() OVER (PARTITION BY query_id, concept ORDER BY score DESC, rank) = 1")
def best_section(spark, sf_dir):
    return vectors.best_section(_vector_hits(spark, sf_dir)).select("query_id", "concept", "section", F.round("score", 4).alias("score"))


# -- ranking ------------------------------------------------------------------

_DECAY = "0.5::DOUBLE + 0.5::DOUBLE * exp(-{lam} * greatest(0.0::DOUBLE, {age}))"
_AGE = "(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(changed_at)) / 8.64e10::DOUBLE"


@query("SELECT event_id, round(" + _DECAY.format(lam="0.003::DOUBLE", age="(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 8.64e10::DOUBLE") + ", 6) AS factor FROM events")
def decay(spark, sf_dir):
    age = scoring.age_days(F.col("ts"), F.lit(fx.NOW))
    return fx.events(spark, sf_dir).select("event_id", F.round(scoring.decay_factor(age, F.lit(scoring.BASE_LAMBDA)), 6).alias("factor"))


@query("WITH " + fx.RECENCY_SQL + " SELECT concept, category, CAST(epoch_us(changed_at) AS BIGINT) AS changed_us FROM rs")
def recency_snapshot(spark, sf_dir):
    return ranking.recency_snapshot(fx.store(spark, sf_dir), fx.MODEL).select("concept", "category", F.unix_micros("changed_at").alias("changed_us"))


@query("WITH " + fx.KEYWORD_SQL + "," + fx.RECENCY_SQL + """,
j AS (SELECT query_id, name, score, category, changed_at, CASE WHEN category = 'error' THEN 0.0::DOUBLE ELSE 0.003::DOUBLE END AS lam FROM kr LEFT JOIN rs ON concept = name WHERE rank <= 100)
SELECT query_id, name AS concept, round(score * CASE WHEN changed_at IS NULL THEN 1.0::DOUBLE ELSE """ + _DECAY.format(lam="lam", age=_AGE) + """ END, 6) AS score,
  CASE WHEN changed_at IS NOT NULL THEN round(lam, 6) END AS decay_lambda FROM j""")
def recency_rank(spark, sf_dir):
    pages = fx.search_pages(spark, sf_dir)
    hits = index.keyword_search(index.postings(pages, fx.queries(spark)), pages, fx.queries(spark), 100).select("query_id", F.col("name").alias("concept"), "score")
    aged = ranking.with_recency(hits, ranking.recency_snapshot(fx.store(spark, sf_dir), fx.MODEL), F.lit(fx.NOW), ratios={"error": 0.0})
    return aged.select("query_id", "concept", F.round("score", 6).alias("score"), "decay_lambda")


_POOL_SQL = fx.KEYWORD_SQL + "," + fx.VECTOR_SQL + """,
kq AS (SELECT query_id, rank, name AS concept, score FROM kr WHERE rank <= 15),
kn_ AS (SELECT query_id, concept, rank AS keyword_rank, score, score / CASE WHEN max(score) OVER (PARTITION BY query_id) = 0 THEN 1 ELSE max(score) OVER (PARTITION BY query_id) END AS n FROM kq),
vq AS (
  SELECT query_id // 50 + 1 AS query_id, 'doc-' || section AS concept, section, rank AS vector_rank, score FROM vr WHERE rank <= 15 AND query_id < 150),
pl AS (
  SELECT coalesce(k.query_id, v.query_id) AS query_id, coalesce(k.concept, v.concept) AS concept, v.section,
         0.4::DOUBLE * coalesce(k.n, 0) + 0.6::DOUBLE * coalesce(v.score, 0) AS score, keyword_rank, vector_rank
  FROM kn_ k FULL JOIN vq v ON k.query_id = v.query_id AND k.concept = v.concept)"""


def _pool(spark, sf_dir) -> DataFrame:
    """Three text queries and, for each, one of the first three query vectors."""
    pages = fx.search_pages(spark, sf_dir)
    kw = index.keyword_search(index.postings(pages, fx.queries(spark)), pages, fx.queries(spark), 15).select("query_id", "rank", F.col("name").alias("concept"), "score")
    hits = _vector_hits(spark, sf_dir, which="query_id < 150")
    ve = hits.select(F.expr("cast(query_id div 50 + 1 as int)").alias("query_id"), "rank", F.concat(F.lit("doc-"), "section").alias("concept"), "section", "score")
    return ranking.hybrid_merge(kw, ve)


@query("WITH " + _POOL_SQL + " SELECT query_id, concept, section, round(score, 4) AS score, keyword_rank, vector_rank FROM pl")
def hybrid_merge(spark, sf_dir):
    return _pool(spark, sf_dir).select("query_id", "concept", "section", F.round("score", 4).alias("score"), "keyword_rank", "vector_rank")


_BOOST_SQL = _POOL_SQL + "," + fx.LINKS_SQL.replace(fx.PAGES_SQL + ",", "", 1) + """,
tp AS (SELECT query_id, concept FROM pl QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, concept) <= 20),
co AS (SELECT t.query_id, t.concept, list_sort(list_distinct(list(nb.neighbour)))[:3] AS near FROM tp t JOIN nb ON nb.name = t.concept AND nb.name <> nb.neighbour JOIN tp o ON o.query_id = t.query_id AND o.concept = nb.neighbour GROUP BY ALL),
gb AS (SELECT pl.query_id, pl.concept, round(pl.score, 6) + CASE WHEN near IS NULL THEN 0.0::DOUBLE ELSE 0.1::DOUBLE END AS score, array_to_string(near, ',') AS near FROM pl LEFT JOIN co USING (query_id, concept))"""


def _boosted(spark, sf_dir) -> DataFrame:
    pool = _pool(spark, sf_dir).withColumn("score", F.round("score", 6))
    return ranking.graph_boost(pool, graph.graph_edges(fx.pages(spark, sf_dir)), 10)


@query("WITH " + _BOOST_SQL + " SELECT query_id, concept, round(score, 4) AS score, near FROM gb")
def graph_boost(spark, sf_dir):
    return _boosted(spark, sf_dir).select("query_id", "concept", F.round("score", 4).alias("score"), F.array_join("cooccur_neighbours", ",").alias("near"))


@query("WITH " + _BOOST_SQL + """, fb AS (SELECT gb.query_id, concept, score * CASE WHEN gb.query_id IN (1, 3) AND (category = 'src3' OR list_contains(tags, 'src3') OR regexp_matches(concept, 'fail|error|timeout|bug')) THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS score
  FROM gb LEFT JOIN pg ON pg.name = concept)
SELECT query_id, concept, round(score, 4) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, concept) AS INTEGER) AS rank FROM fb WHERE score >= 0.15 QUALIFY rank <= 10""")
def failure_boost(spark, sf_dir):
    intents = ranking.classified(fx.queries(spark))
    pool = ranking.intent_boost(_boosted(spark, sf_dir), fx.pages(spark, sf_dir), intents, ("src3",))
    return ranking.cut(pool.withColumn("score", F.round("score", 6)), 10).select("query_id", "concept", F.round("score", 4).alias("score"), "rank")


_CUSTOM = {"relation": ("relat", "with", "between", "link")}


@query("""
WITH t AS (SELECT conv_id, turn, regexp_matches(text, '(?i)relat')::INT + regexp_matches(text, '(?i)with')::INT + regexp_matches(text, '(?i)between')::INT + regexp_matches(text, '(?i)link')::INT AS r,
  2 * regexp_matches(text, '(?i)exception')::INT + regexp_matches(text, '(?i)bug')::INT + regexp_matches(text, '(?i)error')::INT AS f FROM conversations)
SELECT conv_id, turn, CASE WHEN greatest(r, f) = 0 THEN 'default' WHEN r = greatest(r, f) THEN 'relation' ELSE 'failure' END AS intent, least(greatest(r, f) / 2.0::DOUBLE, 1.0::DOUBLE) AS confidence FROM t""")
def intent_classify(spark, sf_dir):
    name, confidence = scoring.intent(F.col("text"), _CUSTOM)
    return fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", name.alias("intent"), confidence.alias("confidence"))


_INTENTS = ("這個類別在哪裡定義", "什麼是設計原理", "A和B的關係", "timeout Error 怎麼解決", "hello", "cache vs. index", "a, b, c")


@query("WITH q AS (SELECT conv_id, turn, [" + ", ".join(f"'{t}'" for t in _INTENTS) + """][(conv_id + turn) % 7 + 1] || ' ' || role AS text, CAST(turn % 10 AS DOUBLE) / 10 AS top1 FROM conversations)
SELECT conv_id, turn, top1 < 0.5 OR regexp_matches(text, '(?i)跟.{1,15}的|和.{1,15}的|vs\\.?|或者|，.{1,20}，|.+,.+,.+') AS expand FROM q""")
def needs_expansion(spark, sf_dir):
    asked = F.concat(F.element_at(F.array(*(F.lit(t) for t in _INTENTS)), ((F.col("conv_id") + F.col("turn")) % 7 + 1).cast("int")), F.lit(" "), "role")
    top = (F.col("turn") % 10).cast("double") / 10
    return fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", scoring.needs_expansion(top, asked).alias("expand"))


@query("WITH " + fx.RECENCY_SQL + ", d AS (SELECT 'doc-' || doc_id AS concept FROM documents) SELECT concept, round(CASE WHEN changed_at IS NULL THEN 1.0::DOUBLE ELSE " + _DECAY.format(lam="CASE WHEN category = 'error' THEN 0.0::DOUBLE ELSE 0.003::DOUBLE END", age=_AGE) + " END, 6) AS factor FROM d LEFT JOIN rs USING (concept)")
def recency_factor(spark, sf_dir):
    concepts = fx.pages(spark, sf_dir).select(F.col("name").alias("concept"))
    found = ranking.recency_factor(concepts, ranking.recency_snapshot(fx.store(spark, sf_dir), fx.MODEL), F.lit(fx.NOW), ratios={"error": 0.0})
    return found.select("concept", F.round("factor", 6).alias("factor"))


@query("WITH " + fx.KEYWORD_SQL + " SELECT query_id, rank, name AS concept, CAST(NULL AS VARCHAR) AS section, score, score AS keyword_score FROM kr WHERE rank <= 10")
def degraded_search(spark, sf_dir):
    pages, asked = fx.search_pages(spark, sf_dir), fx.queries(spark)
    hits = index.keyword_search(index.postings(pages, asked), pages, asked)
    return ranking.keyword_as_ranked(hits).select("query_id", "rank", "concept", "section", "score", "keyword_score")


_MERGE_SQL = fx.KEYWORD_SQL + """,
mp AS (SELECT 1 AS query_id, query_id - 1 AS part, name AS concept, score FROM kr WHERE rank <= 10),
mb AS (SELECT * FROM mp QUALIFY row_number() OVER (PARTITION BY query_id, concept ORDER BY score DESC, part) = 1)"""


@query("WITH " + _MERGE_SQL + " SELECT query_id, part, concept, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, concept) AS INTEGER) AS rank FROM mb QUALIFY rank <= 10")
def expansion_merge(spark, sf_dir):
    pages = fx.search_pages(spark, sf_dir)
    hits = index.keyword_search(index.postings(pages, fx.queries(spark)), pages, fx.queries(spark), 10)
    return ranking.expansion_merge(hits.select(F.lit(1).alias("query_id"), (F.col("query_id") - 1).alias("part"), F.col("name").alias("concept"), "score")).select("query_id", "part", "concept", "score", "rank")


@query("WITH " + fx.VECTOR_SQL + """, h AS (SELECT q.vec_id, count(v.section) AS n FROM (SELECT vec_id, concept FROM sc WHERE vec_id % 50 = 0) q LEFT JOIN vr v ON v.query_id = q.vec_id AND v.rank <= 3 AND v.section <> CAST(q.vec_id AS VARCHAR) AND v.concept = q.concept GROUP BY q.vec_id)
SELECT count(*) AS total_q, count(*) FILTER (n > 0) AS hits, round(avg(CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS hit_rate, count(*) FILTER (n = 0) AS n_misses FROM h""")
def hit_rate(spark, sf_dir):
    hits = _vector_hits(spark, sf_dir).where(F.col("section") != F.col("query_id").cast("string"))
    asked = fx.sections(spark, sf_dir).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.upper("concept").alias("wanted"))
    return ranking.hit_rate(hits, asked).select("total_q", "hits", "hit_rate", F.size("misses").cast("long").alias("n_misses"))


# -- code graph ---------------------------------------------------------------


def _named(symbols: DataFrame) -> DataFrame:
    return symbols.select(F.col("id").alias("symbol_id"), "short_name")


def _concepts(spark, sf_dir) -> DataFrame:
    return fx.symbols(spark, sf_dir).select(F.col("p_name").alias("concept"))


def _embedding_links(spark, sf_dir, symbols: DataFrame | None = None) -> DataFrame:
    keys = (fx.symbols(spark, sf_dir) if symbols is None else symbols).select("id")
    asked = fx.vector_queries(spark, sf_dir).join(keys, F.col("query_id") == F.col("id"), "left_semi")
    # one more than asked for, as a symbol's own section is none of its neighbours
    near = vectors.vector_search(fx.sections(spark, sf_dir), asked, codegraph.NEAREST + 1, decimals=6).where(F.col("section") != F.col("query_id").cast("string"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    near = near.withColumn("r", place).where(F.col("r") <= codegraph.NEAREST).select(F.col("query_id").alias("symbol_id"), "concept", "score")
    return codegraph.rank_concepts(near, threshold=0.3)


def _links(spark, sf_dir, symbols: DataFrame | None = None) -> DataFrame:
    """The links of these symbols, or of all; those of one do not depend on
    other symbols."""
    named = _named(fx.symbols(spark, sf_dir) if symbols is None else symbols)
    return codegraph.links(named, _concepts(spark, sf_dir), _embedding_links(spark, sf_dir, symbols), decimals=6)


@query("WITH " + fx.SYMBOLS_SQL + " SELECT symbol_id, concept, link_type, score FROM nm")
def name_match(spark, sf_dir):
    return codegraph.name_match(_named(fx.symbols(spark, sf_dir)), _concepts(spark, sf_dir), decimals=6)


@query("WITH " + fx.SYMBOLS_SQL + " SELECT symbol_id, concept, link_type, score FROM em")
def knn_link(spark, sf_dir):
    return _embedding_links(spark, sf_dir)


@query("WITH " + fx.SYMBOLS_SQL + " SELECT symbol_id, concept, link_type, score FROM ml")
def merge_links(spark, sf_dir):
    return _links(spark, sf_dir)


@query("WITH " + fx.SYMBOLS_SQL + " SELECT qualified_name, short_name, symbol_type, file_path, repo, concept, link_type, score FROM ml JOIN sy ON id = symbol_id WHERE concept = 'small ring' ORDER BY score DESC, qualified_name, concept, symbol_type, file_path LIMIT 200")
def wiki_links(spark, sf_dir):
    return codegraph.wiki_links(_links(spark, sf_dir), fx.symbols(spark, sf_dir), concept="small ring", limit=200)


@query("WITH " + fx.SYMBOLS_SQL + """, p AS (SELECT id FROM sy WHERE symbol_type IN ('function', 'method') AND left(short_name, 1) <> '_' AND NOT starts_with(lower(file_path), 'brand#1/'))
SELECT count(*) AS public_symbols, count(*) FILTER (id IN (SELECT symbol_id FROM ml WHERE link_type = 'embedding_match')) AS embedding_linked,
  count(*) FILTER (id IN (SELECT symbol_id FROM ml WHERE link_type <> 'embedding_match')) AS name_match_symbols,
  round(count(*) FILTER (id IN (SELECT symbol_id FROM ml WHERE link_type = 'embedding_match')) / CAST(count(*) AS DOUBLE), 6) AS coverage FROM p""")
def coverage(spark, sf_dir):
    return codegraph.coverage(fx.symbols(spark, sf_dir), _links(spark, sf_dir), "warehouse", ("Brand#1/",)).withColumn("coverage", F.round("coverage", 6))


_SEARCH_SQL = """, fs AS (
  SELECT id, qualified_name, short_name, CASE WHEN lower(short_name) = 'ring' THEN 1.0::DOUBLE WHEN short_name ILIKE 'ring%' THEN 0.8::DOUBLE WHEN short_name ILIKE '%ring%' THEN 0.6::DOUBLE WHEN qualified_name ILIKE '%ring%' THEN 0.4::DOUBLE ELSE 0.2::DOUBLE END AS score
  FROM sy WHERE short_name ILIKE '%ring%' OR qualified_name ILIKE '%ring%' OR docstring ILIKE '%ring%')"""


def _found(spark, sf_dir, limit: int) -> DataFrame:
    return codegraph.code_search(fx.symbols(spark, sf_dir), " Ring ", limit=limit).groupBy("qualified_name", "short_name").agg(F.max("score").alias("score"))


@query("WITH " + fx.SYMBOLS_SQL + _SEARCH_SQL + " SELECT qualified_name, short_name, max(score) AS score FROM (SELECT * FROM fs ORDER BY score DESC, length(short_name), qualified_name LIMIT 100) GROUP BY ALL")
def code_search(spark, sf_dir):
    return _found(spark, sf_dir, 100)


@query("WITH " + fx.SYMBOLS_SQL + _SEARCH_SQL + """, f AS (SELECT qualified_name, max(score) AS score FROM (SELECT * FROM fs ORDER BY score DESC, length(short_name), qualified_name LIMIT 20) GROUP BY ALL),
l AS (SELECT DISTINCT qualified_name, concept, link_type, ml.score AS link_score FROM ml JOIN sy ON id = symbol_id),
b AS (SELECT *, CAST(row_number() OVER (PARTITION BY qualified_name ORDER BY link_score DESC, concept) AS INTEGER) AS link_rank FROM l QUALIFY link_rank <= 5)
SELECT qualified_name, score, concept, link_type, link_score, link_rank FROM f LEFT JOIN b USING (qualified_name)""")
def code_search_links(spark, sf_dir):
    found = _found(spark, sf_dir, 20).drop("short_name")
    asked = found.select(F.col("qualified_name").alias("q"))
    symbols = fx.symbols(spark, sf_dir).join(F.broadcast(asked), F.col("qualified_name") == F.col("q"), "left_semi")
    named = _links(spark, sf_dir, symbols).join(symbols.select("id", "qualified_name"), F.col("symbol_id") == F.col("id")).select("qualified_name", "concept", "link_type", "score").distinct()
    numbered = named.withColumn("symbol_id", F.xxhash64("qualified_name"))
    known = numbered.select(F.col("symbol_id").alias("id"), "qualified_name").distinct()
    return codegraph.search_links(found, numbered.drop("qualified_name"), known)


@query("""
WITH w AS (SELECT s_suppkey AS k, 'r' || s_suppkey AS repo, s_nationkey AS n FROM supplier)
SELECT repo, k % 5 <> 0 AS indexed, CASE WHEN k % 5 <> 0 AND k % 7 <> 0 AND k % 11 <> 0 THEN k % 3 = 0 END AS stale FROM w""")
def index_status(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = fx.table(spark, sf_dir, "supplier").select(k, F.concat(F.lit("r"), k.cast("string")).alias("repo"), F.col("s_nationkey").alias("n"))
    state = rows.where(k % 5 != 0).select("repo", F.when(k % 7 != 0, F.col("n").cast("string")).alias("git_head"))
    heads = rows.select("repo", F.when(k % 11 != 0, (F.col("n") + F.when(k % 3 == 0, 1).otherwise(0)).cast("string")).alias("current_head"))
    return codegraph.index_status(rows.select("repo"), state, heads)


@query("WITH " + fx.SYMBOLS_SQL + " SELECT link_type, count(*) AS links FROM ml GROUP BY ALL")
def link_counts(spark, sf_dir):
    return codegraph.link_counts(_links(spark, sf_dir).withColumn("repo", F.lit("warehouse"))).select("link_type", "links")


@query("WITH " + fx.SYMBOLS_SQL + ", d AS (SELECT id, short_name, CASE WHEN id % 2 = 0 THEN ' ' || docstring || ' ' || docstring || ' ' ELSE docstring END AS doc FROM sy) SELECT id, CASE WHEN length(trim(doc)) > 50 THEN short_name || ': ' || trim(doc)[:800] END AS embedded FROM d")
def embedding_text(spark, sf_dir):
    doc = F.when(F.col("id") % 2 == 0, F.concat(F.lit(" "), "docstring", F.lit(" "), "docstring", F.lit(" "))).otherwise(F.col("docstring"))
    return fx.symbols(spark, sf_dir).select("id", codegraph.embedding_text(F.col("short_name"), doc).alias("embedded"))


@query("""
WITH u AS (SELECT 'w::p.f' || p_partkey AS caller, p_partkey AS k, 'a' || (p_partkey % 40) AS alias, 'file' || (p_partkey % 9) AS f FROM part),
b AS (SELECT 'file' || (p_partkey % 9) AS f, 'a' || (p_partkey % 50) AS alias, max(p_partkey) AS k FROM part WHERE p_partkey % 4 = 0 GROUP BY ALL),
t AS (SELECT caller, CASE WHEN b.k IS NOT NULL THEN 'w::p.f' || b.k ELSE 'w::p.' || u.alias END AS callee FROM u LEFT JOIN b USING (f, alias))
SELECT DISTINCT caller, callee FROM t WHERE callee IN (SELECT 'w::p.f' || p_partkey FROM part WHERE p_partkey % 3 = 0)""")
def call_edges(spark, sf_dir):
    k = F.col("p_partkey")
    part = fx.table(spark, sf_dir, "part")
    own = F.concat(F.lit("w::p.f"), k.cast("string"))
    none = F.lit(None).cast("string")
    file = F.concat(F.lit("file"), (k % 9).cast("string"))
    uses = part.select(F.lit("use").alias("kind"), file.alias("file_path"), F.concat(F.lit("w::p.a"), (k % 40).cast("string")).alias("name"), own.alias("owner"), F.concat(F.lit("a"), (k % 40).cast("string")).alias("alias"), none.alias("attribute"), F.lit(0).cast("long").alias("place"))
    binds = part.where(k % 4 == 0).select(F.lit("bind").alias("kind"), file.alias("file_path"), none.alias("name"), F.lit("w::p").alias("owner"), F.concat(F.lit("a"), (k % 50).cast("string")).alias("alias"), F.concat(F.lit("p.f"), k.cast("string")).alias("attribute"), k.cast("long").alias("place"))
    return codegraph.call_edges(uses.unionByName(binds), part.where(k % 3 == 0).select(own.alias("qualified_name")))


# -- recall -------------------------------------------------------------------


@query("""
WITH h AS (SELECT user_id AS session, 'page-' || (event_id % 40) AS name, max(value) AS score FROM events WHERE value >= 5 AND event_type IN ('error', 'view') GROUP BY ALL),
s AS (SELECT DISTINCT user_id AS session, 'page-' || (event_id % 40) AS name FROM events WHERE event_type = 'signup'),
k AS (SELECT h.* FROM h LEFT JOIN s USING (session, name) WHERE s.name IS NULL)
SELECT session, name, score, CAST(row_number() OVER (PARTITION BY session ORDER BY score DESC, name) AS INTEGER) AS rank FROM k QUALIFY rank <= 6""")
def recall_pick(spark, sf_dir):
    hits = fx.events(spark, sf_dir).select("session", F.concat(F.lit("page-"), (F.col("event_id") % 40).cast("string")).alias("name"), F.col("kind").alias("category"), F.col("value").alias("score"))
    return recall.pick(hits, hits.where("category = 'signup'"), 5.0, ("error", "view")).select("session", "name", "score", "rank")


@query("""
WITH e AS (SELECT event_id, user_id AS session, user_id % 9 AS f, ts FROM events)
SELECT event_id, session, path FROM (SELECT event_id, session, '/src/m' || (event_id % 9) || CASE event_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.md' ELSE '.SQL' END AS path, ts FROM e)
WHERE path NOT LIKE '%.md' QUALIFY row_number() OVER (PARTITION BY session, path ORDER BY ts, event_id) = 1""")
def first_edits(spark, sf_dir):
    ending = F.element_at(F.array(F.lit(".py"), F.lit(".md"), F.lit(".SQL")), (F.col("event_id") % 3 + 1).cast("int"))
    rows = fx.events(spark, sf_dir).withColumn("path", F.concat(F.lit("/src/m"), (F.col("event_id") % 9).cast("string"), ending))
    return recall.first_edits(rows).select("event_id", "session", "path")


@query("""
WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
g AS (
  SELECT event_id, user_id, event_type, rn, t AS last, FALSE AS passed FROM e WHERE rn = 1
  UNION ALL
  SELECT e.event_id, e.user_id, e.event_type, e.rn, CASE WHEN e.t - g.last < 172800 THEN g.last ELSE e.t END, e.t - g.last < 172800
  FROM g JOIN e ON e.user_id = g.user_id AND e.event_type = g.event_type AND e.rn = g.rn + 1)
SELECT event_id, passed FROM g""")
def gate_cooldown(spark, sf_dir):
    return recall.gates(fx.events(spark, sf_dir), 172_800.0)


_EDITS_SQL = """
e AS (SELECT event_id, user_id AS session, '/src/m' || (event_id % 9) || CASE event_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.md' ELSE '.SQL' END AS path, ts FROM events),
fe AS (SELECT * FROM e WHERE path NOT LIKE '%.md' QUALIFY row_number() OVER (PARTITION BY session, path ORDER BY ts, event_id) = 1),
lf AS (SELECT event_id, session, list(path) OVER (PARTITION BY session ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS files FROM fe)"""


def _edits(spark, sf_dir) -> DataFrame:
    ending = F.element_at(F.array(F.lit(".py"), F.lit(".md"), F.lit(".SQL")), (F.col("event_id") % 3 + 1).cast("int"))
    rows = fx.events(spark, sf_dir).withColumn("path", F.concat(F.lit("/src/m"), (F.col("event_id") % 9).cast("string"), ending))
    return recall.last_files(recall.first_edits(rows))


@query("WITH " + _EDITS_SQL + " SELECT event_id, session, array_to_string(files, '|') AS files FROM lf")
def last_files(spark, sf_dir):
    return _edits(spark, sf_dir).select("event_id", "session", F.array_join("files", "|").alias("files"))


@query("WITH " + _EDITS_SQL + """ SELECT event_id, 'push deploy verify 推送 部署 驗證 ' || array_to_string(list_transform(files, lambda f: regexp_replace(regexp_extract(f, '[^/]*$'), '\\.[^.]*$', '')), ' ') || ' done ' || event_id AS query FROM lf""")
def bash_query(spark, sf_dir):
    command = F.concat(F.lit("git push -m 'done "), F.col("event_id").cast("string"), F.lit("'"))
    return _edits(spark, sf_dir).select("event_id", recall.bash_query(F.lit("push"), F.col("files"), command).alias("query"))


@query("""SELECT doc_id, 'src ' || lang || ' page' || doc_id || ' ' || regexp_replace(text[:1000], '\\s+', ' ', 'g')[:200] AS query FROM documents""")
def edit_query(spark, sf_dir):
    path = F.concat(F.lit("/home/src/"), "lang", F.lit("/page"), F.col("doc_id").cast("string"), F.lit(".py"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", recall.edit_query(path, F.col("text")).alias("query"))


@query("""
WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS said FROM conversations WHERE role = 'user')
SELECT conv_id, turn, said AS text FROM c WHERE length(said) >= 12 AND NOT starts_with(said, '/')""")
def prompt_moments(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "conversations").where("role = 'user'")
    line = F.to_json(F.struct((F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("event_id"), F.col("conv_id").cast("string").alias("session_id"), F.col("text").alias("prompt")))
    lines = rows.select(line.alias("value")).unionAll(spark.createDataFrame([("no json",), ("[1]",), ("",)], "value string"))
    found = moments.asked(moments.hook_events(lines))
    return found.select(F.expr("event_id div 1000").alias("conv_id"), (F.col("event_id") % 1000).cast("int").alias("turn"), "text")


@query("""
WITH h AS (SELECT user_id AS session, event_id, ts, 'page-' || (event_id % 40) AS name, value AS score FROM events WHERE event_type <> 'signup'),
s AS (SELECT DISTINCT user_id AS session, 'page-' || (event_id % 40) AS name FROM events WHERE event_type = 'signup'),
k AS (SELECT h.* FROM h LEFT JOIN s USING (session, name) WHERE s.name IS NULL QUALIFY row_number() OVER (PARTITION BY session, h.name ORDER BY ts, event_id) = 1)
SELECT session, name, event_id FROM k""")
def once_a_session(spark, sf_dir):
    hits = fx.events(spark, sf_dir).select("session", "event_id", "ts", "kind", F.concat(F.lit("page-"), (F.col("event_id") % 40).cast("string")).alias("name"), F.col("value").alias("score"))
    found = moments.once_a_session(hits.where("kind <> 'signup'"), hits.where("kind = 'signup'"), 6)
    return found.select("session", "name", "event_id")


# -- sources ------------------------------------------------------------------


@query("SELECT DISTINCT 'label-' || label AS concept FROM embeddings")
def distinct_concepts(spark, sf_dir):
    return fx.sections(spark, sf_dir).select("concept").distinct()


@query("""
SELECT 'p' || doc_id AS path, CASE WHEN doc_id % 10 = 0 THEN 'added' WHEN doc_id % 9 = 0 THEN 'deleted' ELSE 'changed' END AS change
FROM documents WHERE (doc_id % 10 = 0) <> (doc_id % 9 = 0) OR (doc_id % 10 <> 0 AND doc_id % 9 <> 0 AND doc_id % 7 = 0)""")
def file_changes(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    path = F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path")
    day = F.timestamp_seconds(F.lit(0))
    old = docs.where("doc_id % 10 <> 0").select(path, day.alias("mtime"))
    new = docs.where("doc_id % 9 <> 0").select(path, F.when(F.col("doc_id") % 7 == 0, F.timestamp_seconds(F.lit(60))).otherwise(day).alias("mtime"))
    return page_source.changes(new, old)


@query("""
WITH n AS (SELECT 'd' || doc_id AS rel, left(sha1(text), 16) AS hash, doc_id FROM documents)
SELECT rel, hash FROM n WHERE NOT (doc_id % 3 = 0 AND doc_id % 6 <> 0)""")
def to_ingest(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    raw = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    done = docs.where("doc_id % 3 = 0").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("rel"), text.file_hash(F.col("text")).alias("hash"), F.when(F.col("doc_id") % 6 == 0, "failed").otherwise("ingested").alias("status"))
    return page_source.to_ingest(raw, done).select("rel", "hash")


@query("""
WITH m AS (SELECT doc_id FROM documents WHERE doc_id % 4 <> 0)
SELECT CAST(7 AS BIGINT) AS raw_written, count(*) FILTER (doc_id % 5 <> 0) AS wiki_written, (SELECT count(*) FROM documents) - count(*) AS skipped, count(*) FILTER (doc_id % 5 = 0) AS errors FROM m""")
def ingest_counts(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rel"))
    bad = F.col("rel") % 5 == 0
    made = docs.where("rel % 4 <> 0").select("rel", F.when(~bad, "x").alias("text"), F.when(bad, "no").alias("error"))
    return page_source.ingest_counts(docs, made, 7)
