"""The one hybrid ranking: merge, recency, graph boost, intent boost, cutoff.

Shown scores are rounded half to even.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions.scoring import BASE_LAMBDA, FAILURE_CATEGORIES, FLOOR, WEIGHTS, age_days, decay_factor, failure_boost, intent, lambda_for
from noteloom.operators.graph import neighbours

LEAST_SCORE = 0.15
GRAPH_BOOST = 0.1


def over_fetch(top_k: int) -> int:
    """How many hits each retriever should give."""
    return max(3 * top_k, 15)


def recency_snapshot(store: DataFrame, model_version: str | None = None) -> DataFrame:
    """concept, category, changed_at: the latest of a concept's sections."""
    if model_version is not None:
        store = store.where(F.col("model_version") == model_version)
    return store.groupBy("concept").agg(F.max("category").alias("category"), F.max("content_changed_at").alias("changed_at"))


def with_recency(scored: DataFrame, snapshot: DataFrame, now: Column, base: float = BASE_LAMBDA, floor: float = FLOOR, ratios: dict[str, float] | None = None, evergreen: tuple[str, ...] = ()) -> DataFrame:
    """score times the recency factor of its concept, with pre_recency_score,
    age_days, decay_lambda and recency_factor; unchanged (nulls) for concepts
    of unknown age."""
    snap = snapshot.select(F.col("concept").alias("s_concept"), F.col("category").alias("s_category"), "changed_at")
    lam = lambda_for(F.col("concept"), F.coalesce("s_category", F.lit("")), base, ratios, evergreen)
    age = age_days(F.col("changed_at"), now)
    known = F.col("changed_at").isNotNull()
    joined = scored.join(snap, F.col("concept") == F.col("s_concept"), "left")
    marked = joined.withColumns(
        {
            "pre_recency_score": F.when(known, F.bround("score", 4)),
            "age_days": F.when(known, F.bround(F.greatest(age, F.lit(0.0)), 2)),
            "decay_lambda": F.when(known, F.bround(lam, 6)),
            "_factor": F.when(known, decay_factor(age, lam, floor)).otherwise(1.0),
        }
    )
    return marked.withColumn("recency_factor", F.when(known, F.bround("_factor", 4))).withColumn("score", F.col("score") * F.col("_factor")).drop("s_concept", "s_category", "changed_at", "_factor")


def hybrid_merge(keyword: DataFrame, vector: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """query_id, concept, section, score and both ranks and scores.

    keyword: query_id, rank, concept, score. vector: the same and section. The
    keyword side is normalised by its largest score; the best hit of a concept
    counts once, never summed; a normalised score of -1 or less counts as none.
    weights: query_id, w_keyword, w_vector (0.4 and 0.6 without).
    """
    most = F.max("score").over(Window.partitionBy("query_id"))
    norm = F.col("score") / F.when(most == 0, 1.0).otherwise(most)
    kw = keyword.withColumn("n", norm).where("n > -1")
    first = Window.partitionBy("query_id", "concept").orderBy(F.desc("n"), "rank")
    kw = kw.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("query_id", "concept", F.col("rank").alias("keyword_rank"), F.bround("score", 4).alias("keyword_score"), F.col("n").alias("kw"))
    order = Window.partitionBy("query_id", "concept").orderBy(F.desc("score"), "rank")
    ve = vector.where("score > -1").withColumn("_r", F.row_number().over(order)).where("_r = 1")
    ve = ve.select("query_id", "concept", "section", F.col("rank").alias("vector_rank"), F.bround("score", 4).alias("vector_score"), F.col("score").alias("ve"))
    both = kw.join(ve, ["query_id", "concept"], "full_outer")
    w_k, w_v = WEIGHTS["default"]
    if weights is not None:
        both = both.join(weights.withColumnRenamed("query_id", "wq"), F.col("query_id") == F.col("wq"), "left").drop("wq")
    else:
        both = both.withColumns({"w_keyword": F.lit(w_k), "w_vector": F.lit(w_v)})
    score = F.coalesce("w_keyword", F.lit(w_k)) * F.coalesce("kw", F.lit(0.0)) + F.coalesce("w_vector", F.lit(w_v)) * F.coalesce("ve", F.lit(0.0))
    return both.withColumn("score", score).select("query_id", "concept", "section", "score", "keyword_rank", "keyword_score", "vector_rank", "vector_score")


def graph_boost(pool: DataFrame, edges: DataFrame, top_k: int) -> DataFrame:
    """The pool with 0.1 more for those of each query's best 2 * top_k that
    have a neighbour among them, and up to three such neighbours by name."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "concept"))
    top = pool.withColumn("place", place).where(F.col("place") <= 2 * top_k).select("query_id", "concept")
    around = neighbours(edges).where("name <> neighbour")
    near = top.join(around, F.col("concept") == F.col("name")).select("query_id", "concept", "neighbour")
    other = top.select(F.col("query_id").alias("q2"), F.col("concept").alias("c2"))
    met = near.join(other, (F.col("query_id") == F.col("q2")) & (F.col("neighbour") == F.col("c2"))).groupBy(F.col("query_id").alias("bq"), F.col("concept").alias("bc"))
    found = met.agg(F.slice(F.array_sort(F.collect_set("neighbour")), 1, 3).alias("cooccur_neighbours"))
    joined = pool.join(found, (F.col("query_id") == F.col("bq")) & (F.col("concept") == F.col("bc")), "left").drop("bq", "bc")
    boost = F.when(F.col("cooccur_neighbours").isNotNull(), GRAPH_BOOST)
    return joined.withColumn("graph_boost", boost).withColumn("score", F.col("score") + F.coalesce("graph_boost", F.lit(0.0)))


def intent_boost(pool: DataFrame, pages: DataFrame, intents: DataFrame, categories: tuple[str, ...] = FAILURE_CATEGORIES, boost: Callable[[Column, Column, Column, Column], Column] | None = None) -> DataFrame:
    """The pool with scores times a factor; all of the pool, not only its best.

    boost(concept, category, tags, intent) gives the factor as a column; null
    and 0 count as 1. Without it, pages about failures have 1.5 for queries of
    intent failure.
    """
    page = pages.select(F.col("name").alias("pn"), F.col("category").alias("pc"), F.col("tags").alias("pt"))
    asked = intents.select(F.col("query_id").alias("iq"), "intent")
    joined = pool.join(page, F.col("concept") == F.col("pn"), "left").join(asked, F.col("query_id") == F.col("iq"), "left")
    if boost is None:
        factor = F.when(F.col("intent") == "failure", failure_boost(F.col("concept"), F.col("pc"), F.col("pt"), categories)).otherwise(1.0)
    else:
        given = boost(F.col("concept"), F.col("pc"), F.col("pt"), F.col("intent")).cast("double")
        factor = F.when(F.coalesce(given, F.lit(0.0)) == 0, 1.0).otherwise(given)
    return joined.withColumn("_f", factor).withColumn("intent_boost", F.when(F.col("_f") != 1.0, F.bround("_f", 3))).withColumn("score", F.col("score") * F.col("_f")).drop("pn", "pc", "pt", "iq", "intent", "_f")


def cut(pool: DataFrame, top_k: int, least: float = LEAST_SCORE) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "concept"))
    return pool.where(F.col("score") >= least).withColumn("rank", rank).where(F.col("rank") <= top_k)


def two_stage_hybrid(keyword: DataFrame, vector: DataFrame | None, pages: DataFrame, edges: DataFrame, top_k: int = 10, intents: DataFrame | None = None, weights: DataFrame | None = None, snapshot: DataFrame | None = None, now: Column | None = None, least: float = LEAST_SCORE, recency: dict | None = None, boost: Callable[[Column, Column, Column, Column], Column] | None = None) -> DataFrame:
    """The ranking of a batch of queries, in the one order that holds for all
    callers: merge and weigh, recency, graph boost, intent boost, cutoff.
    Without a vector side it degrades to the keyword side. recency: settings of
    with_recency; boost: see intent_boost."""
    if vector is None:
        vector = keyword.select("query_id", "rank", "concept", F.lit(None).cast("string").alias("section"), "score").where("false")
    pool = hybrid_merge(keyword, vector, weights)
    category = pages.select(F.col("name").alias("cn"), "category")
    pool = pool.join(category, F.col("concept") == F.col("cn"), "left").drop("cn")
    if snapshot is not None and now is not None:
        pool = with_recency(pool, snapshot, now, **(recency or {}))
    pool = graph_boost(pool, edges, top_k)
    if intents is not None:
        pool = intent_boost(pool, pages, intents, boost=boost)
    return cut(pool, top_k, least)


def degradation(queries: DataFrame, pool: DataFrame, results: DataFrame, vector_available: bool = True) -> DataFrame:
    """query_id, degradation: why a query's results are poorer; null if not."""
    had = pool.select(F.col("query_id").alias("pq")).distinct()
    got = results.select(F.col("query_id").alias("rq")).distinct()
    joined = queries.select("query_id").join(had, F.col("query_id") == F.col("pq"), "left").join(got, F.col("query_id") == F.col("rq"), "left")
    flag = F.lit(None).cast("string") if vector_available else F.lit("vector_unavailable_fallback_to_keyword")
    nothing = F.col("pq").isNotNull() & F.col("rq").isNull()
    return joined.select("query_id", F.coalesce(flag, F.when(nothing, "no_match_above_threshold")).alias("degradation"))


def keyword_as_ranked(hits: DataFrame) -> DataFrame:
    """Keyword hits in the columns of the hybrid ranking: their own score, not
    normalised, no section and no category."""
    none = F.lit(None).cast("string")
    return hits.select("query_id", "rank", F.col("name").alias("concept"), none.alias("section"), none.alias("category"), F.col("snippet").alias("chunk"), "score", F.col("score").alias("keyword_score"))


def recency_factor(concepts: DataFrame, snapshot: DataFrame, now: Column, **settings) -> DataFrame:
    """concept, factor: 1 for concepts of unknown age."""
    asked = concepts.select("concept", F.lit(1.0).alias("score"))
    return with_recency(asked, snapshot, now, **settings).select("concept", F.col("score").alias("factor"))


def sampled(names: DataFrame, n: int = 20, seed: int = 0) -> DataFrame:
    """name: n of the different names, without replacement, by the order of a
    hash with the seed, so the same in every run and partitioning."""
    return names.select("name").where("name is not null").distinct().orderBy(F.xxhash64("name", F.lit(seed)), "name").limit(n)


def classified(queries: DataFrame, custom: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """query_id, text, intent, confidence, w_keyword, w_vector."""
    name, confidence = intent(F.col("text"), custom)
    out = queries.select("query_id", "text", name.alias("intent"), confidence.alias("confidence"))
    w = {side: F.lit(WEIGHTS["default"][side]) for side in (0, 1)}
    for key, pair in WEIGHTS.items():
        for side in (0, 1):
            w[side] = F.when(F.col("intent") == key, pair[side]).otherwise(w[side])
    return out.withColumns({"w_keyword": w[0], "w_vector": w[1]})


def expansion_merge(results: DataFrame, top_k: int = 10) -> DataFrame:
    """The best score of each concept over a query and its expansions
    (query_id, part, concept, score; part 0 is the query itself)."""
    best = Window.partitionBy("query_id", "concept").orderBy(F.desc("score"), "part")
    merged = results.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "concept"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= top_k)


def hit_rate(ranked: DataFrame, asked: DataFrame, top_n: int = 3) -> DataFrame:
    """One row: total_q, hits, hit_rate (4 decimals), misses by name, for asked
    (query_id, wanted) found by name among a query's first top_n."""
    first = ranked.where(F.col("rank") <= top_n).select(F.col("query_id").alias("rq"), F.lower("concept").alias("rc"))
    found = asked.join(first, (F.col("query_id") == F.col("rq")) & (F.lower("wanted") == F.col("rc")), "left").groupBy("query_id", "wanted").agg(F.count("rc").alias("n"))
    hit = F.col("n") > 0
    return found.agg(F.count("*").alias("total_q"), F.count_if(hit).alias("hits"), F.coalesce(F.bround(F.avg(hit.cast("double")), 4), F.lit(0.0)).alias("hit_rate"), F.array_sort(F.collect_list(F.when(~hit, F.col("wanted")))).alias("misses"))
