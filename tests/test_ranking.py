import pytest
from pyspark.sql import functions as F

from noteloom.operators import ranking, vectors

KW = "query_id int, rank int, concept string, score double"
VE = "query_id int, rank int, concept string, section string, score double"
PAGES = "name string, category string, tags array<string>"
EDGES = "a string, b string"


def frames(spark, kw, ve=(), edges=(), pages=()):
    return spark.createDataFrame(list(kw), KW), spark.createDataFrame(list(ve), VE), spark.createDataFrame(list(pages), PAGES), spark.createDataFrame(list(edges), EDGES)


def test_merge(spark):
    kw, ve, _, _ = frames(spark, [(1, 1, "a", 4.0), (1, 2, "b", 2.0)], [(1, 1, "b", "s", 0.8), (1, 2, "a", "s1", 0.6), (1, 3, "a", "s2", 0.55)])
    got = {r.concept: (r.section, round(r.score, 4)) for r in ranking.hybrid_merge(kw, ve).collect()}
    assert got == {"a": ("s1", 0.76), "b": ("s", 0.68)}


def test_neighbours_among_the_best_lift(spark):
    kw, ve, pages, edges = frames(spark, [(1, i + 1, c, 1.0) for i, c in enumerate(("hub", "a", "lone"))], edges=[("a", "hub"), ("elsewhere", "lone"), ("hub", "hub")])
    out = ranking.two_stage_hybrid(kw, ve, pages, edges)
    got = {r.concept: (round(r.score, 3), r.cooccur_neighbours) for r in out.collect()}
    assert got == {"hub": (0.5, ["a"]), "a": (0.5, ["hub"]), "lone": (0.4, None)}


def test_recency_comes_before_the_cut(spark):
    kw, ve, pages, edges = frames(spark, [(1, 1, "old", 1.0), (1, 2, "new", 0.9)])
    snap = spark.createDataFrame([("old", "x", "2018-01-01 00:00:00"), ("new", "x", "2024-02-01 00:00:00")], "concept string, category string, t string").select("concept", "category", F.col("t").cast("timestamp").alias("changed_at"))
    out = ranking.two_stage_hybrid(kw, ve, pages, edges, snapshot=snap, now=F.lit("2024-02-01").cast("timestamp"))
    assert [r.concept for r in out.orderBy("rank").collect()] == ["new", "old"]


def test_intent_boost_and_degradation(spark):
    asked = spark.createDataFrame([(1, "an error and a bug"), (2, "plain")], "query_id int, text string")
    kw, ve, pages, edges = frames(spark, [(1, 1, "f", 1.0), (2, 1, "f", 1.0)], pages=[("f", "failures", None)])
    out = ranking.two_stage_hybrid(kw, None, pages, edges, intents=ranking.classified(asked))
    assert {r.query_id: round(r.score, 3) for r in out.collect()} == {1: 0.6, 2: 0.4}
    nothing = ranking.cut(kw.select("query_id", "concept", F.lit(0.01).alias("score")), 10)
    flags = ranking.degradation(asked, kw, nothing).collect()
    assert {r.degradation for r in flags} == {"no_match_above_threshold"}


def test_hit_rate(spark):
    ranked = spark.createDataFrame([(1, 1, "Found"), (2, 4, "lost")], "query_id int, rank int, concept string")
    asked = spark.createDataFrame([(1, "found"), (2, "lost")], "query_id int, wanted string")
    assert tuple(ranking.hit_rate(ranked, asked).first()) == (2, 1, 0.5, ["lost"])


@pytest.mark.parametrize("most", [1 << 20, 20])
def test_vector_search_in_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", most)
    rows = [(f"c{i % 2}", str(i), [float(i), 1.0], "m") for i in range(5)] + [("n", "x", None, "m"), ("z", "z", [0.0, 0.0], "m"), ("o", "o", [1.0, 1.0], "other")]
    held = spark.createDataFrame(rows, "concept string, section string, vec array<float>, model_version string")
    asked = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "query_id int, vec array<float>")
    got = vectors.vector_search(held, asked, 2, "m").orderBy("query_id", "rank").collect()
    assert len(got) == 10 and [r.section for r in got[:2]] == ["4", "3"]
    assert vectors.best_section(vectors.vector_search(held, asked, 5, "m")).count() == 10


def test_vector_search_equals_brute_force(spark):
    import random

    rng = random.Random(4)
    rows = [(f"c{rng.randrange(6)}", str(i), [float(rng.randrange(-2, 3)) for _ in range(3)]) for i in range(400)] + [("w", "w", [1.0, 2.0]), (None, "n", [1.0, 1.0, 1.0])]
    held = spark.createDataFrame(rows, "concept string, section string, vec array<float>").repartition(3)
    asked = [(i, [float(rng.randrange(-2, 3)) for _ in range(3)]) for i in range(12)] + [(50, [0.0, 0.0, 0.0]), (51, [2.0, 1.0])]

    def cosine(a, b):
        size = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return None if len(a) != len(b) or not size else round(sum(x * y for x, y in zip(a, b, strict=True)) / size, 6)

    want = []
    for q, v in asked:
        scored = [(-s, c or "", n, c) for c, n, x in rows if (s := cosine(v, x)) is not None]
        want += [(q, r, c, n) for r, (_, _, n, c) in enumerate(sorted(scored)[:7], 1)]
    got = vectors.vector_search(held, spark.createDataFrame(asked, "query_id int, vec array<double>"), 7, decimals=6)
    assert sorted((r.query_id, r["rank"], r.concept, r.section) for r in got.collect()) == sorted(want)
    assert got.schema["query_id"].dataType.simpleString() == "int"
    assert vectors.vector_search(held.where("false"), got.select("query_id", F.array(F.lit(1.0)).alias("vec")).where("false")).count() == 0


def test_shown_scores_round_half_to_even(spark):
    kw = spark.createDataFrame([(1, 1, "a", 0.03125), (1, 2, "b", 0.09375)], KW)
    got = {r.concept: r.keyword_score for r in ranking.hybrid_merge(kw, spark.createDataFrame([], VE)).collect()}
    assert got == {"a": 0.0312, "b": 0.0938}


def test_a_boost_of_the_callers_own(spark):
    kw, ve, pages, edges = frames(spark, [(1, 1, "a", 1.0), (1, 2, "b", 1.0), (1, 3, "c", 1.0)], pages=[("a", "x", None), ("b", "y", None)])
    asked = ranking.classified(spark.createDataFrame([(1, "q")], "query_id int, text string"))
    out = ranking.two_stage_hybrid(kw, ve, pages, edges, intents=asked, boost=lambda concept, category, tags, intent: F.when(category == "x", 2.0).when(category == "y", 0.0))
    assert {r.concept: round(r.score, 3) for r in out.collect()} == {"a": 0.8, "b": 0.4, "c": 0.4}


def test_sample(spark):
    names = spark.createDataFrame([(f"p{i}",) for i in range(50)] + [("p1",), (None,)], "name string")
    one = [r.name for r in ranking.sampled(names, 10, 3).collect()]
    assert len(set(one)) == 10 and one == [r.name for r in ranking.sampled(names.repartition(7), 10, 3).collect()]
    assert set(one) != {r.name for r in ranking.sampled(names, 10, 4).collect()}
    assert ranking.sampled(names, 100).count() == 50
