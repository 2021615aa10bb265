import math

import pytest

from noteloom.operators import graph, index

SCHEMA = "name string, path string, category string, tags array<string>, related array<string>, has_header boolean, content string"


@pytest.fixture
def pages(spark):
    rows = [
        ("a", "w/a.md", "w", ["x", "y"], ["[[b]]", "[[a]]"], True, "see [[b]] and [[b|B]] and [[gone]]"),
        ("b", "w/b.md", "w", ["x"], [], True, "back to [[a]], content"),
        ("c", "w/c.md", "w", ["y", "raw"], None, True, "[[c]] content content"),
        ("d", "w/d.md", "v", None, None, False, None),
        ("e", "w/e.md", "v", ["raw"], [None], None, "[[b]]"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_edges(pages):
    got = {(r.a, r.b): (r.confidence, r.source) for r in graph.graph_edges(pages).collect()}
    assert got == {
        ("a", "b"): ("EXTRACTED", "frontmatter"),
        ("a", "a"): ("EXTRACTED", "frontmatter"),
        ("a", "c"): ("INFERRED", "tag:y"),
        ("b", "e"): ("EXTRACTED", "wikilink"),
    }


def test_tag_groups_have_a_limit(spark):
    rows = [(f"p{i}", "", "c", ["wide"] + ["pair"] * (i < 2), [], True, "") for i in range(17)]
    edges = graph.tag_edges(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.src, r.dst, r.tag) for r in edges] == [("p0", "p1", "pair")]


def test_diagnostics(pages):
    edges = graph.graph_edges(pages)
    assert [r.name for r in graph.orphans(pages, edges).collect()] == ["d"]
    assert [(r.name, r.target) for r in graph.broken_links(pages).collect()] == [("a", "gone")]
    assert tuple(graph.diagnostics(pages, edges).first()) == (1, 1, 2)
    stats = graph.graph_stats(pages, edges).first()
    assert (stats.pages, stats.edges, stats.extracted, stats.inferred, stats.density) == (5, 4, 3, 1, 0.4)


def test_empty_graph(spark):
    none = spark.createDataFrame([], SCHEMA)
    edges = graph.graph_edges(none)
    assert edges.count() == 0 and tuple(graph.graph_stats(none, edges).first()) == (0, 0, 0, 0, 0.0)


def test_lookup(spark, pages):
    asked = spark.createDataFrame([("a",), ("A",), ("zz",)], "asked string")
    assert {r.asked: r.name for r in graph.concept_lookup(pages, asked).collect()} == {"a": "a", "A": "a", "zz": None}


def test_unique_pages(spark, pages):
    twice = pages.unionAll(pages.selectExpr("name", "'z/' || path", "category", "tags", "related", "has_header", "content"))
    assert {r.path for r in graph.unique_pages(twice).collect()} == {f"z/w/{n}.md" for n in "abcde"}


def test_search(spark, pages):
    postings = index.postings(pages)
    asked = spark.createDataFrame([(1, "content"), (2, "content content"), (3, "nowhere"), (4, None)], "query_id int, text string")
    hits = index.keyword_search(postings, pages, asked).collect()
    one, two = ({r.name: r.score for r in hits if r.query_id == q} for q in (1, 2))
    assert set(one) == {"b", "c"} and not [r for r in hits if r.query_id > 2]
    assert all(abs(two[n] - 2 * one[n]) < 2e-3 for n in one)
    weights = {(r.term, r.name): r.weight for r in postings.collect()}
    assert weights["content", "c"] == pytest.approx(1.0 * __import__("math").log(5 / 3))


def test_negative_largest_score_is_kept(spark):
    hits = spark.createDataFrame([(1, -2.0), (1, -4.0), (2, 0.0), (3, 4.0), (3, 2.0)], "query_id int, score double")
    got = sorted((r.query_id, r.score) for r in index.normalised(hits).collect())
    assert got == [(1, 1.0), (1, 2.0), (2, 0.0), (3, 0.5), (3, 1.0)]


def test_tokens_are_counted_within_a_page(spark, monkeypatch):
    """In parts of any size, with names that repeat and pages without tokens;
    texts are not dealt and no window runs over the terms."""
    rows = [(f"p{i}", " ".join(f"w{j % (i % 7 + 1)}" for j in range(i)), "c", ["tag"] if i % 2 else None) for i in range(40)] + [("-", None, "c", None), ("", "é É 設計", "c", [])]
    pages = spark.createDataFrame(rows, "name string, content string, category string, tags array<string>")
    schema = lambda d: sorted((r.term, r.name, round(r.weight, 9)) for r in d.collect())
    want = schema(index.postings(pages))
    assert ("w0", "p39", round(8 / 8 * math.log(42 / 40), 9)) in want and ("設計", "") in {w[:2] for w in want}
    monkeypatch.setattr(index, "ROWS_AT_ONCE", 3)
    monkeypatch.setattr(index, "ROWS_GIVEN", 2)
    assert schema(index.postings(pages)) == want
    asked = spark.createDataFrame([(1, "W0 tag none")], "query_id int, text string")
    some = [w for w in want if w[0] in ("w0", "tag")]
    assert schema(index.postings(pages, asked)) == some
    monkeypatch.setattr(index, "MOST_TERMS", 1)
    assert schema(index.postings(pages, asked)) == some
    for found in (index.postings(pages), index.postings(pages, asked)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "RepartitionByExpression" not in plan
    halves = spark.createDataFrame([("a", "x x y", "c", None), ("a", "x z", "c", None), ("b", "y", "c", None)], pages.schema)
    whole = spark.createDataFrame([("a", "x x y a x z", "c", None), ("b", "y", "c", None)], pages.schema)
    assert {w[:2] for w in schema(index.postings(halves))} == {w[:2] for w in schema(index.postings(whole))}
    assert ("x", "a", round(3 / 3 * math.log(2 / 2), 9)) in schema(index.postings(halves))
