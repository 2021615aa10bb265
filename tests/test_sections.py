from pyspark.sql import functions as F

from noteloom.operators import sections

TEXT = "before\n## A\nin a\n### A1\nin a1\n## B\nin b\n#### A\nagain\n# top\nend"


def pages(spark):
    rows = [("p", TEXT), ("q", "no heading "), ("index", "## X\nx"), ("r", "  "), ("s", None)]
    return spark.createDataFrame(rows, "name string, content string")


def test_chunks(spark):
    got = {(r.name, r.section, r.occurrence): r.chunk for r in sections.chunk_sections(pages(spark)).collect()}
    assert got[("p", "A", 1)] == "## A\nin a\n### A1\nin a1"
    assert got[("p", "B", 1)] == "## B\nin b\n#### A\nagain\n# top\nend"
    assert got[("p", "A", 2)] == "#### A\nagain\n# top\nend"
    assert got[("q", "__page__", 1)] == "no heading"
    assert {k[0] for k in got} == {"p", "q"}


def test_read(spark):
    wanted = spark.createDataFrame([("p", "A"), ("p", "b"), ("p", "zz"), ("nope", "A")], "name string, asked string")
    got = {r.asked: (r.section, r.content) for r in sections.section_read(pages(spark), wanted).collect()}
    assert got == {"A": ("A", "## A\nin a\n### A1\nin a1"), "b": ("B", "## B\nin b\n#### A\nagain")}


def test_outline(spark):
    got = [(r.section, r.level) for r in sections.outline(pages(spark)).where("name = 'p'").orderBy("line").collect()]
    assert got == [("A", 2), ("A1", 3), ("B", 2), ("A", 4)]


STORE = "concept string, section string, model_version string, content_hash string, category string, updated_at timestamp, content_changed_at timestamp"


def run(spark, store, rows, now):
    new = spark.createDataFrame([(c, "s", "m", h, "k", None) for c, h in rows], "concept string, section string, model_version string, content_hash string, category string, source_mtime timestamp")
    return sections.upsert(store, new, F.lit(now).cast("timestamp"))


def test_three_runs(spark):
    first = run(spark, spark.createDataFrame([], STORE), [("a", "1"), ("b", "1")], "2024-01-01")
    assert {r.action for r in first.collect()} == {"insert"}
    second = run(spark, first.drop("action"), [("a", "1"), ("b", "1")], "2024-01-02")
    assert {r.action for r in second.collect()} == {"touch"}
    assert sections.to_embed(second).count() == 0
    assert {str(r.content_changed_at)[:10] for r in second.collect()} == {"2024-01-01"}
    third = run(spark, second.drop("action"), [("a", "2")], "2024-01-03")
    got = {r.concept: (r.action, str(r.updated_at)[:10], str(r.content_changed_at)[:10]) for r in third.collect()}
    assert got == {"a": ("update", "2024-01-03", "2024-01-03"), "b": ("keep", "2024-01-02", "2024-01-01")}
    swept = sections.sweep(third.drop("action"), "m", F.lit("2024-01-03").cast("timestamp"))
    assert [r.concept for r in swept.collect()] == ["a"]
    kept = sections.sweep(third.drop("action"), "m", F.lit("2025-01-01").cast("timestamp"))
    assert kept.count() == 2
