import pytest
from pyspark.sql import functions as F

from noteloom.config import from_mapping
from noteloom.engine import KnowledgeBase
from noteloom.hooks import Hooks
from noteloom import api, cli
from noteloom.providers import HashedWords, embed, embedded, expansions, provider
from noteloom.sources import tables


class Picky(HashedWords):
    """Fails on texts that hold `bad`, and with them the batch."""

    bad = "poison"

    def embed(self, texts):
        if any(self.bad in t for t in texts):
            raise RuntimeError("bad text")
        return super().embed(texts)


class Counting:
    """Notes every prompt in a file, as calls come from workers."""

    def __init__(self, path):
        self.path = path

    def complete(self, prompt):
        with open(self.path, "a") as f:
            f.write("x\n")
        return "cache pages\nanother wording"


class Echo:
    def complete(self, prompt):
        if "fail" in prompt:
            raise RuntimeError("no reply")
        return prompt.split("\n", 1)[1]


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("kb")
    (root / "wiki/failures").mkdir(parents=True)
    (root / "wiki/cache-layer.md").write_text("---\ntags: [infra]\nrelated: ['[[data-layer]]']\n---\n## Core\ncache of pages and rows\n## Use\nread the cache")
    (root / "wiki/data-layer.md").write_text("---\ntags: [infra]\n---\nrows in tables")
    (root / "wiki/failures/connection-timeout.md").write_text("the cache timed out with an error")
    (root / "wiki/lonely.md").write_text("nothing here")
    config = from_mapping({"domain": "d", "embedding": {"provider": "hashed-words", "model": "t"}})
    return KnowledgeBase(spark, str(root / "wiki"), config, str(root / "store"), HashedWords(32), Echo())


def test_reads(spark, base):
    row = base.concept(spark.createDataFrame([("CACHE",)], "asked string")).first()
    assert row.name == "cache-layer" and row.neighbours == ["data-layer"]
    stats = base.stats().first()
    assert (stats.pages, stats.edges, stats.orphans, stats.no_header) == (4, 1, 2, 2)
    assert base.outline().count() == 2


def test_embed_is_incremental(base):
    assert {r.action: r.rows for r in base.embed_sections().collect()} == {"insert": 5}
    assert {r.action: r.rows for r in base.embed_sections(prune=True).collect()} == {"touch": 5}
    assert base.code_table("embeddings").count() == 5
    assert not base.stale(base.listing)


def test_searches(spark, base):
    asked = spark.createDataFrame([(1, "cache error"), (2, "rows")], "query_id int, text string")
    now = F.current_timestamp()
    plain = {(r.query_id, r["rank"]): r.concept for r in base.hybrid(asked, 5, now).collect()}
    assert plain[2, 1] == "data-layer"
    smart = base.smart(asked, 5, now).collect()
    assert [r.concept for r in smart if r.query_id == 1 and r["rank"] == 1] == ["connection-timeout"]
    seen = spark.createDataFrame([], "session string, name string")
    picked = base.recall_hits(spark.createDataFrame([("s", "cache error")], "session string, text string"), seen, True, now)
    assert [r.name for r in picked.collect()] == ["connection-timeout"]


def test_code(base, tmp_path):
    (tmp_path / "cache_layer.py").write_text('def data_layer():\n    """Rows."""\n')
    row = base.sync_code(str(tmp_path), "r").first()
    assert (row.symbol_count, row.error_count) == (2, 0)
    assert {(r.concept, r.link_type) for r in base.code_table("links").collect()} >= {("cache-layer", "name_match"), ("data-layer", "name_match")}
    assert base.code_search("layer").count() >= 2
    assert base.code_status("r", str(tmp_path)).first().stale is None
    assert base.code_coverage("r").first().public_symbols == 1


def test_ingest(base, tmp_path):
    (tmp_path / "good.md").write_text("good notes")
    (tmp_path / "bad.md").write_text("will fail")
    for _ in range(2):
        assert {r.status: r.files for r in base.ingest(str(tmp_path)).collect()} == {"ingested": 1, "failed": 1}


def test_providers(spark):
    df = spark.createDataFrame([("a b",), (None,), ("",)], "t string").select(embed(F.col("t"), HashedWords(8)).alias("v"))
    got = [r.v for r in df.collect()]
    assert abs(sum(x * x for x in got[0]) - 1) < 1e-6 and got[1] is None and got[2] == [0.0] * 8
    lines = spark.createDataFrame([("a\n\n b \nc\nd",), (None,), ("x" * 200,)], "t string").select(expansions(F.col("t")).alias("e"))
    assert [r.e for r in lines.collect()] == [["a", "b", "c"], [], ["x" * 120]]
    with pytest.raises(ValueError):
        provider("none")


def test_a_bad_text_costs_no_other_its_vector(spark):
    texts = [(f"text {i}",) for i in range(30)] + [("poison",), (None,)]
    df = spark.createDataFrame(texts, "t string").coalesce(1).select("t", embedded(F.col("t"), Picky(8)).alias("e"))
    rows = {r.t: r.e for r in df.collect()}
    assert all(rows[t].vec is not None and rows[t].error is None for (t,) in texts[:30])
    assert rows["poison"].vec is None and "bad text" in rows["poison"].error and rows[None].vec is None


def made(spark, root, embedder=None, writer=None):
    config = from_mapping({"domain": "d", "embedding": {"provider": "hashed-words", "model": "t"}})
    return KnowledgeBase(spark, str(root / "wiki"), config, str(root / "store"), embedder or HashedWords(8), writer)


def test_a_failed_embedding_keeps_the_old_row(spark, tmp_path):
    (tmp_path / "wiki").mkdir()
    (tmp_path / "wiki/a.md").write_text("first words")
    (tmp_path / "wiki/b.md").write_text("other words")
    made(spark, tmp_path).embed_sections()
    before = {r.concept: r for r in made(spark, tmp_path).code_table("embeddings").collect()}
    (tmp_path / "wiki/a.md").write_text("poison now")
    (tmp_path / "wiki/c.md").write_text("poison too")
    counts = {r.action: r.rows for r in made(spark, tmp_path, Picky(8)).embed_sections(prune=True).collect()}
    assert counts == {"touch": 1, "failed": 2}
    after = {r.concept: r for r in made(spark, tmp_path).code_table("embeddings").collect()}
    assert set(after) == {"a", "b"} and after["a"] == before["a"]
    assert {r.action: r.rows for r in made(spark, tmp_path).embed_sections().collect()} == {"touch": 1, "update": 1, "insert": 1}


def test_smart_asks_the_provider_once_a_query(spark, tmp_path):
    (tmp_path / "wiki").mkdir()
    (tmp_path / "wiki/cache.md").write_text("cache of pages")
    (tmp_path / "wiki/rows.md").write_text("rows of tables")
    calls = tmp_path / "calls"
    base = made(spark, tmp_path, writer=Counting(str(calls)))
    base.embed_sections()
    asked = spark.createDataFrame([(1 << 40, "nothing vs. that"), (2, "unknown vs. words")], "query_id long, text string")
    found = base.smart(asked, 3)
    assert {r.query_id for r in found.collect()} >= {1 << 40} and found.count() > 0
    assert len(calls.read_text().split()) == 2
    base.close()


def test_answers_say_why_they_are_poor(spark, base):
    asked = spark.createDataFrame([(1, "cache rows"), (2, "zzz")], "query_id long, text string")
    full = {r.query_id: r for r in base.answers(asked, 3).collect()}
    assert full[1].degradation is None and full[1].results[0].rank == 1
    config = base.config
    plain = KnowledgeBase(spark, base.root, config, base.store)
    poor = {r.query_id: r for r in plain.answers(asked, 3).collect()}
    assert {r.degradation for r in poor.values()} == {"vector_unavailable_fallback_to_keyword"}
    assert poor[2].results == [] and poor[1].results[0].concept in ("cache-layer", "data-layer")


def test_refreshed_reads_only_what_changed(spark, tmp_path):
    (tmp_path / "wiki").mkdir()
    for name in ("a", "b", "c"):
        (tmp_path / f"wiki/{name}.md").write_text(f"page {name}")
    first = made(spark, tmp_path)
    assert first.pages.count() == 3
    held = first.parsed
    import os
    import time

    (tmp_path / "wiki/b.md").write_text("page b, changed")
    os.utime(tmp_path / "wiki/b.md", (time.time() + 60,) * 2)
    (tmp_path / "wiki/c.md").unlink()
    (tmp_path / "wiki/d.md").write_text("page d")
    again = first.refreshed()
    assert {r.name: r.content for r in again.pages.collect()} == {"a": "page a", "b": "page b, changed", "d": "page d"}
    assert {r.name for r in held.collect()} == {"a", "b", "c"}
    again.close()


def test_hooks(spark, base, tmp_path):
    import json

    now = [1000.0]
    config = base.config
    own = KnowledgeBase(spark, base.root, config, str(tmp_path / "store"), HashedWords(32))
    own.embed_sections()
    hooks = Hooks(own, lambda: now[0])

    def run(**event):
        return hooks.run(json.dumps({"session_id": "s/1", **event}))

    assert hooks.run("no json") is None and hooks.run("") is None and run(prompt="short") is None and run(prompt="/a command of some length") is None
    said = run(prompt="rows in tables of the data layer")
    assert said[0] == "prompt" and "**data-layer**" in said[1]
    again = run(prompt="rows in tables of the data layer")
    assert again is None or "**data-layer**" not in again[1]
    edit = run(tool_input={"file_path": "/src/cache/connection.py", "new_string": "the cache timed out with an error"})
    assert edit[0] == "edit" and "connection-timeout" in edit[1] and "[failure]" in edit[1]
    assert run(tool_input={"file_path": "/src/cache/connection.py", "new_string": "the cache timed out with an error"}) is None
    state = hooks.load("s/1")
    assert state["files"] == ["/src/cache/connection.py"] and "connection-timeout" in state["seen"]
    assert run(tool_input={"command": "git commit -m 'x'"}) is None  # its only page is seen
    assert hooks.load("s/1")["gates"] == {"commit": 1000.0}
    (tmp_path / "store/sessions/s_1.json").write_text("{broken")
    assert hooks.load("s/1") == {"seen": [], "files": [], "gates": {}}
    own.close()


def test_api_and_its_bounds(spark, base):
    a = api.Api(base)
    assert a.handle("/health", {}) == (200, {"status": "ok"})
    status, found = a.handle("/api/hybrid_search", {"q": "rows", "top_k": "2"})
    assert status == 200 and found["results"][0]["concept"] == "data-layer"
    assert a.handle("/api/search", {"q": "cache"})[1][0]["rank"] == 1
    assert [a.handle("/api/search", g)[0] for g in ({}, {"q": ""}, {"q": "x", "limit": "0"}, {"q": "x", "limit": "51"}, {"q": "x", "limit": "a"})] == [422] * 5
    assert a.handle("/api/code/search", {"q": "x", "limit": "101"})[0] == 422 and a.handle("/nowhere", {})[0] == 404
    assert a.handle("/api/concept", {"name": "cache"})[1]["name"] == "cache-layer"
    assert a.handle("/api/code/coverage", {"repo": "none"})[1]["public_symbols"] == 0


def test_cli(spark, tmp_path, capsys):
    import json

    (tmp_path / "wiki").mkdir()
    (tmp_path / "wiki/cache.md").write_text("cache of pages")
    (tmp_path / "kb.yml").write_text("domain: d\nembedding: {provider: hashed-words, model: t}\n")
    (tmp_path / "code").mkdir()
    (tmp_path / "code/cache.py").write_text("def cache():\n    pass\n")
    own = ["--config", str(tmp_path / "kb.yml"), "--wiki", str(tmp_path / "wiki"), "--store", str(tmp_path / "store")]

    def run(*args):
        code = cli.main([*own, *args], spark)
        return code, [json.loads(x) for x in capsys.readouterr().out.splitlines()]

    assert run("embed") == (0, [{"action": "insert", "rows": 1}])
    assert run("stats")[1][0]["pages"] == 1
    assert run("search", "cache", "--hybrid")[1][0]["results"][0]["concept"] == "cache"
    assert run("search", "cache", "--limit", "99")[0] == 2
    assert run("code", "sync", "r", str(tmp_path / "code"))[1][0]["symbol_count"] == 2
    assert run("code", "search", "cache")[1] and run("code", "status", "r", str(tmp_path / "code"))[1][0]["indexed"]
    assert run("eval", "--sample", "5")[1][0]["total_q"] == 1
    assert run("check")[1]
