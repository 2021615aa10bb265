import datetime
import sys

import pytest
from pyspark.sql import functions as F

from noteloom.config import from_mapping
from noteloom.sources import adapters, pages, tables
from noteloom.sources.python_files import git_head, python_files


@pytest.fixture
def wiki(tmp_path):
    root = tmp_path / "wiki"
    (root / "failures").mkdir(parents=True)
    (root / "one.md").write_text("---\ntype: note\ntags: [x, 2]\nrelated:\n  - '[[two]]'\n---\nbody [[two]]\n")
    (root / "failures/two.md").write_text("no header, content")
    (root / "bad.md").write_text("---\na: [unclosed\n---\nx")
    (root / "empty.md").write_text("")
    (root / "skip.txt").write_text("x")
    return root


def test_pages(spark, wiki):
    files = pages.scan(spark, str(wiki))
    got = {r.name: r for r in pages.pages(files).collect()}
    assert set(got) == {"one", "two"}
    one, two = got["one"], got["two"]
    assert (one.category, one.node_type, one.tags, one.related, one.has_header, one.content) == ("root", "note", ["x", "2"], ["[[two]]"], True, "body [[two]]")
    assert (two.category, two.node_type, two.tags, two.has_header) == ("failures", "unknown", [], False)
    assert [r.path for r in pages.rejected(files).collect()] == ["bad.md"]


def test_changes(spark):
    def at(*rows):
        return spark.createDataFrame([(p, datetime.datetime(2024, 1, d)) for p, d in rows], "path string, mtime timestamp")

    old, new = at(("a", 1), ("b", 1), ("c", 1)), at(("a", 1), ("b", 2), ("d", 1))
    assert {r.path: r.change for r in pages.changes(new, old).collect()} == {"b": "changed", "c": "deleted", "d": "added"}
    assert pages.needs_rebuild(new, old) and not pages.needs_rebuild(old, old)


def test_ingest_skips_what_is_done(spark):
    raw = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content string")
    first = pages.to_ingest(raw, spark.createDataFrame([], tables.SCHEMAS["ingest_state"]))
    assert first.count() == 3
    state = first.select("rel", "hash", F.when(F.col("rel") == "b", "failed").otherwise("ingested").alias("status"))
    assert [r.rel for r in pages.to_ingest(raw, state).collect()] == ["b"]


class Two:
    def fetch(self):
        yield "text", "name.md"
        yield "more", "other.md"

    def target_dir(self):
        return "raw"


def test_adapters(spark, tmp_path):
    assert adapters.folder_documents(spark, str(tmp_path / "gone")).count() == 0
    for name in ("a.md", "b.md", "c.txt"):
        (tmp_path / name).write_text(name)
    assert sorted(r.filename for r in adapters.folder_documents(spark, str(tmp_path)).collect()) == ["a.md", "b.md"]
    sys.modules["noteloom_test_adapter"] = sys.modules[__name__]
    assert [f for _, f in adapters.load_adapter("noteloom_test_adapter.Two").fetch()] == ["name.md", "other.md"]


def test_python_files(spark, tmp_path):
    for p in ("m.py", "a/b.py", ".hid/c.py", "venv/d.py", "a/gen_x.py", "old/e.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x = 1")
    assert sorted(r.path for r in python_files(spark, str(tmp_path), ("gen_*", "old")).collect()) == ["a/b.py", "m.py"]


def test_git_head(tmp_path):
    sha = "a" * 40
    assert git_head(str(tmp_path)) is None
    git = tmp_path / ".git"
    (git / "refs/heads").mkdir(parents=True)
    (git / "HEAD").write_text("ref: refs/heads/main\n")
    assert git_head(str(tmp_path)) is None
    (git / "packed-refs").write_text(f"# pack\n{sha} refs/heads/main\n")
    assert git_head(str(tmp_path)) == sha
    (git / "refs/heads/main").write_text("b" * 40)
    assert git_head(str(tmp_path)) == "b" * 40
    (git / "HEAD").write_text("c" * 40)
    assert git_head(str(tmp_path)) == "c" * 40
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / ".git").write_text(f"gitdir: {git}")
    assert git_head(str(tree)) == "c" * 40
    # a ref may name another; a work tree has a HEAD of its own and shares the rest
    (git / "HEAD").write_text("ref: refs/heads/alias\n")
    (git / "refs/heads/alias").write_text("ref: refs/heads/main")
    assert git_head(str(tmp_path)) == "b" * 40
    own = git / "worktrees/w"
    own.mkdir(parents=True)
    (own / "commondir").write_text("../..\n")
    (own / "HEAD").write_text("ref: refs/heads/main\n")
    (tree / ".git").write_text(f"gitdir: {own}")
    assert git_head(str(tree)) == "b" * 40
    (git / "refs/heads/alias").write_text("ref: refs/heads/alias")
    assert git_head(str(tmp_path)) is None


def links_of(spark, *rows):
    return spark.createDataFrame([(r, i, c, "name_match", 1.0) for r, i, c in rows], tables.SCHEMAS["links"])


def held(spark, root):
    return sorted((r.repo, r.symbol_id, r.concept) for r in tables.read(spark, root, "links").collect())


def test_tables(spark, tmp_path):
    root = str(tmp_path)
    assert held(spark, root) == []
    tables.commit(spark, root, {"links": links_of(spark, ("r", 1, "a"))}, "r")
    tables.commit(spark, root, {"links": links_of(spark, ("s", 2, "b"))}, "s")
    assert held(spark, root) == [("r", 1, "a"), ("s", 2, "b")]
    # a frame may read what it replaces
    again = tables.read(spark, root, "links").where("repo = 'r'").withColumn("concept", F.lit("z"))
    tables.commit(spark, root, {"links": again}, "r")
    assert held(spark, root) == [("r", 1, "z"), ("s", 2, "b")]
    # a repo that has no links any more loses the old ones
    tables.commit(spark, root, {"links": links_of(spark)}, "r")
    assert held(spark, root) == [("s", 2, "b")]
    tables.commit(spark, root, {"links": links_of(spark, ("t", 3, "c"))})
    assert held(spark, root) == [("t", 3, "c")]


def test_a_crash_before_the_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    state = spark.createDataFrame([("r", "p", None, None, 1, 1, 1, 0)], tables.SCHEMAS["index_state"])
    tables.commit(spark, root, {"links": links_of(spark, ("r", 1, "a")), "index_state": state}, "r")

    def crash(*_):
        raise RuntimeError("crash")

    with monkeypatch.context() as m:
        m.setattr(tables, "_publish", crash)
        with pytest.raises(RuntimeError):
            tables.commit(spark, root, {"links": links_of(spark), "index_state": state.where("false")}, "r")
    assert held(spark, root) == [("r", 1, "a")] and tables.read(spark, root, "index_state").count() == 1
    # a manifest that was only half written is not one
    (tmp_path / "manifest/000000000002.json.abc").write_text("{")
    assert held(spark, root) == [("r", 1, "a")]
    tables.commit(spark, root, {"links": links_of(spark, ("r", 9, "n"))}, "r")
    for _ in range(3):
        tables.commit(spark, root, {"links": links_of(spark, ("r", 9, "n"))}, "r")
    assert held(spark, root) == [("r", 9, "n")]
    assert len(list((tmp_path / "data/links").iterdir())) == tables.KEPT == len(list((tmp_path / "manifest").glob("*.json")))


def test_a_second_writer_is_refused(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    tables.commit(spark, root, {"links": links_of(spark, ("r", 1, "a"))})
    known = tables._manifests(spark, root)
    tables.commit(spark, root, {"links": links_of(spark, ("r", 2, "b"))})
    monkeypatch.setattr(tables, "_manifests", lambda *_: known)
    with pytest.raises(RuntimeError):
        tables.commit(spark, root, {"links": links_of(spark, ("r", 3, "c"))})


def test_texts_are_written_whole(spark, tmp_path):
    rows = spark.createDataFrame([("a.md", "one\ntwo"), ("sub/b.md", "é"), ("c.md", "")], "name string, text string")
    (tmp_path / "a.md").write_text("old")
    assert tables.write_texts(rows, str(tmp_path)) == 3
    assert {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*.md")} == {"a.md": "one\ntwo\n", "sub/b.md": "é\n", "c.md": "\n"}
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".staged")]


def test_only_changed_files_are_parsed(spark, wiki):
    files = pages.scan(spark, str(wiki))
    # plain rows: a persisted scan would answer for the later one
    held_pages, listed = pages.parsed_pages(files), files.select("path", "mtime")
    first = spark.createDataFrame(held_pages.collect(), held_pages.schema)
    manifest = spark.createDataFrame(listed.collect(), listed.schema)
    (wiki / "one.md").write_text("now without a header")
    import os

    os.utime(wiki / "one.md", (2_000_000_000,) * 2)
    (wiki / "failures/two.md").unlink()
    (wiki / "three.md").write_text("new")
    marked = first.withColumn("content", F.concat(F.lit("held: "), "content"))
    (wiki / "kept.md").write_text("x")
    got = {r.name: r.content for r in pages.refreshed(marked, pages.scan(spark, str(wiki)), manifest).collect()}
    assert got == {"one": "now without a header", "three": "new", "kept": "x"}
    same = {r.name: r.content for r in pages.refreshed(marked, files.where("false"), manifest.where("false")).collect()}
    assert same == {n: f"held: {c}" for n, c in (("one", "body [[two]]"), ("two", "no header, content"))}


class Parts:
    def parts(self):
        return ["a", "b"]

    def fetch_part(self, part):
        yield f"text {part}", f"{part}.md"


def test_adapters_in_parts(spark, monkeypatch):
    sys.modules["noteloom_test_adapter"] = sys.modules[__name__]
    reader = adapters._Reader("noteloom_test_adapter.Parts")
    assert [row for p in reader.partitions() for row in reader.read(p)] == [("text a", "a.md"), ("text b", "b.md")]
    assert len(adapters._Reader("noteloom_test_adapter.Two").partitions()) == 1


def test_config():
    plain = {"domain": "d", "embedding": {"provider": "p", "model": "m"}}
    c = from_mapping(plain | {"recency": {"floor": 0.4, "unknown": 1}, "recall": {"failure_categories": ["f"]}})
    assert c.recency.floor == 0.4 and c.recall.failure_categories == ("f",) and c.model_version(8) == "p-m-d8"
    with pytest.raises(TypeError):
        from_mapping({"domain": "d", "embedding": {"provider": "p", "model": "m", "unknown": 1}})
