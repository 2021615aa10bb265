"""Stored tables under one manifest.

Data lies in folders that are written once and never changed; a manifest names,
for each table, the folder of each part (a repo, or "" for all of a table that
has none). A commit writes new folders, then publishes the next manifest by one
rename: readers see all of its tables change at once, a crash before the rename
changes nothing, and the folders it leaves behind go with a later commit.

Commits are for one writer at a time: a second one that publishes the same
number fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "embeddings": "concept string, section string, chunk string, content_hash string, model_version string, vec array<float>, updated_at timestamp, content_changed_at timestamp, category string",
    "eval_history": "eval_date date, hit_rate double, total_q int, hits int, top_n int, created_at timestamp",
    "symbols": "id bigint, repo string, qualified_name string, short_name string, symbol_type string, file_path string, lineno int, docstring string, decorators array<string>, git_head string, indexed_at timestamp",
    "call_edges": "repo string, caller_id bigint, callee_id bigint, call_type string",
    "import_edges": "repo string, importer_id bigint, imported string, is_type_only boolean",
    "links": "repo string, symbol_id bigint, concept string, link_type string, score double",
    "index_state": "repo string, repo_path string, git_head string, indexed_at timestamp, symbol_count int, call_edge_count int, import_edge_count int, error_count int",
    "ingest_state": "rel string, hash string, status string, ingested_at timestamp, error string",
}
#: Manifests that are kept, with their folders, for readers that still use them.
KEPT = 2


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text file, whole or not at all: written aside, then renamed."""
    aside = f"{path}.{uuid.uuid4().hex}"
    (a, fs), (p, _) = _fs(spark, aside), _fs(spark, path)
    out = fs.create(a, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(a, p):
        raise OSError(f"{path} was not written")


def _names(spark: SparkSession, folder: str) -> list[str]:
    p, fs = _fs(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _manifests(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in _names(spark, f"{root}/manifest") if n.endswith(".json"))


def _parts(spark: SparkSession, root: str, number: int) -> dict[str, dict[str, str]]:
    return json.loads(read_text(spark, f"{root}/manifest/{number:012d}.json"))


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table as of the last commit; empty if none named it. Columns it was
    written without are null."""
    root = root.rstrip("/")
    known = _manifests(spark, root)
    folders = sorted(_parts(spark, root, known[-1]).get(name, {}).values()) if known else []
    if not folders:
        return spark.createDataFrame([], SCHEMAS[name])
    return spark.read.schema(SCHEMAS[name]).parquet(*(f"{root}/data/{f}" for f in folders))


def commit(spark: SparkSession, root: str, changed: dict[str, DataFrame], repo: str | None = None) -> None:
    """Replace tables, all at once: their part of one repo, or whole tables.
    Frames may read the tables they replace; an empty frame empties its part."""
    root = root.rstrip("/")
    known = _manifests(spark, root)
    parts = _parts(spark, root, known[-1]) if known else {}
    for name, df in changed.items():
        folder = f"{name}/{uuid.uuid4().hex}"
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        df.select(*columns).write.parquet(f"{root}/data/{folder}")
        parts[name] = {"": folder} if repo is None else {k: v for k, v in parts.get(name, {}).items() if k} | {repo: folder}
    _publish(spark, root, (known[-1] if known else 0) + 1, parts)
    _tidy(spark, root)


def _publish(spark: SparkSession, root: str, number: int, parts: dict[str, dict[str, str]]) -> None:
    path = f"{root}/manifest/{number:012d}.json"
    if exists(spark, path):
        raise RuntimeError(f"another writer published manifest {number} of {root}")
    write_text(spark, path, json.dumps(parts, sort_keys=True))


def _tidy(spark: SparkSession, root: str) -> None:
    """Drop old manifests and folders that no kept one names."""
    known = _manifests(spark, root)
    for number in known[:-KEPT]:
        p, fs = _fs(spark, f"{root}/manifest/{number:012d}.json")
        fs.delete(p, False)
    used = {f for number in known[-KEPT:] for part in _parts(spark, root, number).values() for f in part.values()}
    for name in _names(spark, f"{root}/data"):
        for folder in _names(spark, f"{root}/data/{name}"):
            if f"{name}/{folder}" not in used:
                p, fs = _fs(spark, f"{root}/data/{name}/{folder}")
                fs.delete(p, True)


def staged(df: DataFrame, root: str) -> DataFrame:
    """df, written once below the store: what costs calls to a provider must
    not be computed again by each branch that reads it. See unstaged()."""
    path = f"{root.rstrip('/')}/staging/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unstaged(*frames: DataFrame) -> None:
    """Drop staged frames that nothing reads any more."""
    for df in frames:
        p, fs = _fs(df.sparkSession, df.staged_path)
        fs.delete(p, True)


def drop_staging(spark: SparkSession, root: str) -> None:
    """Drop all that is staged, by whomever."""
    p, fs = _fs(spark, f"{root.rstrip('/')}/staging")
    fs.delete(p, True)


def write_texts(rows: DataFrame, folder: str) -> int:
    """rows(name, text) as files of the folder, each ended by a line feed,
    written by the executors and renamed into place, for files of those names.
    Names may hold folders. Returns their number."""
    spark = rows.sparkSession
    aside = f"{folder.rstrip('/')}/.staged-{uuid.uuid4().hex}"
    numbered = rows.select("name", "text").withColumn("key", F.sha2("name", 256))
    # the text source writes each partition value, here one row, to a folder of its own
    numbered.select("text", "key").repartition("key").write.partitionBy("key").text(aside)
    moved = 0
    names = {r["key"]: r["name"] for r in numbered.select("key", "name").toLocalIterator()}
    for key, name in names.items():
        for part in _names(spark, f"{aside}/key={key}"):
            (a, fs), (p, _) = _fs(spark, f"{aside}/key={key}/{part}"), _fs(spark, f"{folder.rstrip('/')}/{name}")
            fs.mkdirs(p.getParent())
            if fs.exists(p):
                fs.delete(p, False)
            if not fs.rename(a, p):
                raise OSError(f"{name} was not written")
            moved += 1
    p, fs = _fs(spark, aside)
    fs.delete(p, True)
    return moved
