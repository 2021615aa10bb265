"""Folders of markdown files as pages, and what changed since a manifest."""

from __future__ import annotations

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteloom.functions.text import file_hash, path_category

HEADER = r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"
PARSED = "header_ok boolean, node_type string, tags array<string>, related array<string>, metadata map<string,string>"


def scan(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """path (below root), content, mtime, size of every file that is not empty
    (Spark's readers leave out files of no bytes); contents are only read if
    used."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/").split("://")[-1].rstrip("/")
    below = F.substring_index("path", base + "/", -1)
    return found.select(below.alias("path"), F.col("content").cast("string").alias("content"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def _parse(raw: str | None) -> tuple:
    try:
        data = yaml.safe_load(raw) if raw else {}
    except yaml.YAMLError:
        return False, None, [], [], {}
    if not isinstance(data, dict):
        data = {}
    tags, related = ([str(x) for x in (v if isinstance(v, list) else [v]) if x is not None] for v in (data.get("tags") or [], data.get("related") or []))
    kind = data.get("type")
    return True, "unknown" if kind is None else str(kind), tags, related, {str(k): str(v) for k, v in data.items()}


def _headed(files: DataFrame) -> DataFrame:
    """files with the struct h of their parsed headers; the texts stay in the JVM."""

    @F.pandas_udf(PARSED)
    def parsed(headers: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_parse(h) for h in headers], columns=[c.split()[0] for c in PARSED.split(", ")])

    return files.withColumn("h", parsed(F.regexp_extract("content", HEADER, 1)))


def parsed_pages(files: DataFrame) -> DataFrame:
    """name, path, category, node_type, tags, related, metadata, has_header,
    content, mtime of each file whose header parses (see rejected)."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    body = F.regexp_replace(F.regexp_replace("content", HEADER, ""), r"^\s+|\s+$", "")
    return _headed(files).where("h.header_ok").select(
        stem.alias("name"), "path", path_category(F.col("path")).alias("category"), "h.node_type", "h.tags", "h.related", "h.metadata", (F.size("h.metadata") > 0).alias("has_header"), body.alias("content"), "mtime"
    )


def pages(files: DataFrame) -> DataFrame:
    """The pages of files; of those with one name that with the greatest path."""
    return latest(parsed_pages(files))


def latest(rows: DataFrame) -> DataFrame:
    """Of parsed pages with one name that with the greatest path."""
    last = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("path")))
    return rows.withColumn("_r", last).where("_r = 1").drop("_r")


def refreshed(held: DataFrame, files: DataFrame, manifest: DataFrame) -> DataFrame:
    """parsed_pages of files, where `held` are those of an earlier listing
    (manifest: path, mtime): only added and changed files are read and parsed,
    deleted ones go."""
    changed = changes(files.select("path", "mtime"), manifest).select(F.col("path").alias("cp"))
    same = held.join(changed, F.col("path") == F.col("cp"), "left_anti")
    again = files.join(changed, F.col("path") == F.col("cp"), "left_semi")
    return same.unionByName(parsed_pages(again))


def rejected(files: DataFrame) -> DataFrame:
    """Paths of files whose header does not parse."""
    return _headed(files.select("path", "content")).where("NOT h.header_ok").select("path")


def changes(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, change (added, changed, deleted) of two listings (path, mtime)."""
    new = listing.select(F.col("path").alias("np"), F.col("mtime").alias("nm"))
    old = manifest.select(F.col("path").alias("op"), F.col("mtime").alias("om"))
    kind = F.when(F.col("op").isNull(), "added").when(F.col("np").isNull(), "deleted").when(F.col("nm") != F.col("om"), "changed")
    return new.join(old, F.col("np") == F.col("op"), "full_outer").select(F.coalesce("np", "op").alias("path"), kind.alias("change")).where("change is not null")


def needs_rebuild(listing: DataFrame, manifest: DataFrame) -> bool:
    return bool(changes(listing, manifest).limit(1).count())


def to_ingest(raw: DataFrame, state: DataFrame) -> DataFrame:
    """rel, content, hash of raw files not yet ingested in this version; files
    that failed before are tried again."""
    done = state.where("status = 'ingested'").select(F.col("rel").alias("r"), F.col("hash").alias("h"))
    named = raw.select(F.col("path").alias("rel"), "content", file_hash(F.col("content")).alias("hash"))
    return named.join(done, (F.col("rel") == F.col("r")) & (F.col("hash") == F.col("h")), "left_anti")


def ingest_stats(state: DataFrame) -> DataFrame:
    return state.groupBy("status").agg(F.count("*").alias("files"))


def ingest_counts(raw: DataFrame, made: DataFrame, raw_written: int = 0) -> DataFrame:
    """One row: raw_written, wiki_written, skipped and errors of a run that saw
    raw (rel) and made (rel, text, error) of those not done before."""
    n = raw.select("rel").distinct().agg(F.count("*").alias("n"))
    done = made.agg(F.count("text").alias("wiki_written"), F.count("error").alias("errors"), F.count("*").alias("m"))
    return n.join(done).select(F.lit(raw_written).cast("long").alias("raw_written"), "wiki_written", (F.col("n") - F.col("m")).alias("skipped"), "errors")
