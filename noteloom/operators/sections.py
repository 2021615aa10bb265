"""Sections of pages: outline, chunks, one section, and the section store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions.text import HEADING, stripped

SKIPPED = ("index", "log")


def headings(pages: DataFrame) -> DataFrame:
    """name, line, level, section, ending: the headings of levels 2 to 4.
    ending is the line of the next one of no deeper level (null: none); each
    level has its own running minimum over the lines behind, so no self-join."""
    lines = pages.select("name", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    marks = lines.where(F.col("text").rlike(HEADING)).select(
        "name", "line", F.length(F.regexp_extract("text", HEADING, 1)).alias("level"), stripped(F.regexp_extract("text", HEADING, 2)).alias("section")
    )
    behind = Window.partitionBy("name").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    ends = {n: F.min(F.when(F.col("level") <= n, F.col("line"))).over(behind) for n in (2, 3, 4)}
    return marks.withColumn("ending", F.when(F.col("level") == 2, ends[2]).when(F.col("level") == 3, ends[3]).otherwise(ends[4]))


def outline(pages: DataFrame) -> DataFrame:
    """name, line, section, level, address."""
    return headings(pages).select("name", "line", "section", "level", F.concat("name", F.lit("#"), "section").alias("address"))


def _cut(content, first, ending):
    lines = F.split(content, "\n")
    return stripped(F.array_join(F.slice(lines, first + 1, F.coalesce(ending, F.size(lines)) - first), "\n"))


def chunk_sections(pages: DataFrame) -> DataFrame:
    """name, line, section, occurrence, chunk, content_hash: every section with
    its subsections; a page without headings is one section, __page__. Of equal
    headings on a page the occurrence tells which is meant."""
    pages = pages.where(~F.col("name").isin(*SKIPPED))
    marks = headings(pages)
    nth = F.row_number().over(Window.partitionBy("n", "section").orderBy("line"))
    cut = marks.withColumnRenamed("name", "n").withColumn("occurrence", nth).join(pages, F.col("n") == F.col("name"))
    parts = cut.select("name", "line", "section", "occurrence", _cut(F.col("content"), F.col("line"), F.col("ending")).alias("chunk"))
    whole = pages.join(marks.select(F.col("name").alias("n")).distinct(), F.col("name") == F.col("n"), "left_anti")
    whole = whole.select("name", F.lit(0).alias("line"), F.lit("__page__").alias("section"), F.lit(1).alias("occurrence"), stripped(F.col("content")).alias("chunk"))
    return parts.unionAll(whole).where("chunk <> ''").withColumn("content_hash", F.sha2("chunk", 256))


def section_read(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """name, asked, section, level, content: the first section of exactly that
    heading, else the first that holds it ignoring case; headings of level 1
    end it too. No row where there is none."""
    marks = headings(pages).select(F.col("name").alias("n"), "line", "level", "section")
    fits = (F.col("name") == F.col("n")) & F.lower("section").contains(F.lower("asked"))
    first = Window.partitionBy("name", "asked").orderBy(F.when(F.col("section") == F.col("asked"), 0).otherwise(1), "line")
    hit = wanted.join(marks, fits).withColumn("_r", F.row_number().over(first)).where("_r = 1").select("name", "asked", "line", "level", "section")
    text = pages.select(F.col("name").alias("n"), F.split("content", "\n").alias("lines"))
    upto = r"^(#{1,4})\s"
    joined = hit.join(text, F.col("name") == F.col("n"))
    numbered = F.transform("lines", lambda x, i: F.when((i > F.col("line")) & x.rlike(upto) & (F.length(F.regexp_extract(x, upto, 1)) <= F.col("level")), i))
    ending = F.coalesce(F.array_min(numbered), F.size("lines"))
    body = stripped(F.array_join(F.slice("lines", F.col("line") + 1, ending - F.col("line")), "\n"))
    return joined.select("name", "asked", "section", "level", body.alias("content"))


def upsert(stored: DataFrame, incoming: DataFrame, now) -> DataFrame:
    """The store after a run. Rows match on (concept, section, model_version).

    stored: key, content_hash, category, updated_at, content_changed_at.
    incoming: key, content_hash, category, source_mtime. action tells what
    happened: insert, update (the hash changed), touch, keep (not seen).
    """
    key = ["concept", "section", "model_version"]
    old = stored.select(*key, *(F.col(c).alias("o_" + c) for c in ("content_hash", "category", "updated_at", "content_changed_at")))
    new = incoming.select(*key, *(F.col(c).alias("n_" + c) for c in ("content_hash", "category", "source_mtime")))
    both = old.join(new, key, "full_outer")
    seen, known = F.col("n_content_hash").isNotNull(), F.col("o_content_hash").isNotNull()
    same = F.col("o_content_hash").eqNullSafe(F.col("n_content_hash"))
    action = F.when(~seen, "keep").when(~known, "insert").when(same, "touch").otherwise("update")
    return both.withColumn("action", action).select(
        *key,
        F.coalesce("n_content_hash", "o_content_hash").alias("content_hash"),
        F.when(F.col("action") == "update", F.col("n_category")).otherwise(F.coalesce("n_category", "o_category")).alias("category"),
        F.when(seen, now).otherwise(F.col("o_updated_at")).alias("updated_at"),
        F.when(F.col("action").isin("insert", "update"), now)
        .when(F.col("action") == "touch", F.coalesce("o_content_changed_at", "n_source_mtime"))
        .otherwise(F.col("o_content_changed_at"))
        .alias("content_changed_at"),
        "action",
    )


def sweep(store: DataFrame, model_version: str, since) -> DataFrame:
    """The store without rows of the model that the run did not see; unchanged
    if it saw none at all."""
    mine = F.col("model_version") == model_version
    seen = store.where(mine & (F.col("updated_at") >= since)).limit(1).count()
    return store if not seen else store.where(~mine | (F.col("updated_at") >= since))


def to_embed(diff: DataFrame) -> DataFrame:
    """The rows whose text needs a new vector."""
    return diff.where(F.col("action").isin("insert", "update"))
