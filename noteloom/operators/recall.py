"""Session-aware recall over batches of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits, file kinds, skipped paths and hints of the recall model.
MOST_PICKED = 6
COOLDOWN_S = 1800.0
CODE_EXTENSIONS = ("py", "js", "jsx", "ts", "tsx", "go", "rs", "java", "sql", "yml", "yaml", "sh", "ps1", "toml", "conf")
SKIPPED_PATHS = ("/raw/", "/wiki/", "/node_modules/", "/.git/", "/scratchpad/")
HINTS = {
    "commit": "commit unverified half-done 提交前 未驗證",
    "push": "push deploy verify 推送 部署 驗證",
    "deploy": "deploy health check regression 部署 健康檢查 回歸",
}


def pick(hits: DataFrame, seen: DataFrame, least: float, categories: tuple[str, ...] | None = None, most: int = MOST_PICKED) -> DataFrame:
    """session, name, score, rank and the other columns of hits: the best hits
    a session has not seen, once a name, of the given categories only."""
    rows = hits.where(F.col("score") >= least)
    if categories is not None:
        rows = rows.where(F.col("category").isin(*categories))
    gone = seen.select(F.col("session").alias("ss"), F.col("name").alias("sn"))
    rows = rows.join(gone, (F.col("session") == F.col("ss")) & (F.col("name") == F.col("sn")), "left_anti")
    more = [c for c in rows.columns if c not in ("session", "name", "score")]
    best = F.max_by(F.struct(*more), "score") if more else F.lit(None)
    first = rows.groupBy("session", "name").agg(F.max("score").alias("score"), best.alias("_m")).select("session", "name", "score", *(F.col(f"_m.{c}").alias(c) for c in more))
    rank = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("score"), "name"))
    return first.withColumn("rank", rank).where(F.col("rank") <= most)


def is_code(path: Column) -> Column:
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    kept = F.lower(F.regexp_extract(plain, r"\.([A-Za-z0-9]+)$", 1)).isin(*CODE_EXTENSIONS)
    for part in SKIPPED_PATHS:
        kept = kept & ~plain.contains(part)
    return kept


def first_edits(events: DataFrame) -> DataFrame:
    """The first event of each session and code file (session, path, ts)."""
    order = Window.partitionBy("session", "path").orderBy("ts", "event_id")
    return events.where(is_code(F.col("path"))).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def last_files(edits: DataFrame, most: int = 5) -> DataFrame:
    """edits(session, path, ts, event_id) with files: the paths of the session's
    last `most` first edits up to each, oldest first."""
    frame = Window.partitionBy("session").orderBy("ts", "event_id").rowsBetween(1 - most, Window.currentRow)
    return edits.withColumn("files", F.collect_list("path").over(frame))


def rendered(picked: DataFrame, header: str, failures: tuple[str, ...] = (), mark: str = "[failure] ") -> DataFrame:
    """session, text: the picked pages of each session (rank, name, score,
    category, section, snippet) as a numbered list under a header; pages of the
    failure categories are marked."""
    marked = F.when(F.col("category").isin(*failures), mark).otherwise("") if failures else F.lit("")
    line = F.format_string("%d. %s**%s** (score=%.2f) § %s — %s", F.col("rank"), F.coalesce(marked, F.lit("")), F.col("name"), F.col("score"), F.coalesce("section", F.lit("")), F.left(F.coalesce("snippet", F.lit("")), F.lit(140)))
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return picked.groupBy("session").agg(F.concat_ws("\n", F.lit(header), F.transform(lines, lambda x: x["line"])).alias("text"))


def edit_query(path: Column, change: Column) -> Column:
    """The last two folders, the file's stem and the start of the change."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    folders = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.least(F.size(parts) - 1, F.lit(2))), " ")
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    plain = F.left(F.regexp_replace(F.left(F.coalesce(change, F.lit("")), F.lit(1000)), r"\s+", " "), F.lit(200))
    return F.concat(folders, F.lit(" "), stem, F.lit(" "), plain)


def bash_query(kind: Column, files: Column, command: Column) -> Column:
    """The hint of a decision, the stems of the last five files, the message."""
    hint = F.lit("")
    for name, text in HINTS.items():
        hint = F.when(kind == name, text).otherwise(hint)
    last = F.slice(files, F.greatest(F.size(files) - 4, F.lit(1)), F.lit(5))
    stems = F.transform(last, lambda f: F.regexp_replace(F.regexp_extract(f, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""))
    return F.concat(hint, F.lit(" "), F.array_join(stems, " "), F.lit(" "), F.regexp_extract(command, "-m\\s+[\"']([^\"']{0,160})", 1))


def gates(events: DataFrame, cooldown_s: float = COOLDOWN_S) -> DataFrame:
    """event_id, passed: whether an event is let through unchecked. The first of
    a session and kind starts a gate (passed false) and all within the
    cooldown after it pass; the next one starts the gate anew.

    The recurrence needs a group's events in order. Groups are sorted by Spark
    and stream through the task, so none is held in memory.
    """
    epoch = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, last = None, 0.0
        for batch in batches:
            passed = []
            for key, t in zip(zip(batch["session"], batch["kind"], strict=True), batch["t"], strict=True):
                through = key == group and t - last < cooldown_s
                if not through:
                    group, last = key, t
                passed.append(through)
            yield pd.DataFrame({"event_id": batch["event_id"], "passed": passed})

    rows = events.select("session", "kind", epoch, "event_id").repartition("session", "kind").sortWithinPartitions("session", "kind", "t", "event_id")
    return rows.mapInPandas(walk, "event_id long, passed boolean")
