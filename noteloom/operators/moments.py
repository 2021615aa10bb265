"""Recall moments: events of tools and prompts, and what each should ask for.

A prompt asks by its text, the first edit of a code file by its path and change,
and a decision (commit, push, deploy) by its kind, the files last touched and
its message, unless its gate is open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions.text import clean_prompt, decision_kind, prompt_passes
from noteloom.operators.recall import COOLDOWN_S, bash_query, edit_query, first_edits, gates, last_files

EVENT = "event_id bigint, ts timestamp, session_id string, prompt string, tool_input struct<file_path: string, new_string: string, content: string, command: string>"


def hook_events(lines: DataFrame) -> DataFrame:
    """event_id, ts, session, prompt, path, change, command of lines(value:
    JSON objects). Lines that are not such objects say nothing and go; a
    missing session is "unknown", a missing event_id a hash of the line."""
    read = lines.select("value", F.from_json("value", EVENT, {"mode": "PERMISSIVE"}).alias("e")).where("e is not null")
    tool = "e.tool_input"
    return read.select(
        F.coalesce("e.event_id", F.xxhash64("value")).alias("event_id"),
        "e.ts",
        F.coalesce(F.nullif("e.session_id", F.lit("")), F.lit("unknown")).alias("session"),
        "e.prompt",
        F.replace(F.col(f"{tool}.file_path"), F.lit("\\"), F.lit("/")).alias("path"),
        F.coalesce(F.nullif(f"{tool}.new_string", F.lit("")), f"{tool}.content").alias("change"),
        F.col(f"{tool}.command").alias("command"),
    ).where("prompt is not null or path is not null or command is not null")


def asked(events: DataFrame, cooldown_s: float = COOLDOWN_S) -> DataFrame:
    """event_id, ts, session, moment (prompt, edit, commit, push, deploy), text
    of the events that ask for something. A decision within the cooldown of one
    of its session and kind that asked passes in silence; only the files of
    first edits before it count as touched."""
    said = clean_prompt(F.col("prompt"))
    shown = ["event_id", "ts", "session"]
    prompts = events.where("prompt is not null").where(prompt_passes(said)).select(*shown, F.lit("prompt").alias("moment"), said.alias("text"))
    edits = last_files(first_edits(events.where("path is not null")))
    changes = edits.select(*shown, F.lit("edit").alias("moment"), edit_query(F.col("path"), F.col("change")).alias("text"))
    decisions = events.where("command is not null").withColumn("kind", decision_kind(F.col("command"))).where("kind is not null")
    blocked = gates(decisions, cooldown_s).where("not passed").select(F.col("event_id").alias("b"))
    decisions = decisions.join(blocked, F.col("event_id") == F.col("b"), "left_semi").select(*shown, "kind", "command", F.lit(None).cast("array<string>").alias("files"))
    # the files as of each decision: the last list before it in its session
    touched = decisions.unionByName(edits.select(*shown, F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("command"), "files"))
    so_far = Window.partitionBy("session").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    as_of = touched.withColumn("files", F.last("files", ignorenulls=True).over(so_far)).where("kind is not null")
    none = F.array().cast("array<string>")
    acts = as_of.select(*shown, F.col("kind").alias("moment"), bash_query(F.col("kind"), F.coalesce("files", none), F.col("command")).alias("text"))
    return prompts.unionByName(changes).unionByName(acts)


def once_a_session(hits: DataFrame, seen: DataFrame, most: int) -> DataFrame:
    """hits(event_id, ts, session, name, score, ...) that are new to their
    session: a page goes to the first event that finds it, and an event keeps
    its `most` best."""
    gone = seen.select(F.col("session").alias("ss"), F.col("name").alias("sn"))
    rows = hits.join(gone, (F.col("session") == F.col("ss")) & (F.col("name") == F.col("sn")), "left_anti")
    first = F.row_number().over(Window.partitionBy("session", "name").orderBy("ts", "event_id", F.desc("score")))
    rank = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("score"), "name"))
    return rows.withColumn("_r", first).where("_r = 1").drop("_r").withColumn("rank", rank).where(F.col("rank") <= most)
