"""Streaming twins of the recall operators, and incremental sync."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from noteloom.operators.recall import COOLDOWN_S, is_code

SNAPSHOT_S = 300.0
_OUT = StructType([StructField("event_id", LongType()), StructField("passed", LongType())])


class GateProcessor(StatefulProcessor):
    """Start of the open gate of each (session, kind)."""

    def __init__(self, cooldown_s: float):
        self.cooldown_s = cooldown_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.start = handle.getValueState("start", StructType([StructField("t", DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["t", "event_id"])
        last = self.start.get()[0] if self.start.exists() else None
        passed = []
        for t in batch["t"]:
            through = last is not None and t - last < self.cooldown_s
            if not through:
                last = t
            passed.append(int(through))
        self.start.update((float(last),))
        yield pd.DataFrame({"event_id": batch["event_id"], "passed": passed})

    def close(self) -> None:
        pass


def gate_stream(events: DataFrame, cooldown_s: float = COOLDOWN_S) -> DataFrame:
    """event_id, passed (0/1) for events(session, kind, ts, event_id). Order
    holds within a micro-batch and between them; a late event is judged against
    the gate as it stands."""
    rows = events.select("session", "kind", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "event_id")
    return rows.groupBy("session", "kind").transformWithStateInPandas(GateProcessor(cooldown_s), _OUT, "Append", "None")


class LastFilesProcessor(StatefulProcessor):
    """The last files of each session, oldest first."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.files = handle.getListState("files", StructType([StructField("path", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [r[0] for r in self.files.get()] if self.files.exists() else []
        batch = pd.concat(list(rows)).sort_values(["t", "event_id"])
        lists = []
        for path in batch["path"]:
            held = [*held, path][-self.most :]
            lists.append(held)
        self.files.put([(p,) for p in held])
        yield pd.DataFrame({"event_id": batch["event_id"], "files": lists})

    def close(self) -> None:
        pass


def last_files_stream(edits: DataFrame, most: int = 5) -> DataFrame:
    """event_id, files for the first edits(session, path, ts, event_id): the
    paths of the session's last `most` up to each. Order as in gate_stream."""
    rows = edits.select("session", "path", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "event_id")
    out = StructType([StructField("event_id", LongType()), StructField("files", ArrayType(StringType()))])
    return rows.groupBy("session").transformWithStateInPandas(LastFilesProcessor(most), out, "Append", "None")


class TimedSnapshot:
    """A static side of a stream that is loaded anew once it is older than
    ttl_s. A load that fails keeps the one before (None at first), and is not
    tried again before the time is up. To be asked in foreachBatch."""

    def __init__(self, load: Callable[[], DataFrame], ttl_s: float = SNAPSHOT_S, clock: Callable[[], float] = time.monotonic):
        self.load, self.ttl_s, self.clock = load, ttl_s, clock
        self.held: DataFrame | None = None
        self.at: float | None = None

    def get(self) -> DataFrame | None:
        now = self.clock()
        if self.at is None or now - self.at >= self.ttl_s:
            self.at = now
            try:
                fresh = self.load().persist()
                fresh.count()
            except Exception:
                return self.held
            if self.held is not None:
                self.held.unpersist()
            self.held = fresh
        return self.held


def first_edit_stream(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first event seen of each session and code file, within the delay."""
    code = events.where(is_code(F.col("path"))).withColumn("ts", F.col("ts").cast("timestamp"))
    return code.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session", "path"])


def new_hits_stream(hits: DataFrame, least: float, delay: str = "1 day") -> DataFrame:
    """Hits over the threshold, each name once a session within the delay."""
    rows = hits.where(F.col("score") >= least).withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session", "name"])


def sync_stream(files: DataFrame, sync: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Runs sync on the changed files of each micro-batch, at least once; an
    upsert by key makes that exact."""
    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: sync(batch)).trigger(availableNow=True).start()
