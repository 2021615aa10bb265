"""One event at a time, with the state of its session in a file.

The operators are those of a batch of events (operators.moments); the state
says what the session has seen, which files it has touched and when its gates
opened, so that single calls add up to what the batch gives.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import functions as F

from noteloom.engine import KnowledgeBase
from noteloom.functions.text import safe_session
from noteloom.operators import moments
from noteloom.operators.recall import rendered
from noteloom.sources import tables

STATE = "event_id bigint, ts timestamp, session string, prompt string, path string, change string, command string"


class Hooks:
    def __init__(self, base: KnowledgeBase, clock: Callable[[], float] = time.time):
        self.base, self.spark, self.clock = base, base.spark, clock

    def _path(self, session: str) -> str:
        safe = self.spark.range(1).select(safe_session(F.lit(session))).first()[0]
        return f"{self.base.store}/sessions/{safe}.json"

    def load(self, session: str) -> dict[str, Any]:
        """The state of a session; a new one for none, or one that is damaged."""
        try:
            held = json.loads(tables.read_text(self.spark, self._path(session)))
            return {"seen": list(held["seen"]), "files": list(held["files"]), "gates": dict(held["gates"])}
        except Exception:
            return {"seen": [], "files": [], "gates": {}}

    def save(self, session: str, state: dict[str, Any]) -> None:
        """Whole or not at all; the last writer wins, and a failure is no reason
        to disturb the session."""
        try:
            tables.write_text(self.spark, self._path(session), json.dumps(state, ensure_ascii=False))
        except Exception:
            pass

    def run(self, line: str, header: str = "From the notes:") -> tuple[str, str] | None:
        """(moment, text to show) for a line of JSON; None if there is nothing
        to say, as for a line that is not an event."""
        event = moments.hook_events(self.spark.createDataFrame([(line,)], "value string")).first()
        if event is None:
            return None
        state, now = self.load(event.session), self.clock()
        if event.path is not None and event.path in state["files"]:
            return None
        # the session so far, as events before this one
        rows = [(i, None, event.session, None, f, None, None) for i, f in enumerate(state["files"])]
        rows.append((len(rows), None, event.session, event.prompt, event.path, event.change, event.command))
        at = F.timestamp_seconds(F.lit(now) + F.col("event_id") / 1e6)
        events = self.spark.createDataFrame(rows, STATE).withColumn("ts", at)
        asks = [r for r in moments.asked(events).collect() if r.event_id == len(rows) - 1]
        if not asks:
            return None
        ask = asks[0]
        decision = ask.moment not in ("prompt", "edit")
        if decision and now - state["gates"].get(ask.moment, -1e18) < self.base.config.recall.gate_cooldown_s:
            return None
        seen = self.spark.createDataFrame([(event.session, n) for n in state["seen"]], "session string, name string")
        asked = self.spark.createDataFrame([(event.session, ask.text)], "session string, text string")
        picked = self.base.recall_hits(asked, seen, ask.moment != "prompt").collect()
        if ask.moment == "edit":
            state["files"].append(event.path)
        if decision:
            state["gates"][ask.moment] = now
        state["seen"] = sorted({*state["seen"], *(r.name for r in picked)})
        if picked or ask.moment != "prompt":
            self.save(event.session, state)
        if not picked:
            return None
        text = rendered(self.spark.createDataFrame(picked), header, tuple(self.base.config.recall.failure_categories)).first().text
        return ask.moment, text
