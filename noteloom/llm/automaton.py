"""Suffix automata over word hashes, and removal of passages that a bounded
reference holds.

The reference is cut into shards of at most SHARD_WORDS words; each shard's
automaton is built once and broadcast, and every document is streamed past it
for matching statistics (at each word, the longest suffix that occurs in the
shard). Spans of at least min_words are removed, each as one maximal span.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import slices

SHARD_WORDS = 200_000
REFERENCE_WORDS = 2_000_000


class SuffixAutomaton:
    """Automaton of all factors of several word sequences."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[int]) -> None:
        last = 0
        nxt, link, length = self.next, self.link, self.length
        for c in words:
            q = nxt[last].get(c)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._clone(last, q, c)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
            last = cur

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def statistics(self, words: list[int]) -> list[int]:
        """For each word, the length of the longest match that ends there."""
        nxt, link, length = self.next, self.link, self.length
        out, state, n = [], 0, 0
        for c in words:
            while state and c not in nxt[state]:
                state = link[state]
                n = length[state]
            to = nxt[state].get(c)
            if to is None:
                state, n = 0, 0
            else:
                state, n = to, n + 1
            out.append(n)
        return out


def covered(statistics: list[int], min_words: int) -> np.ndarray:
    """Words inside some match of at least min_words."""
    marks = np.zeros(len(statistics) + 1, dtype=np.int64)
    for i, n in enumerate(statistics):
        if n >= min_words:
            marks[i + 1 - n] += 1
            marks[i + 1] -= 1
    return np.cumsum(marks[:-1]) > 0


def remove_reference_passages(docs: DataFrame, reference: DataFrame, min_words: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: docs without the spans of at
    least min_words words that occur in a reference text.

    Null texts count as empty; every input row gives one row, repeated ids
    included. The reference must hold at most REFERENCE_WORDS words (checked
    before it is read to the driver; ValueError beyond).
    """
    spark = docs.sparkSession
    texts = reference.select(F.col("text").alias("t")).where("t is not null").distinct()
    n = texts.agg(F.sum(F.size(F.split("t", "[ \\t-\\r]+")))).first()[0] or 0
    if n > REFERENCE_WORDS:
        raise ValueError(f"the reference holds {n} words, over {REFERENCE_WORDS}")
    column = pa.array(sorted(r["t"] for r in texts.collect()), pa.string())
    shards: list[SuffixAutomaton] = [SuffixAutomaton()]
    held = 0
    for i, j, run in slices(column):
        for k in range(j - i):
            words = run.hashes[run.first[k] : run.first[k + 1]].tolist()
            if held and held + len(words) > SHARD_WORDS:
                shards.append(SuffixAutomaton())
                held = 0
            shards[-1].add(words)
            held += len(words)
    sent = [spark.sparkContext.broadcast(s) for s in shards]

    def stream(batches):
        for batch in batches:
            for i, j, run in slices(batch.column("t")):
                n_words, n_removed, kept = [], [], []
                for k in range(j - i):
                    a, b = run.first[k], run.first[k + 1]
                    words = run.hashes[a:b].tolist()
                    gone = np.zeros(b - a, dtype=bool)
                    for s in sent:
                        gone |= covered(s.value.statistics(words), min_words)
                    spans = zip(run.starts[a:b][~gone].tolist(), run.ends[a:b][~gone].tolist(), strict=True)
                    kept.append(b" ".join(run.data[x:y].tobytes() for x, y in spans).decode())
                    n_words.append(int(b - a))
                    n_removed.append(int(gone.sum()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_text"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t")).mapInArrow(
        stream, "doc_id long, n_words long, n_removed long, kept_text string"
    )
