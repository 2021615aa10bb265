"""Connected components of an edge table by alternating star contractions.

A star step deals the edges out by node, sorted by neighbour, and streams
through them: the first neighbour of a node tells its least one, so a step is
one shuffle and holds no group. Nodes of over a thousandth of all edges, fewer
than a thousand, are found by an aggregation and take no part in the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import HOT_SHARE, LEAST_HOT, distinct, dropped, written

FOREST_EDGES = 1 << 20
_EDGE = "a long, b long"


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes on edges, and the least node that each reaches."""
    nodes = distinct(np.concatenate([a, b]))
    x, y = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, label[x], least)
        np.minimum.at(after, label[y], least)
        after = after[after[after]]
        if np.array_equal(after, label):
            return nodes, nodes[label]
        label = after


def _forest(batches):
    """Edges that connect what those of a task do, one for each node at most."""
    held, n = [], 0
    for batch in batches:
        held.append((batch.column("a").to_numpy(zero_copy_only=False), batch.column("b").to_numpy(zero_copy_only=False)))
        n += len(batch)
        if n >= FOREST_EDGES:
            nodes, least = _labels(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held, n = [(nodes[nodes != least], least[nodes != least])], 0
            if 2 * len(held[0][0]) > FOREST_EDGES:
                yield _edges(*held[0])
                held = []
    if held:
        nodes, least = _labels(*(np.concatenate(c) for c in zip(*held, strict=True)))
        yield _edges(nodes[nodes != least], least[nodes != least])


def _star(large: bool):
    """Of rows (a, b) sorted so: a's neighbours go to the least of a and them.
    Large: the greater ones of both directions; small: those below a, and a. A
    loop tells that something has moved."""

    def run(batches):
        last_a = last_b = least = None
        for batch in batches:
            a, b = batch.column("a").to_numpy(zero_copy_only=False), batch.column("b").to_numpy(zero_copy_only=False)
            if not len(a):
                continue
            new = np.concatenate([[a[0] != last_a], a[1:] != a[:-1]])
            again = ~new & (np.concatenate([[last_b if last_b is not None else 0], b[:-1]]) == b)
            at = np.maximum.accumulate(np.where(new, np.arange(len(a)), -1))
            m = np.where(at >= 0, np.minimum(a, b)[at], least if least is not None else 0)
            last_a, last_b, least = a[-1], b[-1], m[-1]
            if large:
                keep = (b > a) & ~again
                moved = keep & (m < a)
                x, y = b[keep], m[keep]
            else:
                moved = ~new & ~again
                keep = new | moved
                x, y = np.where(new, a, b)[keep], m[keep]
            if moved.any():
                x, y = np.append(x, m[:1]), np.append(y, m[:1])
            yield _edges(x, y)

    return run


def _stepped(rows: DataFrame, large: bool, tasks: int) -> DataFrame:
    """One star step over rows (a, b), written."""
    counts = rows.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("m"), F.max("b").alias("top"))
    total = rows.count()
    hot = written(counts.where(F.col("n") > max(LEAST_HOT, total // HOT_SHARE)).select(F.col("a").alias("h"), F.least("m", "a").alias("m"), "top"), "cc-hot")
    some = hot.count()
    others, direct = rows, None
    if some:
        joined = rows.join(F.broadcast(hot), F.col("a") == F.col("h"), "left")
        others = joined.where("h is null").select("a", "b")
        met = joined.where("h is not null")
        if large:
            direct = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            direct = direct.unionAll(hot.where("m < h and top > h").select(F.col("m").alias("a"), F.col("m").alias("b")))
        else:
            direct = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(hot.select("h", "m")).unionAll(hot.where("m <> top").select("m", "m"))
    out = others.repartition(tasks, "a").sortWithinPartitions("a", "b").mapInArrow(_star(large), _EDGE)
    after = written(out if direct is None else out.unionAll(direct), "cc")
    dropped(hot)
    return after


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: for each node on an edge (a, b: long) but the least of its
    component, that least one. Edges with a null end, loops and repeated edges
    count for nothing; no edges give no rows.

    Each step is written to the shared folder, so a lost executor repeats one at
    most. Tasks first contract the edges they read. Rounds grow with the
    logarithm of the longest path; RuntimeError after most_rounds.
    """
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    now = written(edges.select("a", "b").where("a <> b").mapInArrow(_forest, _EDGE), "cc")
    for _ in range(most_rounds):
        if not now.limit(1).count():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        plain = now.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        large = _stepped(plain.unionAll(plain.select("b", "a")), True, tasks)
        small = _stepped(large.where("a <> b"), False, tasks)
        settled = not large.unionAll(small).where("a = b").limit(1).count()
        dropped(now, large)
        now = small
        if settled:
            return now.distinct().select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
