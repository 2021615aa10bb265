"""Exact vector search over sections(concept, section, vec, model_version).

Queries come in blocks of a bounded number of bytes, which are broadcast one
after another; a task multiplies its sections with the block, an Arrow batch at
a time, and keeps the k best sections of each query, so the one shuffle holds k
rows a query and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BYTES = 16 << 20
#: Scores that a task holds at once.
MOST_SCORES = 1 << 21
HITS = "query_id long, concept string, section string, score double"


def _rows(vectors: pd.Series | list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each vector length: which rows, and their matrix."""
    width = np.array([-1 if v is None else len(v) for v in vectors], dtype=np.int64)
    found = {}
    for w in sorted(set(width.tolist()) - {-1, 0}):
        at = np.flatnonzero(width == w)
        found[w] = at, np.array([vectors[i] for i in at], dtype=np.float64)
    return found


def _first(score: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the k greatest of their row, the first of equal
    ones; not-a-number is none."""
    score = np.where(np.isnan(score), -np.inf, score)
    if score.shape[1] <= k:
        return score > -np.inf
    cut = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k, None]
    equal = score == cut
    room = k - (score > cut).sum(axis=1, keepdims=True)
    return ((score > cut) | equal & (np.cumsum(equal, axis=1) <= room)) & (score > -np.inf)


def _searched(sent, k: int, decimals: int | None):
    def best(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["query_id", "score", "concept", "section"], ascending=[True, False, True, True], kind="stable", na_position="first")
        return rows[rows.groupby("query_id").cumcount() < k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        most = max(1, MOST_SCORES // max(1, sum(len(ids) for ids, _ in asked.values())))
        held = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "concept": pd.Series(dtype=object), "section": pd.Series(dtype=object), "score": pd.Series(dtype="float64")})
        for whole in batches:
            for at in range(0, len(whole), most):
                # in the order that decides between equal scores
                part = whole.slice(at, most).to_pandas().sort_values(["concept", "section"], na_position="first", ignore_index=True)
                new = [held]
                for w, (rows, x) in _rows(part["vec"].tolist()).items():
                    if w not in asked:
                        continue
                    ids, q = asked[w]
                    with np.errstate(invalid="ignore", divide="ignore"):
                        score = (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :])
                    score[~np.isfinite(score)] = np.nan
                    if decimals is not None:
                        score = np.round(score, decimals)
                    a, b = np.nonzero(_first(score, k))
                    new.append(pd.DataFrame({"query_id": ids[a], "concept": part["concept"].to_numpy()[rows[b]], "section": part["section"].to_numpy()[rows[b]], "score": score[a, b]}))
                if len(new) > 1:
                    held = best(pd.concat([n for n in new if len(n)] or [held], ignore_index=True))
        yield pa.RecordBatch.from_pandas(held, schema=pa.schema([("query_id", pa.int64()), ("concept", pa.string()), ("section", pa.string()), ("score", pa.float64())]), preserve_index=False)

    return run


def vector_search(sections: DataFrame, queries: DataFrame, k: int = 15, model_version: str | None = None, decimals: int | None = None) -> DataFrame:
    """query_id, rank, concept, section, score: the k nearest sections by
    cosine, ties to the smaller concept and section; scores rounded first if
    decimals are given.

    Null and zero vectors take no part, vectors of different lengths are not
    compared. Queries (query_id: whole numbers) are a stated set: they pass the
    driver in blocks of BLOCK_BYTES, each one scan of the sections.
    """
    spark = sections.sparkSession
    if model_version is not None:
        sections = sections.where(F.col("model_version") == model_version)
    held = sections.where("vec is not null").select("concept", "section", F.col("vec").cast("array<double>").alias("vec"))
    kind = queries.schema["query_id"].dataType.simpleString()
    asked = queries.where("vec is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("vec").cast("array<double>").alias("vec"))
    found, block, size = [], [], 0

    def search() -> None:
        vecs = [b[1] for b in block]
        ids = np.array([b[0] for b in block], dtype=np.int64)
        sent = spark.sparkContext.broadcast({w: (ids[rows], q) for w, (rows, q) in _rows(vecs).items()})
        found.append(held.mapInArrow(_searched(sent, k, decimals), HITS))

    for row in asked.toLocalIterator(prefetchPartitions=True):
        block.append((row["query_id"], row["vec"]))
        size += 8 * len(row["vec"])
        if size >= BLOCK_BYTES:
            search()
            block, size = [], 0
    if block or not found:
        search()
    every = found[0]
    for f in found[1:]:
        every = every.unionAll(f)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "concept", "section")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("query_id").cast(kind).alias("query_id"), "rank", "concept", "section", "score")


def best_section(hits: DataFrame) -> DataFrame:
    """The best hit of each query and concept, earlier ranks first on ties."""
    order = Window.partitionBy("query_id", "concept").orderBy(F.desc("score"), "rank")
    return hits.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
