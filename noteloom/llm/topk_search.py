"""Exact top-k by integer inner product, pruned by segment statistics.

A vector is cut into segments; with the mean m and deviation d of each segment
of length n, Cauchy-Schwarz gives q.x <= sum of n * (mq * mx + dq * dx). Queries
that are near each other form groups of GROUP or more. A chunk of candidates is
bounded for a group with few segments, then with more, and only candidates that
can still reach the k-th score of some query of the group get exact products.
The k-th scores start from those among SEED_ROWS rows of the table.

Queries are broadcast in blocks of at most QUERY_BYTES; every task passes its
rows of the table by a block and keeps k rows a query, so one shuffle of k rows
a query and task remains.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.llm.common import distinct, freed, table, written

QUERY_BYTES = 32 << 20
GROUP, MOST_GROUPS = 16, 1024
SEED_ROWS = 4096
CANDIDATES = 1024
LEVELS = (4, 16)
SCALE = 1024


def clean_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v: rows with an id, without null or non-finite components."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return plain.where("vec_id is not null and v is not null").where(finite)


def by_width(batch: pa.RecordBatch, ids: str = "vec_id", values: str = "v"):
    """(ids, matrix) for each vector length in a batch."""
    column = batch.column(values)
    at = column.offsets.to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    names = batch.column(ids).to_numpy(zero_copy_only=False)
    at, width = at - at[0] if len(at) else at, np.diff(at)
    for w in distinct(width).tolist():
        rows = np.flatnonzero(width == w)
        yield names[rows], flat[at[rows][:, None] + np.arange(w)].reshape(len(rows), w)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Scaled means and deviations: their inner products bound those of x."""
    out = []
    for part in np.array_split(x, min(segments, max(1, x.shape[1])), axis=1):
        n = max(1, part.shape[1])
        out += [part.sum(axis=1) / np.sqrt(n), np.sqrt(np.maximum((part * part).sum(axis=1) - part.sum(axis=1) ** 2 / n, 0))]
    return np.stack(out, axis=1)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products; doubles where they cannot round."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    if most < 2.0**53:
        return (q @ x.T).astype(np.int64)
    if most >= 2.0**63:
        raise OverflowError("scores do not fit a long")
    return q.astype(np.int64) @ x.astype(np.int64).T


class Best:
    """The k best (score, smaller id first) of every query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.floor = np.full(queries, -np.inf)
        self.rows = [np.empty(0, np.int64)] * 3

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query, score, ids = (np.concatenate(p) for p in zip(self.rows, (query, score, ids), strict=True))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        first = np.searchsorted(query, query)
        rank = np.arange(len(query)) - first
        full = rank == self.k - 1
        self.floor[query[full]] = score[full]
        keep = rank < self.k
        self.rows = [query[keep], score[keep], ids[keep]]


class Group:
    """Queries of one length that are near each other, and their best so far."""

    def __init__(self, names: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.names, self.q = names, q
        self.levels = [statistics(q, s) for s in LEVELS]
        self.best = Best(len(names), k)
        if floor is not None:
            self.best.floor = floor.copy()
        self.computed = 0

    def look(self, ids: np.ndarray, x: np.ndarray, stats: list[np.ndarray]) -> None:
        """Take candidates, with their statistics at each level, into account."""
        need, k = self.best.floor[:, None], self.best.k
        alive = np.arange(len(ids))
        for mine, theirs in zip(self.levels, stats, strict=True):
            bound = mine @ theirs[alive].T
            alive = alive[(bound + 1e-9 * np.abs(bound) + 1e-3 >= need).any(axis=0)]
        if not len(alive):
            return
        self.computed += len(alive)
        ids = ids[alive]
        score = _products(self.q, x[alive])
        valid = self.names[:, None] != ids[None, :]
        cut = need
        if score.shape[1] > k:
            others = np.where(valid, score, np.iinfo(np.int64).min)
            cut = np.maximum(need, np.partition(others, score.shape[1] - k, axis=1)[:, score.shape[1] - k, None])
        a, b = np.nonzero(valid & (score >= cut))
        if len(a):
            self.best.add(a, score[a, b], ids[b])


def grouped(names: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> list[Group]:
    """Groups of queries: each goes to the nearest of some of them, at most
    MOST_GROUPS, and groups that are too large are cut."""
    if not len(q):
        return []
    pivots = q[np.random.default_rng(1).permutation(len(q))[: max(1, min(MOST_GROUPS, len(q) // GROUP))]].astype(np.float64)
    most = 2 * max(GROUP, len(q) // len(pivots))
    to = np.empty(len(q), dtype=np.int64)
    for at in range(0, len(q), CANDIDATES):
        part = q[at : at + CANDIDATES].astype(np.float64)
        to[at : at + CANDIDATES] = np.argmin((pivots * pivots).sum(axis=1)[None, :] - 2 * part @ pivots.T, axis=1)
    order = np.argsort(to, kind="stable")
    cuts = [0]
    for i in range(1, len(order)):
        if to[order[i]] != to[order[i - 1]] or i - cuts[-1] >= most:
            cuts.append(i)
    return [Group(names[o], q[o], k, floor[o]) for o in np.split(order, cuts[1:])]


def pass_by(groups: list[Group], ids: np.ndarray, x: np.ndarray) -> None:
    """All candidates of one length past the groups of that length."""
    for at in range(0, len(ids), CANDIDATES):
        some, part = ids[at : at + CANDIDATES], x[at : at + CANDIDATES]
        stats = [statistics(part, s) for s in LEVELS]
        for g in groups:
            g.look(some, part, stats)


def _search(sent, k: int):
    def run(batches):
        held = {w: grouped(names, q, k, floor) for w, (names, q, floor) in sent.value.items()}
        for batch in batches:
            for ids, x in by_width(batch):
                if x.shape[1] in held:
                    pass_by(held[x.shape[1]], ids, np.floor(SCALE * x))
        for g in (g for groups in held.values() for g in groups):
            query, score, ids = g.best.rows
            yield pa.RecordBatch.from_arrays([pa.array(g.names[query]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])
        freed()

    return run


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of
    floor(1024 * x) for each query, ties to the smaller vec_id.

    Rows that are null, have a null id or null or non-finite components take no
    part, as query or candidate. Rows that share the query's vec_id count as
    its own and are left out; of several query rows of an id the least vector
    is taken; repeated candidates appear as often as they are there. Vectors of
    different lengths are never compared. Empty tables give an empty result.
    Scores that may not fit a long are an error. Other columns are not read.
    """
    spark = vectors.sparkSession
    asked = clean_vectors(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    bytes_ = asked.agg(F.sum(8 * F.size("v"))).first()[0] or 0
    blocks = max(1, -(-bytes_ // QUERY_BYTES))
    table_ = clean_vectors(vectors)
    seed = {x.shape[1]: (ids, np.floor(SCALE * x)) for batch in table_.limit(SEED_ROWS).toArrow().combine_chunks().to_batches() for ids, x in by_width(batch)}
    if blocks > 1:
        asked = written(asked, "op2-asked")
    parts = []
    for b in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        got: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in mine.toArrow().combine_chunks().to_batches():
            for names, q in by_width(batch):
                q, floor = np.floor(SCALE * q), np.full(len(names), -np.inf)
                ids, x = seed.get(q.shape[1], (np.empty(0, np.int64), np.empty((0, q.shape[1]))))
                for at in range(0, len(names) if len(ids) > k else 0, CANDIDATES):
                    score = _products(q[at : at + CANDIDATES], x)
                    score[names[at : at + CANDIDATES, None] == ids[None, :]] = np.iinfo(np.int64).min
                    floor[at : at + CANDIDATES] = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
                got[q.shape[1]] = (names, q, floor)
        sent = spark.sparkContext.broadcast(got)
        found = table_.mapInArrow(_search(sent, k), "query_id long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        found = found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        parts.append(found if blocks == 1 else written(found, "op2-block"))
        if blocks > 1:
            sent.destroy()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def op2_topk_search(spark, sf_dir: str) -> DataFrame:
    """The 10 best of every row whose vec_id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where("vec_id % 100 = 0"))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
