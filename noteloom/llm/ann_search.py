"""Nearest neighbours by inner product: an index of cells, searched as deeply as
a measurement on the table itself asks for.

Equal vectors are one node, so a vector that a third of the rows share is no hot
group; a node keeps as many of its smallest ids as a query can be owed.

1. fit: the centres of at most CELLS cells are k-means of a sample of nodes of at
   most SAMPLE_BYTES, by hash order. Every node is then dealt to the cell of its
   nearest centre, and the table is written cell by cell, large cells in parts.
   Up to PLAIN nodes are one cell, which is an exact search.
2. measure: TRIED queries are compared with every node. The cells of a query are
   ordered by the highest score that one of their size and spread may hold, and
   the fewest cells are taken that hold TARGET of the true neighbours.
3. search: queries go to the tasks in blocks of QUERY_BYTES, every task passes its
   cells by those queries that are to look into them. A pass over the first cells
   alone gives each query a floor, which few others then exceed.

Vectors without clusters need many cells, up to all of them: the search is then
exact, never less than TARGET. Filters are products in single precision with
their error bound; what passes has its score summed in doubles, in order.
A task holds a block of queries, their best so far and a batch of rows, whatever
the table's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteloom.llm.common import distinct, dropped, freed, joined_by_key, mix64, table, written
from noteloom.llm.topk_search import clean_vectors

PLAIN = 4096
CELLS = 4096
SAMPLE_BYTES = 16 << 20
ROUNDS = 8
#: Rows of a part of a cell: parts are dealt to tasks.
PART = 32_768
TRIED = 256
TARGET = 0.96
QUERY_BYTES = 16 << 20
#: The share of a query's cells that give its floor.
FIRST = 1 / 16
SEED = 11
_ROWS = 2048
_EXACT = 1 << 16
_KEPT = 1 << 19
_FOUND = "name long, vec_id long, score double, cell long, want int"


def _nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(axis=1)
    parts = [np.argmax(x[at : at + _ROWS] @ centres.T - half, axis=1) for at in range(0, len(x), _ROWS)]
    return np.concatenate([*parts, np.empty(0, np.int64)])


def fitted(x: np.ndarray, cells: int) -> np.ndarray:
    """Centres of at most so many cells: k-means."""
    order = np.random.default_rng(SEED).permutation(len(x))
    centres = x[order[:cells]].copy()
    for _ in range(ROUNDS if len(centres) > 1 else 0):
        to = _nearest_centre(x, centres)
        order = np.argsort(to, kind="stable")
        names, first = np.unique(to[order], return_index=True)
        size = np.diff(np.append(first, len(order)))
        centres[names] = np.add.reduceat(x[order], first, axis=0) / size[:, None]
    return centres


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _dealt(sent):
    """Rows with their cell, the part of it and the squared distance to its centre."""

    def run(batches):
        most, held = sent.value
        for batch in batches:
            width = np.diff(batch.column("x").offsets.to_numpy())
            for w in distinct(width).tolist():
                part = batch.take(pa.array(np.flatnonzero(width == w)))
                x = (_matrix(part.column("x"), w) / most).astype(np.float32)
                centres, parts = held[w]
                to = _nearest_centre(x, centres)
                off = x - centres[to]
                salt = mix64(part.column("node").to_numpy(zero_copy_only=False).view(np.uint64)) % parts[to].astype(np.uint64)
                columns = [pa.array(to + (w << 32)), pa.array(salt.astype(np.int64)), pa.array((off * off).sum(axis=1).astype(np.float64))]
                yield pa.RecordBatch.from_arrays([*columns, part.column("ids"), part.column("x")], ["cell", "part", "off", "ids", "x"])
        freed()

    return run


class _Cells:
    """Cells of the nodes of one length: centre, size and what a cell may hold
    above its centre's score, for a query of length 1."""

    def __init__(self, names: np.ndarray, centres: np.ndarray, size: np.ndarray, off: np.ndarray):
        order = np.argsort(names)
        self.names, self.centres, self.size = names[order], centres[names[order]], size[order]
        self.reach = (np.sqrt(2 * np.log(self.size + 1.0)) * np.sqrt(off[order] / max(1, centres.shape[1]))).astype(np.float32)

    def keys(self, q: np.ndarray, some: slice | np.ndarray = slice(None)) -> np.ndarray:
        """The order in which cells are looked into, for queries of length 1."""
        return q @ self.centres[some].T + self.reach[some]

    def limits(self, q: np.ndarray, least: np.ndarray, cells: int) -> np.ndarray:
        """The least key of the cells that each query looks into: so many, and
        more until they hold `least` nodes."""
        out = np.empty(len(q), np.float32)
        for at in range(0, len(q), 1024):
            key = self.keys(q[at : at + 1024])
            order = np.argsort(-key, axis=1, kind="stable")
            enough = (np.cumsum(self.size[order], axis=1) < least[at : at + 1024, None]).sum(axis=1)
            last = np.minimum(np.maximum(enough, cells - 1), len(self.names) - 1)
            got = key[np.arange(len(key)), order[np.arange(len(key)), last]]
            out[at : at + 1024] = np.where(last == len(self.names) - 1, -np.inf, got - 1e-5 * (1 + np.abs(got)))
        return out


def unit(q: np.ndarray) -> np.ndarray:
    x = q / np.maximum(np.abs(q).max(axis=1, initial=0), np.finfo(q.dtype).tiny)[:, None]
    return (x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-30)[:, None]).astype(np.float32)


class _Queries:
    """Queries of one length in a task, and the best rows of each so far."""

    def __init__(self, names: np.ndarray, q: np.ndarray, want: np.ndarray, limit: np.ndarray, floor: np.ndarray, cells: _Cells):
        self.names, self.q, self.want, self.limit, self.cells = names, q, want, limit, cells
        self.floor = floor.copy()
        self.unit = unit(q)
        self.scale = np.abs(q).max(axis=1, initial=0).astype(np.float64)
        self.near = (q / self.scale[:, None]).astype(np.float32)
        self.norm = np.sqrt((self.near * self.near).sum(axis=1, dtype=np.float64))
        self.rows = [np.empty(0, t) for t in (np.int64, np.int64, np.float64, np.int64)]
        self.held, self.added, self.n = [], 0, 0

    def batch(self, cell: np.ndarray, ids: pa.ListArray, x: np.ndarray) -> None:
        """Rows sorted by cell."""
        cut = np.append(np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])), len(cell))
        at = np.searchsorted(self.cells.names, cell[cut[:-1]])
        for lo in range(0, len(at), 64):
            looks = self.cells.keys(self.unit, at[lo : lo + 64]) >= self.limit[:, None]
            for j in range(looks.shape[1]):
                who = np.flatnonzero(looks[:, j])
                for a in range(int(cut[lo + j]), int(cut[lo + j + 1]) if len(who) else 0, _ROWS):
                    b = min(a + _ROWS, int(cut[lo + j + 1]))
                    self.look(who, int(cell[a]), ids.slice(a, b - a), x[a:b])

    def look(self, who: np.ndarray, cell: int, ids: pa.ListArray, x: np.ndarray) -> None:
        edge = ids.offsets.to_numpy()
        flat, edge = ids.flatten().to_numpy(zero_copy_only=False), edge - edge[0]
        scale = float(np.abs(x).max(initial=0))
        if not scale:
            return
        near = (x / x.dtype.type(scale)).astype(np.float32)
        norm = np.sqrt((near * near).sum(axis=1, dtype=np.float64)).max()
        width = x.shape[1]
        for lo in range(0, len(who), _ROWS):
            some = who[lo : lo + _ROWS]
            s = self.near[some] @ near.T
            slack = (width + 8) * 2.0**-23 * self.norm[some] * norm + 1e-30
            with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                size = self.scale[some] * scale * width
                plain = (size < 1e300) & (size > 1e-280)
                floor = self.floor[some]
                need = np.where(plain & np.isfinite(floor), floor / self.scale[some] / scale - slack, -np.inf)
            most = int(self.want[some].max())
            open_ = np.flatnonzero(plain & (floor == -np.inf))
            if len(open_) and len(x) > most:
                need[open_] = np.partition(s[open_], len(x) - most, axis=1)[:, len(x) - most] - 2 * slack[open_]
            hit, row = np.nonzero(s >= need[:, None])
            for i in range(0, len(hit), _EXACT):
                self.add(some[hit[i : i + _EXACT]], cell, row[i : i + _EXACT], x, flat, edge)

    def add(self, of: np.ndarray, cell: int, row: np.ndarray, x: np.ndarray, flat: np.ndarray, edge: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            score = np.cumsum(self.q[of].astype(np.float64) * x[row].astype(np.float64), axis=1)[:, -1]
        keep = ~(score < self.floor[of])
        of, row, score = of[keep], row[keep], score[keep]
        n = (edge[1:] - edge[:-1])[row]
        at = np.repeat(edge[row] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        self.held.append((np.repeat(of, n), flat[at], np.repeat(score, n), np.full(len(at), cell, np.int64)))
        self.added += len(at)
        if self.added > max(_KEPT, self.n):
            self.settle()

    def settle(self) -> None:
        """Keep the `want` best of each query: highest scores, then smallest ids."""
        of, ids, score, cell = (np.concatenate(c) for c in zip(self.rows, *self.held, strict=True))
        self.held, self.added = [], 0
        order = np.lexsort((ids, -score, of))
        of = of[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        last = rank == self.want[of] - 1
        self.floor[of[last]] = np.maximum(self.floor[of[last]], score[order[last]])
        keep = rank < self.want[of]
        order = order[keep]
        self.rows = [of[keep], ids[order], score[order], cell[order]]
        self.n = len(order)


def _passed(sent):
    """The best rows of each query among the cells of a task."""

    def run(batches):
        held = {w: _Queries(*found) for w, found in sent.value.items()}
        for batch in batches:
            cell = batch.column("cell").to_numpy(zero_copy_only=False)
            width = cell >> 32
            for w in distinct(width).tolist():
                if w in held:
                    a, b = int(np.searchsorted(width, w)), int(np.searchsorted(width, w, "right"))
                    held[w].batch(cell[a:b], batch.column("ids").slice(a, b - a), _matrix(batch.column("x").slice(a, b - a), w))
        for q in held.values():
            q.settle()
            of, ids, score, cell = q.rows
            for at in range(0, len(of), _EXACT):
                part = slice(at, at + _EXACT)
                columns = (q.names[of[part]], ids[part], score[part], cell[part], q.want[of[part]].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["name", "vec_id", "score", "cell", "want"])
        del held
        freed()

    return run


class Index:
    """Every node of a table (node, ids, x), written cell by cell."""

    def __init__(self, nodes: DataFrame):
        spark = nodes.sparkSession
        self.tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        sizes = nodes.groupBy(F.size("x").alias("w")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("x", F.abs))).cast("double").alias("most")).collect()
        most = max((r["most"] or 0.0 for r in sizes), default=0.0) or 1.0
        bytes_ = sum(4 * r["w"] * r["n"] for r in sizes if r["n"] > PLAIN)
        share = min(1.0, SAMPLE_BYTES / bytes_) if bytes_ else 0.0
        large = [r["w"] for r in sizes if r["n"] > PLAIN]
        taken = F.size("x").isin(large) & (F.pmod(F.xxhash64("node", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30)))
        centres = {r["w"]: (np.zeros((1, r["w"]), np.float32), np.full(1, -(-r["n"] // PART))) for r in sizes}
        if large:
            sample = nodes.where(taken).select("x").toArrow().combine_chunks()["x"].combine_chunks()
            sample = sample.chunk(0) if isinstance(sample, pa.ChunkedArray) else sample
            width = np.diff(sample.offsets.to_numpy())
            for r in sizes:
                some = np.flatnonzero(width == r["w"])
                if r["n"] > PLAIN and len(some):
                    x = (_matrix(sample.take(pa.array(some)), r["w"]) / most).astype(np.float32)
                    got = fitted(x, min(CELLS, int(2 * np.sqrt(r["n"]))))
                    held = np.bincount(_nearest_centre(x, got), minlength=len(got))
                    centres[r["w"]] = got, np.maximum(1, -(-held * r["n"] // (len(x) * PART)))
        sent = spark.sparkContext.broadcast((most, centres))
        dealt = nodes.mapInArrow(_dealt(sent), f"cell long, part long, off double, ids array<long>, x {nodes.schema['x'].dataType.simpleString()}")
        self.rows = written(dealt.repartition(self.tasks, "cell", "part").sortWithinPartitions("cell"), "op10-index")
        sent.destroy()
        counts = self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.avg("off").alias("off")).toArrow()
        cell, n, off = (counts[c].to_numpy() for c in ("cell", "n", "off"))
        self.cells = {}
        for w, (got, _) in centres.items():
            mine = cell >> 32 == w
            self.cells[w] = _Cells(cell[mine] & 0xFFFFFFFF, got, n[mine], off[mine])
            self.cells[w].names = self.cells[w].names + (w << 32)
        self.looked = {w: len(c.names) for w, c in self.cells.items()}
        self.recall = dict.fromkeys(self.cells, 1.0)

    def passed(self, queries: dict) -> tuple[DataFrame, object]:
        """name, vec_id, score, cell, want, and r, the rank of a row, for queries by length:
        (names, vectors, rows wanted, limits, floors)."""
        sent = self.rows.sparkSession.sparkContext.broadcast({w: (*q, self.cells[w]) for w, q in queries.items()})
        rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "vec_id"))
        return self.rows.mapInArrow(_passed(sent), _FOUND).withColumn("r", rank).where("r <= want"), sent

    def measure(self, queries: DataFrame) -> None:
        """How many cells hold TARGET of the true neighbours of TRIED queries (name, e, want)."""
        tried = {}
        for w in (w for w, c in self.cells.items() if len(c.names) > 1):
            some = _by_width(queries.where(F.size("e") == w).orderBy(F.xxhash64("name", F.lit(SEED))).limit(TRIED))
            for names, q, want in some.get(w, []):
                tried[w] = names, q, want, np.full(len(names), -np.inf, np.float32), np.full(len(names), -np.inf)
        if not tried:
            return
        found, sent = self.passed(tried)
        found = found.where("vec_id <> name").select("name", "cell").toArrow()
        sent.destroy()
        name, cell = (found[c].to_numpy() for c in ("name", "cell"))
        for w, (names, q, *_) in tried.items():
            mine, cells = cell >> 32 == w, self.cells[w]
            order = np.argsort(names)
            of, at = order[np.searchsorted(names[order], name[mine])], np.searchsorted(cells.names, cell[mine])
            place = np.argsort(np.argsort(-cells.keys(unit(q)), axis=1, kind="stable"), axis=1)
            need = np.sort(place[of, at])
            if len(need):
                self.looked[w] = int(need[min(len(need) - 1, int(TARGET * len(need)))]) + 1
                self.recall[w] = float((need < self.looked[w]).mean())

    def search(self, queries: DataFrame) -> DataFrame:
        """name, vec_id, score of the best `want` rows for queries of a block (name, e, want)."""
        asked = {}
        for w, parts in _by_width(queries).items():
            if w in self.cells and len(self.cells[w].names):
                names, q, want = (np.concatenate(c) for c in zip(*parts, strict=True))
                asked[w] = [names, q, want, self.cells[w].limits(unit(q), 4 * want, self.looked[w]), np.full(len(names), -np.inf)]
        first = {w: [n, q, want, self.cells[w].limits(unit(q), 4 * want, int(FIRST * self.looked[w])), floor] for w, (n, q, want, _, floor) in asked.items() if self.looked[w] * FIRST >= 1}
        if first:
            found, sent = self.passed(first)
            floors = found.where("r = want").select("name", "score").toArrow()
            sent.destroy()
            name, score = (floors[c].to_numpy() for c in ("name", "score"))
            order = np.argsort(name)
            name, score = name[order], score[order]
            for w in first if len(name) else ():
                at = np.minimum(np.searchsorted(name, asked[w][0]), len(name) - 1)
                asked[w][4] = np.where(name[at] == asked[w][0], score[at], -np.inf)
        found, sent = self.passed(asked)
        found = written(found.select("name", "vec_id", "score"), "op10-found")
        sent.destroy()
        return found


def _by_width(queries: DataFrame) -> dict[int, list[tuple[np.ndarray, ...]]]:
    """(names, vectors, rows wanted) of queries (name, e, want), by length."""
    out: dict[int, list[tuple[np.ndarray, ...]]] = {}
    for batch in queries.select("name", "e", "want").toArrow().to_batches():
        width = np.diff(batch.column("e").offsets.to_numpy())
        for w in distinct(width).tolist():
            part = batch.take(pa.array(np.flatnonzero(width == w)))
            out.setdefault(w, []).append((part.column("name").to_numpy(), _matrix(part.column("e"), w), part.column("want").to_numpy()))
    return out


def build_nodes(plain: DataFrame, most: int, kind: str) -> DataFrame:
    """node, ids, x: the different vectors, with their `most` smallest ids."""
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = plain.withColumn("r", first).where(F.col("r") <= most)
    grouped = few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return written(grouped.select(F.element_at("ids", 1).alias("node"), "ids", F.col("v").cast(kind).alias("x")), "op10-nodes")


def nearest(vectors: DataFrame, chosen: F.Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that `chosen` holds for, the
    k nearest found among all others by inner product in doubles, ties to the
    smaller vec_id.

    Of the true neighbours TARGET or more are found, as measured on TRIED of the
    queries; all of them among up to PLAIN different vectors. Rows that are null,
    zero, have a null id, or null or non-finite components take no part. Rows
    that share a query's vec_id count as its own; of several query rows of an id
    the least vector is taken. With fewer than k candidates all are returned.
    Vectors of different lengths are never compared. Products beyond the range
    of doubles are infinite. An empty table gives an empty result. Other columns
    are not read.
    """
    kind = vectors.schema["embedding"].dataType
    kind = "array<float>" if isinstance(kind.elementType, T.FloatType) else "array<double>"
    some = F.exists("v", lambda x: x != 0)
    plain = clean_vectors(vectors).where(some)
    # rows of one id are all its own: so many more are needed for k others
    counts = plain.groupBy("vec_id").agg(F.count("*").alias("own"))
    repeats = counts.where("own > 1")
    most = repeats.agg(F.max("own")).first()[0] or 1
    asked = clean_vectors(vectors.where(chosen)).where(some).groupBy("vec_id").agg(F.min("v").alias("q"))
    if most > 1:
        asked = asked.join(repeats.withColumnRenamed("vec_id", "i"), F.col("vec_id") == F.col("i"), "left").select("vec_id", "q", F.coalesce("own", F.lit(1)).alias("own"))
    else:
        asked = asked.withColumn("own", F.lit(1).cast("long"))
    asked = written(asked, "op10-asked")
    total = asked.count()
    by_vector = asked.groupBy(F.col("q").alias("e")).agg(F.min("vec_id").alias("name"), (F.max("own") + k).alias("want"), F.count("*").alias("n"))
    queries = written(by_vector.select(F.col("e").cast(kind).alias("e"), "name", "want", "n"), "op10-queries")
    named = queries.select(F.col("e").cast("array<double>").alias("e"), "name", "n")
    homes = written(joined_by_key(asked, "q", named, "e", "n", total).select("vec_id", "name", "n"), "op10-homes")
    nodes = build_nodes(plain, k + most, kind)
    index = Index(nodes)
    dropped(nodes, asked)
    index.measure(queries)
    bytes_ = queries.agg(F.sum((4 if kind == "array<float>" else 8) * F.size("e") + 32)).first()[0] or 0
    blocks = max(1, -(-bytes_ // QUERY_BYTES))
    found = None
    for b in range(blocks):
        part = index.search(queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == b))
        found = part if found is None else found.unionAll(part)
    dropped(index.rows)
    best = found.groupBy(F.col("name").alias("a")).agg(F.collect_list(F.struct("vec_id", "score")).alias("near"))
    met = best.join(queries.select(F.col("name").alias("m"), "n"), F.col("a") == F.col("m")).select("a", "near", "n")
    rows = joined_by_key(homes.select(F.col("vec_id").alias("query_id"), "name"), "name", written(met, "op10-near"), "a", "n", total)
    rows = rows.select("query_id", F.inline("near")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_ann_search(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 20 = 0"))
