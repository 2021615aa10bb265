"""SimHash fingerprints and near-duplicate groups by ball hashing.

Two fingerprints within radius 4 meet on a variant at most 2 bits from either.
Emitting all 2,081 such variants of 64 bits for each fingerprint is exact but
needs more shuffle space than the check tool grants (figures in the README), so
the meeting is first arranged on 43-bit projections: of three blocks of 21, 21
and 22 bits, some two hold at most 2 of the differing bits, and on those two
blocks the pair meets at a variant at most 1 bit from either (44 or 45 variants
for each of three projections). Small collision groups are verified pair by
pair. Fingerprints of a group over MOST_PAIRED emit their whole 64-bit ball
instead: all that meet at a full variant are within the radius of each other,
so a star to the least one links them without any pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import LOWER, freed, joined_by_key, slices, table, written
from noteloom.llm.components import connected_components

RADIUS = 4
MOST_PAIRED = 64
_BLOCKS = ((0, 21), (21, 42), (42, 64))


def fingerprints_of(run, size: int) -> list[int]:
    """The fingerprint of each text of a run, as signed 64-bit integers."""
    raw = LOWER[run.data].tobytes()
    out = np.zeros(len(run.first) - 1, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for k in range(len(out)):
        words = raw[run.offsets[k] : run.offsets[k + 1]].split()
        if not words:
            continue
        n = len(words)
        joined = b" ".join(words)
        if n <= size:
            hashes = [digest(joined, 42)]
        else:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
            starts = np.concatenate([[0], ends[: n - size]]).tolist()
            hashes = [digest(joined[a:b], 42) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]
        votes = np.zeros(64, dtype=np.int64)
        h = np.array(hashes, dtype=np.uint64)
        for at in range(0, len(h), 65536):
            part = h[at : at + 65536]
            votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * votes > len(h), bitorder="little").view(np.uint64)[0]
    return out.view(np.int64)


def _fingerprint(size: int):
    def run(batches):
        for batch in batches:
            for i, j, texts in slices(batch.column("t")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(fingerprints_of(texts, size))], ["doc_id", "fp"])
        freed()

    return run


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id, fp (signed 64 bits): majority bits of the XXH64 (seed 42) of
    lower-cased word shingles; no words (null included): 0."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t")).mapInArrow(_fingerprint(size), "doc_id long, fp long")


def _ball(bits: int, radius: int) -> np.ndarray:
    masks = [0]
    for r in range(1, radius + 1):
        masks += [sum(1 << b for b in c) for c in combinations(range(bits), r)]
    return np.array(masks, dtype=np.uint64)


def _projections(batches):
    """(key, fp): variants at most 1 bit away on each pair of blocks; the top
    bits of the key name the pair."""
    pairs = []
    for number, (x, y) in enumerate(combinations(_BLOCKS, 2)):
        parts = [(np.uint64(lo), np.uint64((1 << (hi - lo)) - 1), np.uint64(shift)) for (lo, hi), shift in ((x, 0), (y, x[1] - x[0]))]
        width = x[1] - x[0] + y[1] - y[0]
        pairs.append((parts, _ball(width, 1), np.uint64(number << 50)))
    for batch in batches:
        all_fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(all_fp), 2000):
            fp = all_fp[at : at + 2000]
            keys = []
            for parts, masks, name in pairs:
                value = np.zeros(len(fp), dtype=np.uint64)
                for lo, mask, shift in parts:
                    value |= ((fp >> lo) & mask) << shift
                keys.append((value[:, None] ^ masks[None, :]) | name)
            key = np.concatenate(keys, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(fp, key.shape[1]).view(np.int64))], ["key", "fp"])


def _whole_ball(batches):
    masks = _ball(64, RADIUS // 2)
    for batch in batches:
        all_fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(all_fp), 200):
            fp = all_fp[at : at + 200]
            key = fp[:, None] ^ masks[None, :]
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(fp, len(masks)).view(np.int64))], ["key", "fp"])


def different(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """The different rows (a, b)."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return pa.RecordBatch.from_arrays([pa.array(x[keep]), pa.array(y[keep])], ["a", "b"])


def _groups(batches):
    """Rows sorted by key, in runs that end with a group. Of a group too large
    to hold, rows are passed on in several runs, each large by itself."""
    held = None
    for batch in batches:
        rows = (batch.column("key").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy(zero_copy_only=False))
        if held is not None:
            rows = tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
        key = rows[0]
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))
        if len(key) - last > 100_000:
            yield rows
            held = tuple(x[-(MOST_PAIRED + 1) :] for x in rows)
        else:
            if last:
                yield tuple(x[:last] for x in rows)
            held = tuple(x[last:] for x in rows)
    if held is not None and len(held[0]):
        yield held


def _verified(batches):
    """a, b: links between different fingerprints of groups small enough to
    pair; a = b names a fingerprint of a larger group."""
    for key, fp in _groups(batches):
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(start, len(key)))
        big = np.repeat(count > MOST_PAIRED, count)
        a, b = [fp[big]], [fp[big]]
        small = (count > 1) & (count <= MOST_PAIRED)
        start, count = start[small], count[small]
        for step in range(1, int(count.max(initial=1))):
            wide = count > step
            s, c = start[wide], count[wide] - step
            left = np.repeat(s - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(c.sum())
            x, y = fp[left], fp[left + step]
            near = np.bitwise_count((x ^ y).view(np.uint64)) <= RADIUS
            a.append(np.minimum(x, y)[near])
            b.append(np.maximum(x, y)[near])
        yield different(np.concatenate(a), np.concatenate(b))


def _stars(batches):
    """a, b: every fingerprint at a variant, linked to the first one there."""
    last_key = last_fp = None
    for batch in batches:
        key, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp"))
        if not len(key):
            continue
        new = np.concatenate([[last_key is None or key[0] != last_key], key[1:] != key[:-1]])
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        root = np.where(at >= 0, fp[np.maximum(at, 0)], last_fp if last_fp is not None else 0)
        last_key, last_fp = key[-1], root[-1]
        yield different(root[root != fp], fp[root != fp])


def links(distinct: DataFrame, whole: bool = False) -> DataFrame:
    """a, b: links that connect what lies within RADIUS bits, of a table of
    distinct fp. whole=True takes the 64-bit ball for every fingerprint."""
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def met(rows: DataFrame) -> DataFrame:
        return rows.repartition(n, "key").sortWithinPartitions("key", "fp")

    if whole:
        return met(distinct.mapInArrow(_whole_ball, "key long, fp long")).mapInArrow(_stars, "a long, b long").distinct()
    found = written(met(distinct.mapInArrow(_projections, "key long, fp long")).mapInArrow(_verified, "a long, b long").distinct(), "op3-links")
    large = found.where("a = b").select(F.col("a").alias("fp"))
    stars = met(large.mapInArrow(_whole_ball, "key long, fp long")).mapInArrow(_stars, "a long, b long")
    return found.where("a <> b").unionAll(stars)


def near_duplicate_groups(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row for each
    input row; component_id is the least doc_id that links of at most RADIUS
    differing bits reach.

    Null and empty texts have fingerprint zero and link like any other. Rows
    with a null doc_id get a fingerprint and take part in links, but never name
    a component (null where nothing else is in it). Repeated rows give repeated
    rows. A very long text is hashed whole, by one task, a shingle at a time. An
    empty table gives an empty result. Only doc_id and text are read.
    """
    prints = written(fingerprints(docs, size), "op3-fp")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "op3-distinct")
    roots = connected_components(links(distinct.select("fp")))
    rooted = written(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "op3-rooted")
    total, classes = rooted.agg(F.sum("n"), F.count("*")).first()
    named = rooted.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    by_print = written(joined_by_key(rooted, "root", named, "r", "m", classes).select(F.col("fp").alias("p"), "n", "component_id"), "op3-named")
    found = joined_by_key(prints, "fp", by_print, "p", "n", total or 0)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return near_duplicate_groups(table(spark, sf_dir, "documents"))
