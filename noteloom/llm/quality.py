"""Document quality from heuristic labellers, without human labels.

1. Each labeller fires (this looks bad) or not, so a document has a pattern of
   fires; patterns are counted over all documents.
2. Expectation-maximisation over the pattern counts estimates how often each
   labeller fires on good and on bad documents, and the share of bad ones.
3. The posteriors of a bounded sample (SAMPLE documents and SAMPLE_BYTES on
   either side of one half, by hash order) train a linear scorer over hashed runs of three byte
   classes and over word lengths (apart for words that repeat the one before),
   which then scores every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.llm.common import dropped, freed, slices, table, written
from noteloom.llm.linear import fit_in_task, fit_logistic, flat_lists

SAMPLE = 3000
SAMPLE_BYTES = 64 << 20
#: Tasks that share the sample.
SAMPLE_TASKS = 8
BITS = 13
SIZE = (1 << BITS) + 32
#: A labeller fires on at most this share of good documents.
MOST_FALSE = 0.003
ACCEPT = 0.7
LABELLERS = ("shouting", "symbols", "exclaiming", "cells", "repeating", "odd_words", "digits", "no_sentences")

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+<=>@\\^_`{|}~"]] = True
_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = ord("A"), ord("a"), ord("a"), ord("0")
_CLASS[9:14] = 32


def _again(run) -> np.ndarray:
    """Words that equal the word before them in their text."""
    same = np.zeros(len(run.starts), dtype=bool)
    same[1:] = run.hashes[1:] == run.hashes[:-1]
    heads = run.first[:-1]
    same[heads[heads < len(same)]] = False
    return same


def fires(run) -> np.ndarray:
    """Bit k of a text's number is set if labeller k fires on it."""
    n = len(run.offsets) - 1

    def total(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return (c[run.offsets[1:]] - c[run.offsets[:-1]]).astype(float)

    size = np.maximum(np.diff(run.offsets), 1)
    words = np.diff(run.first).astype(float)
    some = np.maximum(words, 1)
    letters = np.maximum(total(_LETTER[run.data]), 1)
    lengths = np.concatenate([[0], np.cumsum(run.ends - run.starts)])
    mean_word = (lengths[run.first[1:]] - lengths[run.first[:-1]]) / some
    again = np.concatenate([[0], np.cumsum(_again(run))])
    repeats = again[run.first[1:]] - again[run.first[:-1]]
    found = [
        total(_UPPER[run.data]) / letters > 0.3,
        total(_SYMBOL[run.data]) / size > 0.02,
        total(run.data == ord("!")) / some > 0.2,
        total(run.data == ord("|")) / some > 0.1,
        repeats / some > 0.15,
        (mean_word > 20) | (words > 0) & (mean_word < 2),
        total(_DIGIT[run.data]) / size > 0.2,
        (words >= 30) & (total(run.data == ord(".")) / some < 0.004),
    ]
    return sum(f.astype(np.int64) << k for k, f in enumerate(found))


def estimate(patterns: dict[int, int], rounds: int = 50) -> dict[int, float]:
    """Posterior of being bad for each pattern, by EM over their counts."""
    keys = np.array(sorted(patterns), dtype=np.int64)
    count = np.array([patterns[k] for k in keys.tolist()], dtype=float)
    bits = (keys[:, None] >> np.arange(len(LABELLERS)) & 1).astype(float)
    share, bad, good = 0.1, np.full(len(LABELLERS), 0.4), np.full(len(LABELLERS), 0.02)
    posterior = np.zeros(len(keys))
    for _ in range(rounds):
        log = [np.log(p) @ bits.T + np.log(1 - p) @ (1 - bits).T for p in (bad, good)]
        odds = np.clip(np.log(share / (1 - share)) + log[0] - log[1], -50, 50)
        posterior = 1 / (1 + np.exp(-odds))
        a, b = posterior * count, (1 - posterior) * count
        share = float(np.clip((a.sum() + 0.1) / (count.sum() + 1), 1e-4, 0.5))
        bad = np.clip((a @ bits + 0.4) / (a.sum() + 1), 1e-4, 0.9999)
        good = np.clip((b @ bits + 0.02) / (b.sum() + 1), 1e-5, MOST_FALSE)
    return dict(zip(keys.tolist(), posterior.tolist(), strict=True))


def _buckets(data: np.ndarray) -> np.ndarray:
    c = np.concatenate([_CLASS[data], np.zeros(2, np.uint32)])
    n = len(data)
    h = c[:n] * np.uint32(0x9E3779B1) + c[1 : n + 1] * np.uint32(0x85EBCA77) + c[2 : n + 2] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BITS)).astype(np.int32)


def _word_features(run) -> np.ndarray:
    return (1 << BITS) + (_again(run).astype(np.int64) << 4 | np.minimum(run.ends - run.starts, 15))


def _patterns(batches):
    for batch in batches:
        for i, j, run in slices(batch.column("t")):
            yield pa.RecordBatch.from_arrays([batch.column("d").slice(i, j - i), pa.array(fires(run))], ["d", "pattern"])
    freed()


def _features(batches):
    for batch in batches:
        for i, j, run in slices(batch.column("t")):
            rows, values = [], []
            bucket, word = _buckets(run.data), _word_features(run)
            for k in range(j - i):
                parts = []
                for x in (bucket[run.offsets[k] : run.offsets[k + 1]], word[run.first[k] : run.first[k + 1]]):
                    f, n = np.unique(x, return_counts=True)
                    parts.append((f, n / max(1, n.sum())))
                rows.append(np.concatenate([f for f, _ in parts]).astype(np.int32))
                values.append(np.concatenate([v for _, v in parts]).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("k").slice(i, j - i), batch.column("pattern").slice(i, j - i), pa.array(rows, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))],
                ["k", "pattern", "features", "parts"],
            )
    freed()


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights (of the share of each bucket) and intercept of the log odds that
    a document is good."""
    plain = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").alias("t"))
    marked = written(plain.mapInArrow(_patterns, "d long, pattern long"), "op5-marked")
    counts = {r["pattern"]: r["n"] for r in marked.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    posterior = estimate(counts) if counts else {}
    bad = [k for k, p in posterior.items() if p >= 0.5]
    share = sum(counts[k] for k in bad) / max(1, sum(counts.values()))
    if not 0 < share < 1:
        return np.zeros(SIZE), 3.0
    is_bad = F.col("pattern").isin(bad)
    sides = [marked.where("d is not null").where(side).groupBy("d").agg(F.min("pattern").alias("pattern")).orderBy(F.xxhash64("d"), "d").limit(sample) for side in (is_bad, ~is_bad)]
    wanted = F.broadcast(sides[0].unionAll(sides[1]).groupBy(F.col("d").alias("k")).agg(F.min("pattern").alias("pattern")))
    texts = plain.join(wanted, F.col("d") == F.col("k")).groupBy("k", "pattern").agg(F.min(F.coalesce("t", F.lit(""))).alias("t"))
    so_far = Window.partitionBy(is_bad).orderBy(F.xxhash64("k"), "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = written(texts.repartition(SAMPLE_TASKS, "k"), "op5-sample")
    fits = held.select(F.col("k").alias("kept"), "pattern", F.sum(F.octet_length("t")).over(so_far).alias("bytes")).where(F.col("bytes") <= SAMPLE_BYTES).select("kept")
    texts = held.join(F.broadcast(fits), F.col("k") == F.col("kept")).drop("kept")

    def fit(got: pa.Table) -> tuple[np.ndarray, float]:
        got = got.sort_by("k")
        good = 1 - np.array([posterior[k] for k in got["pattern"].to_pylist()])
        (index, edge), (values, _) = flat_lists(got["features"]), flat_lists(got["parts"])
        w, b = fit_logistic(index, edge, good, SIZE, l2=1e-7, values=values, rounds=400, rate=1.0)
        odds = np.clip(good.mean() / max(1e-6, 1 - good.mean()), 1e-3, 1e3)
        return w, float(b + np.log((1 - share) / share) - np.log(odds))

    model = fit_in_task(texts.mapInArrow(_features, "k long, pattern long, features array<int>, parts array<float>"), fit)
    dropped(marked, held)
    return model or (np.zeros(SIZE), 3.0)


def _score(sent):
    def run(batches):
        weights, bias = sent.value
        for batch in batches:
            for i, j, texts in slices(batch.column("t")):
                size = np.diff(texts.offsets)
                z = np.full(j - i, bias)
                for features, edges in ((_buckets(texts.data), texts.offsets), (_word_features(texts), texts.first)):
                    part = np.concatenate([[0.0], np.cumsum(weights[features])])
                    z += (part[edges[1:]] - part[edges[:-1]]) / np.maximum(np.diff(edges), 1)
                score = np.where(size > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:-1]), pa.array(score)], [*batch.schema.names[:-1], "score"])
        freed()

    return run


def score_quality(docs: DataFrame, carry: tuple[str, ...] = (), sample: int = SAMPLE) -> DataFrame:
    """doc_id, the carried columns, score (of being good, 0 to 1): one row for
    each input row; accept from ACCEPT on.

    Null and empty texts score 0; a very long text is scored whole, as one
    slice. Rows with null or repeated doc_ids are scored
    like any other. Where the labellers never disagree with good, everything
    scores high. An empty table gives an empty result. Only doc_id, text and
    the carried columns are read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, sample))
    kept = ["doc_id", *carry]
    named = docs.select(F.col("doc_id").cast("long").alias("c0"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry, 1)), F.col("text").alias("t"))
    fields = ", ".join(f"c{i} {named.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(kept)))
    return named.mapInArrow(_score(model), f"{fields}, score double").toDF(*kept, "score")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Quality score and decision for every document."""
    scored = score_quality(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "score", (F.col("score") >= ACCEPT).alias("accepted"))
