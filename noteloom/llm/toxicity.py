"""Toxicity scores from character n-grams scaled by naive Bayes log-count
ratios.

Features are hashed n-grams of 4 to 8 bytes of the UTF-8 text (characters, for
ASCII) with A-Z lower-cased and all white space as spaces, present or absent in
a text. A bounded sample of labelled rows (SAMPLE texts and SAMPLE_BYTES of
either class, by hash order) gives the log-count ratio of every feature;
features that are rare or say little are left out. A logistic regression runs on
the rest, scaled by their ratios. Chosen features flatter the texts they were
chosen on, so its scores are made probabilities by a curve fitted on scores of
texts that had no part in choice or regression (FOLDS).

Texts of any length are read in pieces of STRETCH bytes, so a task holds the
features of such a piece and the different ones of a text (2**BITS at most).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.llm.common import distinct, dropped, freed, slices, table, written
from noteloom.llm.linear import fit_curve, fit_in_task, fit_logistic, flat_lists

BITS = 20
SIZES = (4, 5, 6, 7, 8)
SAMPLE = 3000
SAMPLE_BYTES = 64 << 20
#: Tasks that share the sample.
SAMPLE_TASKS = 8
#: Parts of all features that are counted apart.
PARTS = 16
STRETCH = 1 << 17
FOLDS = 3
THRESHOLD = 0.3
#: Features of fewer sampled texts, or of a smaller log-count ratio, are not used.
LEAST_TEXTS = 8
LEAST_RATIO = 1.5
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0xFD7046C5, 0xB55A4F09], dtype=np.uint32)


def _ngrams(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Length, and bucket of the n-gram that starts at each byte."""
    folded = _FOLD[data].astype(np.uint32) + np.uint32(1)
    padded = np.concatenate([folded, np.zeros(len(_MULT), np.uint32)])
    n = len(folded)
    h = np.zeros(n, dtype=np.uint32)
    for k, m in enumerate(_MULT):
        h = h + padded[k : k + n] * m
        if k + 1 in SIZES:
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)
            yield k + 1, (x >> np.uint32(32 - BITS)).astype(np.int32)


def _present(run, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Text and feature of the different features in each text of a run, of
    those in mask only."""
    found = [np.empty(0, np.int64)]
    for lo in range(0, len(run.data), STRETCH):
        hi = min(lo + STRETCH, len(run.data))
        here = []
        for n, bucket in _ngrams(run.data[lo : hi + max(SIZES) - 1]):
            bucket = bucket[: hi - lo]
            at = np.arange(hi - lo) if mask is None else np.flatnonzero(mask[bucket])
            text = np.searchsorted(run.offsets, at + lo, "right") - 1
            whole = at + lo + n <= run.offsets[text + 1]
            here.append(text[whole] << BITS | bucket[at[whole]])
        found.append(distinct(np.concatenate(here)))
    pairs = distinct(np.concatenate(found))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _counts(batches):
    """PARTS rows a task: texts with each feature, by fold and label."""
    total = np.zeros((FOLDS * 2, 1 << BITS), dtype=np.int32)
    for batch in batches:
        group = 2 * batch.column("fold").to_numpy() + batch.column("label").to_numpy()
        for i, _, run in slices(batch.column("t"), STRETCH):
            text, feature = _present(run)
            np.add.at(total, (group[i + text], feature), 1)
    size = (1 << BITS) // PARTS
    for p in range(PARTS):
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([total[:, p * size : (p + 1) * size].tobytes()], pa.binary())], ["part", "counts"])
    del total
    freed()


def _ratios(group: np.ndarray):
    """The used features of each part and their ratios: without each fold, and
    over all. group: sampled texts by fold and label."""
    folds = [np.arange(FOLDS) != f for f in range(FOLDS)] + [np.ones(FOLDS, dtype=bool)]

    def run(batches):
        size = (1 << BITS) // PARTS
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, x in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
                counts = np.frombuffer(x.as_buffer(), np.int32).reshape(FOLDS, 2, size)
                total[p] = total[p] + counts if p in total else counts
        for p, counts in total.items():
            found = np.stack([_ratio(*counts[f].sum(axis=0), *group[f].sum(axis=0).tolist()) for f in folds]).astype("<f4")
            used = np.flatnonzero(found.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in ((used + p * size).astype("<i4"), found[:, used])], ["used", "ratios"])
        del total
        freed()

    return run


def _features(sent):
    def run(batches):
        mask = np.zeros(1 << BITS, dtype=bool)
        mask[sent.value[0]] = True
        for batch in batches:
            for i, j, texts in slices(batch.column("t"), STRETCH):
                text, feature = _present(texts, mask)
                edge = np.searchsorted(text, np.arange(j - i + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(edge, pa.array(feature.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("k", "label", "fold")), lists], ["k", "label", "fold", "features"])
        freed()

    return run


def _ratio(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """Log-count ratio of each feature; 0 of those not used."""
    ratio = np.log((toxic + 1) / (n_toxic + 2)) - np.log((clean + 1) / (n_clean + 2))
    ratio[(clean + toxic < LEAST_TEXTS) | (np.abs(ratio) < LEAST_RATIO)] = 0
    return ratio


def held_out(doc_id) -> F.Column:
    """Rows kept from training; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, DataFrame, float]:
    """A written table; of it k, label, fold, t: the sampled texts, one for each
    id; and the share of toxic ones among all labelled ids."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("k")).agg((F.max("toxic") > 0).cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = [known.where(F.col("label") == c).orderBy(F.xxhash64("k"), "k").limit(sample) for c in (0, 1)]
    wanted = F.broadcast(chosen[0].unionAll(chosen[1]).withColumn("fold", F.pmod(F.xxhash64("k"), F.lit(FOLDS)).cast("int")))
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.coalesce("text", F.lit("")).alias("t")).join(wanted, F.col("d") == F.col("k"))
    texts = texts.groupBy("k", "label", "fold").agg(F.min("t").alias("t"))
    so_far = Window.partitionBy("label").orderBy(F.xxhash64("k"), "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = written(texts.repartition(SAMPLE_TASKS, "k"), "op8-sample")
    fits = held.select(F.col("k").alias("kept"), F.sum(F.octet_length("t")).over(so_far).alias("bytes"), "label").where(F.col("bytes") <= SAMPLE_BYTES).select("kept")
    return held, held.join(F.broadcast(fits), F.col("k") == F.col("kept")).drop("kept"), (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """The used features, their weights, and the intercept. Labels of held-out
    or null ids are not read; of several labels of an id the highest counts, of
    several texts the least. Without labelled texts of both classes in every
    fold all scores are the base rate."""
    spark = docs.sparkSession
    held, texts, rate = _sample(docs, labels, sample)
    prior = float(np.log(rate / (1 - rate)))
    none = np.empty(0, np.int32), np.empty(0), prior
    group = np.zeros(FOLDS * 2, dtype=np.int64)
    for r in texts.groupBy("fold", "label").agg(F.count("*").alias("n")).collect():
        group[2 * r["fold"] + r["label"]] = r["n"]
    if not group.all():
        dropped(held)
        return none
    counted = texts.mapInArrow(_counts, "part int, counts binary").repartition(PARTS, "part")
    found = counted.mapInArrow(_ratios(group.reshape(FOLDS, 2)), "used binary, ratios binary").collect()
    used = np.concatenate([np.frombuffer(r["used"], "<i4") for r in found])
    ratios = np.concatenate([np.frombuffer(r["ratios"], "<f4").reshape(FOLDS + 1, -1) for r in found], axis=1)
    order = np.argsort(used)
    sent = spark.sparkContext.broadcast((used[order], ratios[:, order]))

    def fit(got: pa.Table) -> tuple[np.ndarray, float]:
        used, ratios = sent.value
        got = got.sort_by("k")
        y, fold = got["label"].to_numpy(), got["fold"].to_numpy()
        index, edge = flat_lists(got["features"])
        index = np.searchsorted(used, index)
        owner = np.repeat(np.arange(len(y)), np.diff(edge))

        def model(rows: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
            keep = rows[owner] & (ratio[index] != 0)
            edges = np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(y))[rows])])
            w, b = fit_logistic(index[keep], edges, y[rows].astype(float), len(used), l2=1e-4, scale=ratio, rounds=60, rate=0.05)
            return w * ratio, b

        def score(w: np.ndarray, b: float) -> np.ndarray:
            return np.bincount(owner, w[index], minlength=len(y)) + b

        unseen = np.zeros(len(y))
        for f in range(FOLDS):
            unseen[fold == f] = score(*model(fold != f, ratios[f]))[fold == f]
        slope, shift = fit_curve(unseen, y)
        w, b = model(np.ones(len(y), dtype=bool), ratios[FOLDS])
        return slope * w, slope * b + shift + prior - float(np.log(np.mean(y == 1) / np.mean(y == 0)))

    model = fit_in_task(texts.mapInArrow(_features(sent), "k long, label int, fold int, features array<int>"), fit)
    sent.destroy()
    dropped(held)
    freed()
    return (used[order], *model) if model else none


def _score(sent):
    def run(batches):
        used, found, bias = sent.value
        weights = np.zeros(1 << BITS)
        weights[used] = found
        mask = weights != 0
        for batch in batches:
            for i, j, texts in slices(batch.column("t"), STRETCH):
                text, feature = _present(texts, mask)
                z = np.clip(np.bincount(text, weights[feature], minlength=j - i) + bias, -30, 30)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:-1]), pa.array(1 / (1 + np.exp(-z)))], [*batch.schema.names[:-1], "score"])
        freed()

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = (), sample: int = SAMPLE) -> DataFrame:
    """doc_id, the carried columns, score: one row for each input row.

    Null and empty texts have the score of a text without features; a long
    text is scored whole. Rows with null or repeated doc_ids are scored like any
    other. An empty table gives an empty result. Only doc_id, text and the
    carried columns are read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    kept = ["doc_id", *carry]
    named = docs.select(F.col("doc_id").cast("long").alias("c0"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry, 1)), F.col("text").alias("t"))
    fields = ", ".join(f"c{i} {named.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(kept)))
    return named.mapInArrow(_score(model), f"{fields}, score double").toDF(*kept, "score")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
