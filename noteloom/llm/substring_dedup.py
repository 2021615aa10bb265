"""Substring dedup over a whole corpus: every word that lies in a window of
`window` words whose word sequence also starts in a document with a smaller id
is removed.

The corpus is its own reference here, so automata of all of it could not be
broadcast, and streaming each document past every shard would be quadratic
(see the README; automaton.py has the bounded-reference form). Instead:

1. each window names an anchor, the least hash of its k-word runs; equal
   windows name equal anchors. One aggregation finds the anchors that occur in
   two documents, and marks them in a bit field of fixed size;
2. windows whose anchor is marked are hashed (128 bits) and the least document
   of each is taken. Windows more frequent than anchors / HOT_SHARE, at most
   window * HOT_SHARE of them, are found by an aggregation that combines before
   its shuffle, and are broadcast; the others share one shuffle with a window
   function, whose groups are then that small;
3. each document gets the hashes of its windows to remove and cuts them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.llm.common import Powers, Texts, among, dropped, freed, mix64, slices, spans_hash, table, written

FIELD_BITS = 27
HOT_SHARE = 2000

_GRAM = Powers(0x9FB21C651E98DF25)
_WIN1 = Powers(0x2545F4914F6CDD1D)
_WIN2 = Powers(0xA0761D6478BD642F)


def _anchors(run: Texts, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, text and anchor of each window."""
    n = len(run.hashes)
    none = np.empty(0, np.int64)
    if n < window:
        return none, none, none.astype(np.uint64)
    gram = max(1, window // 2)
    text = np.repeat(np.arange(len(run.first) - 1), np.diff(run.first))
    at = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
    starts = np.arange(n - gram + 1)
    grams = spans_hash(run.hashes, starts, starts + gram, _GRAM)
    least = grams[: n - window + 1].copy()
    for k in range(1, window - gram + 1):
        np.minimum(least, grams[k : k + n - window + 1], out=least)
    return at, text[at], mix64(least[at] ^ np.uint64(0x5851F42D4C957F2D))


def _first_of_runs(*columns: np.ndarray) -> np.ndarray:
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _emit_anchors(window: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, j, texts in slices(batch.column("t")):
                _, text, anchor = _anchors(texts, window)
                pair = _first_of_runs(text, anchor)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[pair].view(np.int64)), pa.array(ids[i:j][text[pair]])], ["anchor", "doc_id"])

    return run


def _emit_windows(window: int, field, anchors: np.ndarray | None, without: np.ndarray):
    """Windows whose anchor is marked (and one of anchors, if given), except
    those whose h1 is in without."""

    def run(batches):
        bits = np.frombuffer(field.value, np.uint8)
        shift = np.uint64(64 - FIELD_BITS)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, j, texts in slices(batch.column("t")):
                at, text, anchor = _anchors(texts, window)
                slot = (anchor >> shift).astype(np.int64)
                keep = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                if anchors is not None:
                    keep &= among(anchor.view(np.int64), anchors)
                at, text = at[keep], text[keep]
                h1 = spans_hash(texts.hashes, at, at + window, _WIN1)
                if len(without):
                    keep = ~among(h1.view(np.int64), without)
                    at, text, h1 = at[keep], text[keep], h1[keep]
                h2 = spans_hash(texts.hashes, at, at + window, _WIN2)
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(ids[i:j][text])], ["h1", "h2", "doc_id"])
        freed()

    return run


def _cut(window: int, carried: int, sent):
    def run(batches):
        hot1, hot2, first = sent.value
        for batch in batches:
            gone_lists = batch.column("gone")
            lengths = np.diff(gone_lists.offsets.to_numpy()) if len(batch) else np.empty(0, np.int64)
            gone_all = gone_lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            edge = np.concatenate([[0], np.cumsum(lengths)])
            # a null id is before all others: nothing is smaller
            ids = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            for i, j, texts in slices(batch.column("t")):
                n = len(texts.starts)
                count = np.diff(texts.first)
                cover = np.zeros(n + 1, dtype=np.int64)
                gone = gone_all[edge[i] : edge[j]]
                if (len(gone) or len(hot1)) and n >= window:
                    owner = np.repeat(np.arange(j - i), lengths[i:j]).astype(np.uint64)
                    text = np.repeat(np.arange(j - i), count)
                    at = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
                    h1 = spans_hash(texts.hashes, at, at + window, _WIN1)
                    salt = mix64(np.arange(j - i, dtype=np.uint64) + np.uint64(77))
                    hit = among(h1 ^ salt[text[at]], np.sort(gone ^ salt[owner]))
                    if len(hot1):
                        place = np.minimum(np.searchsorted(hot1, h1.view(np.int64)), len(hot1) - 1)
                        same = np.flatnonzero(hot1[place] == h1.view(np.int64))
                        h2 = spans_hash(texts.hashes, at[same], at[same] + window, _WIN2).view(np.int64)
                        place = place[same]
                        hit[same] |= (hot2[place] == h2) & (first[place] < ids[i:j][text[at[same]]])
                    hit = at[hit]
                    np.add.at(cover, hit, 1)
                    np.add.at(cover, hit + window, -1)
                stay = np.cumsum(cover[:-1]) == 0
                removed = count - np.add.reduceat(np.append(stay, False).astype(np.int64), texts.first[:-1]) * (count > 0) if j > i else count
                raw = texts.data.tobytes()
                kept = []
                for k in range(j - i):
                    a, b = texts.first[k], texts.first[k + 1]
                    words = raw[texts.offsets[k] : texts.offsets[k + 1]].split()
                    if removed[k]:
                        words = [w for w, s in zip(words, stay[a:b].tolist(), strict=True) if s]
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in range(carried)), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    [*batch.schema.names[:carried], "n_words", "n_removed", "kept_text"],
                )
        freed()

    return run


def remove_repeated_passages(docs: DataFrame, window: int = 13, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns, n_words, n_removed, kept_text (the kept
    words, joined by one space), one row for each input row.

    Null texts are empty; texts under `window` words lose nothing. A row whose
    doc_id is null neither removes nor loses words. Rows that repeat a doc_id
    are judged each on its own text against smaller ids only, never against
    each other. A very long text is one slice of one task. An empty table gives
    an empty result. Only doc_id, text and the
    carried columns are read, whatever other columns are called; carried
    columns must not be named like the results.
    """
    spark = docs.sparkSession
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t"))
    anchors = (
        known.mapInArrow(_emit_anchors(window), "anchor long, doc_id long")
        .groupBy("anchor")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
        .where("first < last")
    )
    repeated = written(anchors.select("anchor", "n"), "op1-anchors")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    frequent = max(1000, total // HOT_SHARE)
    anchored = np.array(sorted(r[0] for r in repeated.where(F.col("n") > frequent).select("anchor").collect()), dtype=np.int64)
    place = F.shiftrightunsigned("anchor", 64 - FIELD_BITS)
    marks = (
        repeated.groupBy(F.shiftright(place, 6).alias("at"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(anchor, {64 - FIELD_BITS}) & 63 as int))")).alias("bits"))
        .toArrow()
    )
    bits = np.zeros(1 << (FIELD_BITS - 6), dtype="<i8")
    bits[marks["at"].to_numpy()] = marks["bits"].to_numpy()
    field = spark.sparkContext.broadcast(bits.tobytes())
    dropped(repeated)

    def windows(anchors: np.ndarray | None, without: np.ndarray) -> DataFrame:
        return known.mapInArrow(_emit_windows(window, field, anchors, without), "h1 long, h2 long, doc_id long")

    hot = np.empty((0, 3), np.int64)
    if len(anchored):
        counted = windows(anchored, hot[:, 0]).groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
        rows = counted.where(F.col("n") > frequent).select("h1", "h2", "first").collect()
        hot = np.array(sorted(map(tuple, rows)), dtype=np.int64).reshape(-1, 3)
    sent = spark.sparkContext.broadcast(tuple(np.ascontiguousarray(c) for c in hot.T))
    own = Window.partitionBy("h1", "h2")
    gone = windows(None, hot[:, 0].copy()).withColumn("first", F.min("doc_id").over(own)).where("first < doc_id").select("doc_id", "h1")
    lists = gone.groupBy(F.col("doc_id").alias("k")).agg(F.collect_list("h1").alias("gone"))
    kept = ["doc_id", *carry]
    named = docs.select(F.col("doc_id").cast("long").alias("c0"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry, 1)), F.col("text").alias("t"))
    joined = named.join(lists, F.col("c0") == F.col("k"), "left").select(*(f"c{i}" for i in range(len(kept))), "t", F.coalesce("gone", F.array().cast("array<long>")).alias("gone"))
    fields = ", ".join(f"c{i} {joined.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(kept)))
    out = joined.mapInArrow(_cut(window, len(kept), sent), f"{fields}, n_words long, n_removed long, kept_text string")
    return out.toDF(*kept, "n_words", "n_removed", "kept_text")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words that repeat from smaller documents, over all of documents."""
    out = remove_repeated_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT rid, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
fst AS (SELECT s, min(doc_id) AS f FROM win GROUP BY s),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS p FROM win JOIN fst USING (s) WHERE f < doc_id),
word AS (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS k FROM word ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
