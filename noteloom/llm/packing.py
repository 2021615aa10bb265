"""Packing of documents into sequences by shortest-pack-first over the length
histogram.

A document's ids are cut at multiples of the sequence length; what is left over
is packed. Only the histogram of lengths (at most `size` numbers) comes to the
driver, where lengths are placed longest first: a length goes to the pattern
that holds fewest tokens if it fits, else it opens a new pattern, and patterns
carry counts, so the work does not depend on the number of documents. Patterns
are joined back by rank: the r-th piece of a length goes to the sequence that
the pattern table names for r.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.llm.common import table, written
from noteloom.llm.tokens import ROWS, encoder

SIZE = 1024
END_ID = 0


def pack_histogram(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of each pattern. At most two patterns arise for each
    length, so there are at most 2 * size."""
    done: list[tuple[int, tuple[int, ...]]] = []
    heap: list[tuple[int, int, tuple[int, ...]]] = []
    for length in sorted((n for n in counts if n > 0), reverse=True):
        left, fresh = counts[length], []
        if length == size:
            done.append((left, (length,)))
            continue
        while left and heap and heap[0][0] + length <= size:
            total, number, lengths = heapq.heappop(heap)
            fits = (size - total) // length
            if number <= left:
                each = min(fits, left // number)
                fresh.append((total + each * length, number, lengths + (length,) * each))
                left -= each * number
            else:
                heapq.heappush(heap, (total, number - left, lengths))
                fresh.append((total + length, left, (*lengths, length)))
                left = 0
        each = size // length
        if left >= each:
            fresh.append((each * length, left // each, (length,) * each))
        if left % each:
            fresh.append((left % each * length, 1, (length,) * (left % each)))
        for total, number, lengths in fresh:
            if total == size:
                done.append((number, lengths))
            else:
                heapq.heappush(heap, (total, number, lengths))
    return done + [(number, lengths) for _, number, lengths in heap]


def placements(patterns: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, offset), sorted: the
    ranks from one row's first rank to the next one's go to sequences one by
    one, all at the row's offset."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for number, lengths in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + number
            offset += length
        sequence += number
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def _pieces(path: str, size: int):
    def run(batches):
        tokens = encoder(path)
        bucket = TaskContext.get().partitionId()
        ranks: dict[int, int] = {}
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for i in range(0, len(batch), ROWS):
                j = min(i + ROWS, len(batch))
                rows = []
                for doc, raw in zip(ids[i:j], tokens.encode(batch.column("t").slice(i, j - i)), strict=True):
                    raw = memoryview(raw + end)
                    total = len(raw) // 4
                    for at in range(0, total, size):
                        n = min(size, total - at)
                        rank = ranks.get(n, 0)
                        ranks[n] = rank + 1
                        rows.append((doc, at, n, zlib.crc32(raw[4 * at : 4 * (at + n)]), total, bucket, rank))
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", "rank"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
        tokens.forget()

    return run


def _placed(sent):
    def run(batches):
        rows = sent.value
        key = rows[:, 0] << 44 | rows[:, 1]
        for batch in batches:
            c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank", "base")}
            rank = c["rank"] + c["base"]
            at = np.searchsorted(key, c["length"] << 44 | rank, "right") - 1
            found = [pa.array(rows[at, 2] + rank - rows[at, 1]), pa.array(rows[at, 3])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *found], [*names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one
    row for each piece of each input row.

    Null and empty texts are one piece, the end id. Rows with null or repeated
    doc_ids are documents like any other. A long text gives many pieces, whole.
    An empty table gives an empty result. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket long, rank long"
    pieces = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t")).mapInArrow(_pieces(path, size), fields), "op7-pieces")
    counts = pieces.groupBy("bucket", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    sent = spark.sparkContext.broadcast(placements(pack_histogram(histogram, size)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select(F.col("bucket").alias("kb"), F.col("length").alias("kl"), F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(bases, F.expr("bucket = kb and length = kl")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", "base")
    return ranked.mapInArrow(_placed(sent), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
