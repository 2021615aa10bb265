"""Token-id files: adaptive context-mixing range coding in blocks.

Three predictions of the next id are mixed, their probabilities added by weight:
the id last seen after the same two ids (order 2), the one last seen after the
same id (order 1), and the id frequencies of the segment (order 0). With weights
w0 + w1 + w2 = 1, an id x has the interval that starts at w0 * C(x) + w1 * [x >
id1] + w2 * [x > id2] and is w0 * f(x) + w1 * [x = id1] + w2 * [x = id2] wide.
The order 1 and 2 predictions adapt with every id, and so do the weights, in a
context made of the confidences of both predictions. One interval of a 64-bit
carry-less range coder codes an id.

A block codes at most BLOCK ids; its predictions, weights and coder are reset,
and it carries the crc32 of its ids, so a damaged block is found and the others
stay readable. Blocks are coded in step, one id of each at a time, with array
operations. A segment holds whole documents (about SEGMENT ids): a header, the
lengths, the frequencies (with a crc32 of both) and the blocks. Segments are rows
of a table with binary payloads, which makes writing them atomic in any store
Spark reaches. Ids must be below 65,536.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.llm.common import freed, table, written
from noteloom.llm.tokens import ROWS, encoder

BLOCK = 2048
LANES = 2048
SEGMENT = 1 << 22
MAGIC = b"NLTF"
VERSION = 2
#: Characters of a text that deal out rows of one doc_id.
PREFIX = 64

_U = np.uint64
_SLOTS1, _SLOTS2 = 512, 256
#: Bits of an order 0 frequency and of a weight.
_FINE, _PARTS = 18, 12
_MOST_WEIGHT = np.int32((1 << _PARTS) - 64)
_FRESH = np.int32(1 + (1 << 17))
_RATE = 4
_WORD, _LOW = _U(32), _U((1 << 32) - 1)
_HEAD = "<4sHIIQIII"
#: First weights (order 2 << 16 | order 1) by confidence of order 2 and of order 1; 0: nothing seen yet.
_FIRST = np.array([(w2 << 16) | w1 for w2, w1 in ((0, 0), (0, 500), (0, 1600), (0, 2800), (900, 0), (900, 300), (900, 800), (800, 1600),
                   (2200, 0), (2200, 200), (2200, 400), (2000, 1000), (3300, 0), (3300, 100), (3300, 200), (3300, 400))], dtype=np.int32)


class Frequencies:
    """Order 0: a share of 2**_FINE for each id that occurs, in id order."""

    def __init__(self, known: np.ndarray, share: np.ndarray):
        self.known, self.share = known, share
        # one place before each id, as -1 stands for no prediction
        self.f = np.zeros((1 << 16) + 1, dtype=np.int32)
        self.f[known + 1] = share
        self.c = (np.cumsum(self.f) - self.f).astype(np.int32)
        self.slot = np.repeat(known, share).astype(np.int32)

    @classmethod
    def of(cls, ids: np.ndarray) -> Frequencies:
        count = np.bincount(ids)
        known = np.flatnonzero(count)
        share = np.maximum(1, count[known] * ((1 << _FINE) - len(known)) // max(1, len(ids)))
        if len(known):
            share[np.argmax(share)] += (1 << _FINE) - share.sum()
        return cls(known, share)

    def packed(self) -> bytes:
        return zlib.compress(np.diff(self.known, prepend=0).astype("<u4").tobytes() + self.share.astype("<u4").tobytes())

    @classmethod
    def unpacked(cls, data: bytes) -> Frequencies:
        both = np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64).reshape(2, -1)
        return cls(np.cumsum(both[0]), both[1])


# slots of the contexts, by id
_ID = np.arange(1 << 16, dtype=np.int64)
_CONTEXT1 = (_ID * 40503 >> 4) & (_SLOTS1 - 1)
_LAST2, _BEFORE2 = (_ID * 30011 >> 3) & (_SLOTS2 - 1), (_ID * 7919 >> 2) & (_SLOTS2 - 1)
# by 2 * confidence + whether the prediction was right: kept, and what is added to the entry then
_KEPT = np.array([False, False, False, True, True, True, True, True])
_STEP = np.array([0, 0, 0, 1, -1, 1, -1, 0], dtype=np.int32) << 17


class _Models:
    """The adaptive models of n blocks, all reset. Prediction entries hold an id
    plus one and, above 17 bits, a confidence of 1 to 3; 0: nothing seen."""

    def __init__(self, n: int):
        lane = np.arange(n, dtype=np.int64)
        self.one = np.zeros(n * _SLOTS1, dtype=np.int32)
        self.two = np.zeros(n * _SLOTS2, dtype=np.int32)
        self.weight = np.tile(_FIRST, n)
        self.lane1, self.lane2, self.lane16 = lane * _SLOTS1, lane * _SLOTS2, lane * 16
        self.at1, self.at2 = self.lane1 + _CONTEXT1[0], self.lane2 + (_LAST2[0] ^ _BEFORE2[0])
        self.before2 = np.full(n, _BEFORE2[0])

    def shrink(self, n: int) -> None:
        """Keep the first n blocks."""
        for name in ("lane1", "lane2", "lane16", "at1", "at2", "before2"):
            setattr(self, name, getattr(self, name)[:n])

    def look(self) -> None:
        """Predictions and weights for the next id of each block."""
        self.p1, self.p2 = self.one.take(self.at1), self.two.take(self.at2)
        self.id1, self.id2 = (self.p1 & 0x1FFFF) - 1, (self.p2 & 0x1FFFF) - 1
        self.sure1, self.sure2 = self.p1 >> 17, self.p2 >> 17
        self.at_w = self.lane16 + (self.sure2 << 2 | self.sure1)
        w = self.weight.take(self.at_w)
        self.w1, self.w2 = w & 0xFFFF, w >> 16
        self.w0 = (1 << _PARTS) - self.w1 - self.w2

    def learn(self, ids: np.ndarray, x: np.ndarray, hit1: np.ndarray, hit2: np.ndarray) -> None:
        """Where both predictions were right, the weight of order 2 grows. ids:
        x in 64 bits."""
        w1 = self.w1 + ((hit1 > hit2) * _MOST_WEIGHT - self.w1 >> _RATE)
        w2 = self.w2 + (hit2 * _MOST_WEIGHT - self.w2 >> _RATE)
        self.weight[self.at_w] = w2 << 16 | w1
        fresh = x + _FRESH
        for slots, at, hit, sure, old in ((self.one, self.at1, hit1, self.sure1, self.p1), (self.two, self.at2, hit2, self.sure2, self.p2)):
            case = (sure << 1) + hit
            slots[at] = np.where(_KEPT.take(case), old + _STEP.take(case), fresh)
        self.at1 = self.lane1 + _CONTEXT1.take(ids)
        self.at2 = self.lane2 + (_LAST2.take(ids) ^ self.before2)
        self.before2 = _BEFORE2.take(ids)


class _Coder:
    """Interval and word streams of the blocks."""

    def __init__(self, n: int):
        self.low, self.span = np.zeros(n, dtype=np.uint64), np.full(n, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)

    def narrow(self, unit: np.ndarray, start: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Take the interval; the blocks whose top word is settled."""
        n = len(unit)
        self.low[:n] += unit * start.astype(np.uint64)
        np.multiply(unit, width.astype(np.uint64), out=self.span[:n])
        return np.flatnonzero(self.span[:n] <= _LOW)

    def shift(self, which: np.ndarray) -> np.ndarray:
        """Shift the top words out; a span across two of them is cut short."""
        low, span = self.low.take(which), self.span.take(which)
        top = low >> _WORD
        across = (low + span) >> _WORD != top
        span = np.where(across, (~low + _U(1)) & _LOW, span)
        self.low[which], self.span[which] = low << _WORD, span << _WORD
        return top


def _steps(sizes: np.ndarray):
    """(step, number of blocks that have an id there); sizes do not grow."""
    live = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))))
    return enumerate(live.tolist())


def encode_blocks(ids: np.ndarray, sizes: np.ndarray, base: Frequencies) -> list[bytes]:
    """The payload of each block; blocks lie in ids one after another and their
    sizes do not grow."""
    n, longest = len(sizes), int(sizes.max(initial=0))
    rows = np.zeros(n * longest, dtype=np.int32)
    rows[: len(ids)] = ids
    columns = np.ascontiguousarray(rows.reshape(n, longest).T)
    m, coder = _Models(n), _Coder(n)
    out, at = np.zeros((n, longest + 2), dtype="<u4"), np.zeros(n, dtype=np.int64)
    for step, live in _steps(sizes):
        if live < len(m.at1):
            m.shrink(live)
        x = columns[step, :live]
        wide = x.astype(np.int64)
        place = wide + 1
        m.look()
        hit1, hit2 = x == m.id1, x == m.id2
        start = m.w0 * base.c.take(place) + ((x > m.id1) * m.w1 + (x > m.id2) * m.w2 << _FINE)
        width = m.w0 * base.f.take(place) + (hit1 * m.w1 + hit2 * m.w2 << _FINE)
        which = coder.narrow(coder.span[:live] >> _U(_FINE + _PARTS), start, width)
        out[which, at.take(which)] = coder.shift(which)
        at[which] += 1
        m.learn(wide, x, hit1, hit2)
    lanes = np.arange(n)
    out[lanes, at], out[lanes, at + 1] = coder.low >> _WORD, coder.low & _LOW
    return [out[k, : at[k] + 2].tobytes() for k in range(n)]


def decode_blocks(payloads: list[bytes], sizes: np.ndarray, base: Frequencies) -> np.ndarray:
    """The ids of blocks whose sizes do not grow, one block after another."""
    n, longest = len(sizes), int(sizes.max(initial=0))
    columns = np.zeros((longest, n), dtype=np.int32)
    words = np.concatenate([np.frombuffer(b"".join(payloads), dtype="<u4"), np.zeros(2, "<u4")]).astype(np.uint64)
    at = np.concatenate([[0], np.cumsum([len(p) // 4 for p in payloads])])[:-1].astype(np.int64)
    code = words[at] << _WORD | words[at + 1]
    at += 2
    m, coder = _Models(n), _Coder(n)
    most, last = len(words) - 1, len(base.slot) - 1
    for step, live in _steps(sizes):
        if live < len(m.at1):
            m.shrink(live)
        m.look()
        unit = coder.span[:live] >> _U(_FINE + _PARTS)
        v = ((code[:live] - coder.low[:live]) // np.maximum(unit, _U(1))).astype(np.int32)
        big1, big2 = m.w1 << _FINE, m.w2 << _FINE
        place1, place2 = m.id1 + np.int64(1), m.id2 + np.int64(1)
        # the intervals of both predictions; if they are the same, of both as one
        from1 = m.w0 * base.c.take(place1) + (m.id1 > m.id2) * big2
        from2 = m.w0 * base.c.take(place2) + (m.id2 > m.id1) * big1
        to1 = from1 + m.w0 * base.f.take(place1) + big1
        to2 = from2 + m.w0 * base.f.take(place2) + big2
        same = m.id1 == m.id2
        to1 += same * big2
        to2 += same * big1
        behind1, behind2 = v >= to1, v >= to2
        other = ((v - behind1 * big1 - behind2 * big2) / m.w0).astype(np.int64)
        x = base.slot.take(np.minimum(np.maximum(other, 0), last))
        x = np.where((v >= from1) > behind1, m.id1, np.where((v >= from2) > behind2, m.id2, x))
        wide = x.astype(np.int64)
        place = wide + 1
        hit1, hit2 = x == m.id1, x == m.id2
        start = m.w0 * base.c.take(place) + ((x > m.id1) * m.w1 + (x > m.id2) * m.w2 << _FINE)
        width = m.w0 * base.f.take(place) + (hit1 * m.w1 + hit2 * m.w2 << _FINE)
        which = coder.narrow(unit, start, width)
        coder.shift(which)
        code[which] = code.take(which) << _WORD | words.take(np.minimum(at.take(which), most))
        at[which] += 1
        columns[step, :live] = x
        m.learn(wide, x, hit1, hit2)
    return np.ascontiguousarray(columns.T).ravel()[: int(sizes.sum())]


def encode_segment(lengths: list[int], raw: bytes) -> bytes:
    """A segment of documents with `lengths` ids each, whose ids (32-bit
    little-endian, below 65,536) are raw."""
    ids = np.frombuffer(raw, dtype="<u4").view("<i4")
    if len(ids) and int(ids.max()) >= 1 << 16:
        raise ValueError("ids must be below 65,536")
    sizes = np.full(-(-len(ids) // BLOCK), BLOCK, dtype=np.int64)
    if len(ids) % BLOCK:
        sizes[-1] = len(ids) % BLOCK
    base = Frequencies.of(ids)
    front = [np.array(lengths, dtype="<u4").tobytes(), base.packed()]
    payloads: list[bytes] = []
    for at in range(0, len(sizes), LANES):
        payloads += encode_blocks(ids[at * BLOCK : (at + LANES) * BLOCK], sizes[at : at + LANES], base)
    out = [struct.pack(_HEAD, MAGIC, VERSION, len(lengths), len(sizes), len(ids), len(front[1]), zlib.crc32(front[0]), zlib.crc32(front[1])), *front]
    for k, p in enumerate(payloads):
        part = raw[4 * k * BLOCK : 4 * (k + 1) * BLOCK]
        out += [struct.pack("<III", len(part) // 4, zlib.crc32(part), len(p)), p]
    return b"".join(out)


def decode_segment(data: bytes) -> tuple[np.ndarray, bytes]:
    """Document lengths and raw ids; ValueError if a block fails its check."""
    magic, version, n_docs, n_blocks, n_ids, packed, crc_lengths, crc_base = struct.unpack_from(_HEAD, data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a segment of this format")
    at = struct.calcsize(_HEAD)
    front = data[at : at + 4 * n_docs], data[at + 4 * n_docs : at + 4 * n_docs + packed]
    if (zlib.crc32(front[0]), zlib.crc32(front[1])) != (crc_lengths, crc_base):
        raise ValueError("the head of the segment is damaged")
    lengths, base = np.frombuffer(front[0], "<u4").astype(np.int64), Frequencies.unpacked(front[1])
    at += 4 * n_docs + packed
    sizes, sums, payloads = [], [], []
    for _ in range(n_blocks):
        size, crc, n = struct.unpack_from("<III", data, at)
        at += 12
        sizes.append(size)
        sums.append(crc)
        payloads.append(data[at : at + n])
        at += n
    parts = []
    for k in range(0, n_blocks, LANES):
        parts.append(decode_blocks(payloads[k : k + LANES], np.array(sizes[k : k + LANES], dtype=np.int64), base).tobytes())
    raw = b"".join(parts)
    for k, (size, crc) in enumerate(zip(sizes, sums, strict=True)):
        if zlib.crc32(raw[4 * k * BLOCK : 4 * (k * BLOCK + size)]) != crc:
            raise ValueError(f"block {k} is damaged")
    if len(raw) != 4 * n_ids:
        raise ValueError("the segment is cut short")
    return lengths, raw


def _segments(path: str, end_id: int):
    def run(batches):
        tokens, part, number = encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        docs: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def flush():
            nonlocal number, size
            data = encode_segment([len(h) // 4 for h in held], b"".join(held))
            columns = [pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([size // 4], pa.int64()), pa.array([list(docs)], pa.list_(pa.int64())), pa.array([data], pa.binary())]
            number, size = number + 1, 0
            docs.clear()
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["part", "segment", "n_ids", "doc_ids", "data"])

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for i in range(0, len(batch), ROWS):
                j = min(i + ROWS, len(batch))
                for doc, raw in zip(ids[i:j], tokens.encode(batch.column("t").slice(i, j - i)), strict=True):
                    docs.append(doc)
                    held.append(raw + end)
                    size += len(held[-1])
                    if size >= 4 * SEGMENT:
                        yield flush()
        if docs:
            yield flush()
        tokens.forget()

    return run


def _read(batches):
    for batch in batches:
        for part, segment, docs, data in zip(*(batch.column(c) for c in ("part", "segment", "doc_ids", "data")), strict=True):
            lengths, raw = decode_segment(data.as_py())
            docs = docs.values
            n = len(lengths)
            ends = np.cumsum(lengths)
            view = memoryview(raw)
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
            columns = [docs, pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64()), pa.array(np.full(n, part.as_py())), pa.array(np.full(n, segment.as_py()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "at", "n_tokens", "ids_crc32", "part", "segment"])
            del raw, view
    freed()


def write_token_files(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """part, segment, n_ids, doc_ids, data: the files, written to the shared
    folder in ascending order of doc_id (part, then segment, then position);
    nulls first, rows with equal doc_id in the order of their texts, by whose
    beginnings they are dealt out too. Only doc_id and text are read."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t"))
    dealt = plain.repartitionByRange(n, F.col("doc_id"), F.substring("t", 1, PREFIX)).sortWithinPartitions("doc_id", "t")
    return written(dealt.mapInArrow(_segments(path, end_id), "part long, segment long, n_ids long, doc_ids array<long>, data binary"), "op9-ids")


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    sizes = files.groupBy("part", "segment").agg(F.sum("n_ids").alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(parts, F.col("part") == F.col("p")).select(F.col("part").alias("kp"), F.col("segment").alias("ks"), (F.col("base") + F.coalesce(F.sum("n").over(inner), F.lit(0))).alias("base"))
    docs = files.select("part", "segment", "doc_ids", "data").mapInArrow(_read, "doc_id long, at long, n_tokens long, ids_crc32 long, part long, segment long")
    return docs.join(starts, F.expr("part = kp and segment = ks")).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_file(spark, sf_dir: str) -> DataFrame:
    """All documents' ids, written in ascending doc_id order and read back.

    Null and empty texts hold the end id alone; a text of any length is one
    document, in as many blocks as it fills; every input row gives one row; an
    empty table gives an empty result; other columns are not read."""
    import public_tokenizers

    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
