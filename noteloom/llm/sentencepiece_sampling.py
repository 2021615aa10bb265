"""Sampled SentencePiece segmentations and lossless decoding.

A segmentation is drawn from the piece lattice by forward filtering and
backward sampling: the forward sums of all segmentations of each prefix give,
from the end of a text backwards, the exact odds of its last piece. A piece of
rank r weighs (r + 1) ** -SHARPNESS (these vocabularies rank pieces, they hold
no probabilities). Draws depend on the row's key, the place in the text and the
seed alone, so a rerun or another partitioning gives the same pieces.

No piece reaches over the start of a run of spaces or a line break, so the
lattice of a text is a chain of lattices of units (spaces and the word behind
them). The different units of a run of texts are filtered together, and all its
units are sampled in step, with array operations; units that are long or hold
characters without a piece are filtered one by one. Characters without a piece are
written as bytes; so is U+2581 itself, which otherwise stands for a space.
"""

from __future__ import annotations

import re
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import Powers, mix64, spans_hash, table
from noteloom.llm.tokens import text_runs

SHARPNESS = 2.0
SEED = 7
RUN = 3_000_000
MOST_CHARS = 30
#: Units that are filtered at a time: their arrays stay in a core's cache.
TOGETHER = 8192
_UNITS = re.compile(" *[^ ]+| +")


_CHARS = Powers(0xC6A4A7935BD1E995)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and where each text starts."""
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1), at


class _Lookup:
    """A hash table of strings, with the id and weight of each."""

    BITS = 19

    def __init__(self, strings: list[str], values: dict[str, tuple[int, float]] | None):
        points, at = _points(strings)
        hashes = spans_hash(points, at[:-1], at[1:], _CHARS)
        self.hashes = np.zeros(1 << self.BITS, dtype=np.uint64)
        self.place = np.full(1 << self.BITS, -1, dtype=np.int64)
        self.probes = 1
        for k, h in enumerate(hashes.tolist()):
            slot, probe = h >> (64 - self.BITS), 1
            while self.place[slot] >= 0:
                slot, probe = (slot + 1) & ((1 << self.BITS) - 1), probe + 1
            self.hashes[slot], self.place[slot] = h, k
            self.probes = max(self.probes, probe)
        if values is not None:
            self.ids = np.array([values[s][0] for s in strings], dtype=np.int64)
            self.weights = np.array([values[s][1] for s in strings])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the string with each hash and whether there is one."""
        slot = (hashes >> np.uint64(64 - self.BITS)).astype(np.int64)
        hit = self.hashes[slot] == hashes
        for _ in range(self.probes - 1):
            open_ = np.flatnonzero(~hit & (self.place[slot] >= 0))
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.BITS) - 1)
            hit[open_] = self.hashes[slot[open_]] == hashes[open_]
        return self.place[slot], hit & (self.place[slot] >= 0)


class _Numbers(dict):
    """Numbers strings as they come."""

    def __missing__(self, string: str) -> int:
        self[string] = n = len(self)
        return n


class Sampler:
    """Lattices of a vocabulary file and draws from them."""

    def __init__(self, path: str, sharpness: float = SHARPNESS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes: list[int] = [0] * 256
        self.spelled: list[bytes] = []
        self.pieces: dict[str, tuple[int, float]] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.spelled.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.spelled.append(b"")
            else:
                text = piece.replace("▁", " ")
                self.spelled.append(text.encode())
                rank = min(-model.get_score(i), model.get_piece_size()) + 1
                self.pieces[text] = (i, rank**-sharpness)
        self.prefixes = {p[:k] for p in self.pieces for k in range(1, len(p))}
        self.longest = max(map(len, self.pieces))
        self.known = _Lookup(list(self.pieces), self.pieces)
        self.open = _Lookup(list(self.prefixes), None)
        self.singles = np.sort(np.array([ord(p) for p in self.pieces if len(p) == 1], dtype=np.uint32))

    def _lattice(self, unit: str) -> tuple[bytes, bytes, bytes, bytes, int]:
        """Edges sorted by end node: ids, start nodes, end nodes, and the odds
        of the edges up to each among those of its end node. Nodes are
        characters, or bytes of a character without a piece."""
        pieces, prefixes = self.pieces, self.prefixes
        into: list[list[tuple[int, int, float]]] = [[]]
        n, place = len(unit), [0]
        for c in unit:
            place.append(place[-1] + (1 if c in pieces else len(c.encode())))
        into = [[] for _ in range(place[-1] + 1)]
        for s in range(n):
            c = unit[s]
            if c not in pieces:
                for k, b in enumerate(c.encode()):
                    into[place[s] + k + 1].append((place[s] + k, self.bytes[b], 1.0))
            for e in range(s + 1, min(n, s + self.longest) + 1):
                sub = unit[s:e]
                hit = pieces.get(sub)
                if hit is not None:
                    into[place[e]].append((place[s], *hit))
                if sub not in prefixes:
                    break
        forward = [1.0] + [0.0] * place[-1]
        ids, starts, ends, odds = [], [], [], []
        for e in range(1, len(into)):
            total = 0.0
            weights = []
            for s, i, w in into[e]:
                total += forward[s] * w
                weights.append(total)
                ids.append(i)
                starts.append(s)
                ends.append(e)
            forward[e] = total
            odds += [x / total for x in weights[:-1]]
            odds.append(1.0)
            if not 1e-150 < total < 1e150:
                for k in range(max(0, e - 4 * self.longest), e + 1):
                    forward[k] /= total
        return array("H", ids).tobytes(), array("i", starts).tobytes(), array("i", ends).tobytes(), array("d", odds).tobytes(), place[-1]

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        out: list[str] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append("\n")
            if not k:
                line = " " + line
            if "  " in line:
                out += _UNITS.findall(line)
            else:
                head, *rest = line.split(" ")
                if head:
                    out.append(head)
                out += [" " + w for w in rest]
        return out

    def _together(self, units: list[str]) -> tuple[np.ndarray, ...]:
        """The lattices of short units of characters with pieces: number of
        unit, ids, start nodes, end nodes and odds of edges, by end node."""
        points, at = _points(units)
        owner = np.repeat(np.arange(len(units)), np.diff(at))
        start = np.arange(len(points))
        stop = at[1:][owner]
        found = []
        for n in range(1, self.longest + 1):
            keep = start + n <= stop[start]
            start = start[keep]
            if not len(start):
                break
            h = spans_hash(points, start, start + n, _CHARS)
            k, hit = self.known.find(h)
            found.append((start[hit], start[hit] + n, self.known.ids[k[hit]], self.known.weights[k[hit]]))
            start = start[self.open.find(h)[1]]
        start, end, ids, weight = (np.concatenate(c) for c in zip(*found, strict=True))
        # node p of unit u is p + u + 1: one more than characters for each unit.
        # Edges of one length are sorted already, which a stable sort makes use of
        into = end + owner[start]
        order = np.argsort(into, kind="stable")
        start, end, ids, weight, into = start[order], end[order], ids[order], weight[order], into[order]
        unit = owner[start]
        off, depth = at[unit], np.empty(len(start), np.int16)
        np.subtract(end, off, out=depth, casting="unsafe")
        by_depth = np.argsort(depth, kind="stable")
        forward = np.zeros(len(points) + len(units) + 1)
        forward[at[:-1] + np.arange(len(units))] = 1.0
        part, source = np.empty(len(start)), start + unit
        edges = np.concatenate([[0], np.cumsum(np.bincount(depth, minlength=2)[1:])])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            some = by_depth[a:b]
            if len(some):
                got = forward[source[some]] * weight[some]
                part[some] = got
                node = into[some]
                heads = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
                forward[node[heads]] = np.add.reduceat(got, heads)
        odds = np.cumsum(part / forward[into])
        last = np.append(into[1:] != into[:-1], True)
        heads = np.flatnonzero(np.concatenate([[True], last[:-1]]))
        before = np.where(heads > 0, odds[heads - 1], 0.0)
        odds -= np.repeat(before, np.diff(np.append(heads, len(odds))))
        odds[last] = 1.0
        return unit, ids, start - off, end - off, np.minimum(odds, 1.0)

    def _lattices(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
        """The places of the units in another order, their nodes in that order,
        and all edges by end node."""
        points, at = _points(units)
        single = np.isin(points - np.uint64(1), self.singles)
        good = np.add.reduceat(np.append(~single, False), at[:-1]) == 0 if units else np.empty(0, bool)
        good &= np.diff(at) <= MOST_CHARS
        quick = [u for u, g in zip(units, good.tolist(), strict=True) if g]
        slow = [u for u, g in zip(units, good.tolist(), strict=True) if not g]
        parts = []
        for lo in range(0, len(quick), TOGETHER):
            unit, *rest = self._together(quick[lo : lo + TOGETHER])
            parts.append((unit + lo, *rest))
        held = [self._lattice(u) for u in slow]
        if held:
            owner = np.repeat(np.arange(len(held)) + len(quick), [len(h[0]) // 2 for h in held])
            parts.append((owner, *(np.frombuffer(b"".join(h[k] for h in held), t) for k, t in enumerate(("u2", "i4", "i4", "f8")))))
        size = np.array([len(u) for u in quick] + [h[4] for h in held], dtype=np.int64)
        edges = tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 5
        places = np.empty(len(units), dtype=np.int64)
        places[np.argsort(~good, kind="stable")] = np.arange(len(units))
        return places, size, edges

    def sample(self, texts: list[str], keys: np.ndarray, seed: int = SEED) -> list[np.ndarray]:
        """The sampled ids of each text."""
        split = [self.units(t) for t in texts]
        counts = np.array([len(s) for s in split], dtype=np.int64)
        number = _Numbers()
        unit = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        places, size, (unit_of, ids, starts, ends, odds) = self._lattices(list(number))
        unit = places[unit]
        base = np.concatenate([[0], np.cumsum(size + 1)])
        into = base[unit_of] + ends
        head = np.zeros(base[-1], dtype=np.int64)
        first = np.flatnonzero(np.concatenate([[True], into[1:] != into[:-1]])) if len(into) else np.empty(0, np.int64)
        head[into[first]] = first
        text = np.repeat(np.arange(len(texts)), counts)
        first = np.concatenate([[0], np.cumsum(counts)])
        place = np.arange(len(unit)) - first[:-1][text]
        with np.errstate(over="ignore"):
            state = mix64(mix64(keys.astype(np.int64).view(np.uint64) + np.uint64(seed * 2 + 1))[text] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        node = base[unit] + size[unit]
        live = np.arange(len(unit))
        steps, length = [], np.zeros(len(unit), dtype=np.int64)
        while len(live):
            with np.errstate(over="ignore"):
                draw = mix64(state[live] + length[live].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
            draw = (draw >> np.uint64(11)) * 2.0**-53
            at = head[node[live]]
            more = np.flatnonzero(odds[at] <= draw)
            while len(more):
                at[more] += 1
                more = more[odds[at[more]] <= draw[more]]
            steps.append((live, ids[at]))
            length[live] += 1
            node[live] = base[unit[live]] + starts[at]
            live = live[starts[at] > 0]
        offset = np.concatenate([[0], np.cumsum(length)])
        out = np.zeros(offset[-1], dtype="<u4")
        for k, (who, i) in enumerate(steps):
            out[offset[who] + length[who] - 1 - k] = i
        return [out[offset[first[k]] : offset[first[k + 1]]] for k in range(len(texts))]

    def decode(self, ids: list[int]) -> str:
        spelled = self.spelled
        return b"".join([spelled[i] for i in ids]).decode("utf-8", "replace")[1:]


_SAMPLERS: dict[tuple[str, float], Sampler] = {}


def sampler(path: str, sharpness: float = SHARPNESS) -> Sampler:
    """This worker's sampler for a vocabulary file."""
    if (path, sharpness) not in _SAMPLERS:
        _SAMPLERS[path, sharpness] = Sampler(path, sharpness)
    return _SAMPLERS[path, sharpness]


def _encoded(path: str, seed: int, digest: bool):
    def run(batches):
        pieces = sampler(path)
        for batch in batches:
            keys = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            texts = [t or "" for t in batch.column("t").to_pylist()]
            for i, j in text_runs(texts, RUN):
                got = pieces.sample(texts[i:j], keys[i:j], seed)
                ids = batch.column("doc_id").slice(i, j - i)
                if digest:
                    same = [pieces.decode(g.tolist()) == t for g, t in zip(got, texts[i:j], strict=True)]
                    columns = [pa.array([len(g) for g in got], pa.int64()), pa.array([zlib.crc32(g.tobytes()) for g in got], pa.int64()), pa.array(same)]
                    yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "n_pieces", "ids_crc32", "lossless"])
                else:
                    yield pa.RecordBatch.from_arrays([ids, pa.array([g.astype(np.int32) for g in got], pa.list_(pa.int32()))], ["doc_id", "pieces"])

    return run


def encode_sampled(docs: DataFrame, path: str, seed: int = SEED) -> DataFrame:
    """doc_id, pieces: one sampled segmentation for each input row.

    Null and empty texts have no pieces. A null doc_id samples with key zero;
    repeated rows sample alike. An empty table gives an empty result. Only
    doc_id and text are read.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t"))
    return plain.mapInArrow(_encoded(path, seed, False), "doc_id long, pieces array<int>")


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of encode_sampled's rows; null pieces give a null text."""

    def run(batches):
        pieces = sampler(path)
        for batch in batches:
            texts = [None if p is None else pieces.decode(p) for p in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "pieces").mapInArrow(run, "doc_id long, text string")


def op6_sentencepiece_sampling(spark, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document (their number and crc32) and whether
    they decode to its exact text."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t"))
    path = public_tokenizers.path("piece_bpe_32k.model")
    return docs.mapInArrow(_encoded(path, SEED, True), "doc_id long, n_pieces long, ids_crc32 long, lossless boolean")
