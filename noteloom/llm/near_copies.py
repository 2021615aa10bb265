"""Near copies by SimHash ball hashing, verified by exact Jaccard similarity.

At a similarity of 0.8 some 15 % of all SimHash bits differ, which no ball of a
64-bit fingerprint reaches, so a fingerprint is taken longer and in pieces:

1. a text's class is a digest of its set of `size`-word shingles: copies with
   equal sets are one class. Each class has a fingerprint of PIECES or more
   pieces, majority bits of hashed word pairs (pairs, as a changed word spoils
   fewer of them; the similarity itself is that of the shingles);
2. each piece emits its variants within half of RADIUS, 1 bit, and classes meet
   on variants. The bits of a piece grow with the logarithm of the classes, so
   that chance meetings a class stay about the same;
3. colliding pairs are deduplicated, held against the whole fingerprint, and
   the rest against the exact similarity of their shingle sets;
4. of groups over MOST_PAIRED only a chain of those with the same piece, in an
   order of its own, is tried, as all pairs would grow with the square. Copies of one text lie around it, so the CENTRES
   members whose fingerprints are nearest to the majority of those with the same
   piece are found next, and each member of a group is tried with the centres in
   it that are of another component;
5. the members of such groups are then joined exactly, over all of them: similar
   sets share one of the rarest fifth of their shingles. Pairs within a component
   are left out, and those whose parity bits show that they cannot be similar.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import LOWER, SLICE_BYTES, Powers, Texts, distinct, dropped, freed, joined_by_key, mix64, slices, spans_hash, text_buffers, written
from noteloom.llm.components import connected_components
from noteloom.llm.simhash import different

SIZE = 5
LEAST = 0.8
RADIUS = 2
PIECES = 13
MOST_PAIRED = 4
#: Members that the majority is taken over, centres of those with one piece, and centres that a group's members are tried with: those of most groups.
BLOCK = 4096
CENTRES = 2
MOST_CENTRES = 1
#: Pairs whose fingerprints differ in more than this share of bits are not verified: at a similarity of
#: 0.8 the share is 0.15, with a deviation of 0.02.
FAR = 0.21
FIELD_BITS = 27
#: Shingles are ordered by how often their bucket was met; words of 64 parity bits of a set; members held against each other at a time.
BUCKETS = 1 << 18
PARITY = 16
SIDE = 512
#: Ids of rows to drop that are broadcast at most.
MOST_SENT = 500_000

_PAIR = Powers(0x8CB92BA72F3D8DD7)
_HASH_BITS = np.uint64(52)
_ONES = np.uint64(0x0101010101010101)


def piece_bits(n: int) -> int:
    """Bits of a piece for n classes: chance meetings of all grow as n or less."""
    return max(24, min(54, math.ceil(1.3 * math.log2(max(2, n))) + 7))


def pieces_of(bits: int) -> int:
    return max(PIECES, bits // 2 - 1)


def votes(h: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set in h[edge[i]:edge[i + 1]], none empty:
    eight bits at a time, in the bytes of a sum over at most 255 values."""
    parts = -(-np.diff(edge) // 255)
    text = np.repeat(np.arange(len(parts)), parts)
    first = np.cumsum(parts) - parts
    start = edge[:-1][text] + 255 * (np.arange(len(text)) - first[text])
    out = np.empty((len(parts), 8, 8), dtype=np.int64)
    for k in range(8):
        sums = np.add.reduceat((h >> np.uint64(k)) & _ONES, start)
        out[:, :, k] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    return out.reshape(-1, 64)


def shingle_sets(run: Texts, size: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of each text as 52-bit hashes, text by text, and
    where each text's begin. Fewer words than size are one shingle."""
    counts = np.diff(run.first)
    number = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    text = np.repeat(np.arange(len(counts)), number)
    begin = run.first[:-1][text] + np.arange(len(text)) - (np.cumsum(number) - number)[text]
    h = spans_hash(run.hashes, begin, begin + np.minimum(size, counts)[text], powers)
    keys = distinct(text.astype(np.uint64) << _HASH_BITS | h >> (np.uint64(64) - _HASH_BITS))
    edge = np.searchsorted(keys, np.arange(len(counts) + 1, dtype=np.uint64) << _HASH_BITS)
    return keys & ((np.uint64(1) << _HASH_BITS) - np.uint64(1)), edge


_SHINGLE = Powers(0x9FB21C651E98DF25)


def digests(run: Texts, size: int) -> np.ndarray:
    """64 bits for each text's set of shingles."""
    h, edge = shingle_sets(run, size, _SHINGLE)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(h + np.uint64(1)))])
    return mix64(total[edge[1:]] - total[edge[:-1]] + np.diff(edge).astype(np.uint64)).view(np.int64)


def lowered(column: pa.Array):
    """(from, to, texts with A-Z lower-cased) for runs of rows."""
    for i, j, run in slices(column):
        yield i, j, Texts(LOWER[run.data], run.offsets)


def _prints(size: int, words: int):
    """Digest and fingerprint (words of 64 bits) of each text."""
    salts = mix64(np.arange(1, words + 1, dtype=np.uint64))

    def run(batches):
        for batch in batches:
            for i, j, texts in lowered(batch.column("t")):
                h, edge = shingle_sets(texts, 2, _PAIR)
                some = np.flatnonzero(np.diff(edge))
                at = np.append(edge[some], len(h))
                sketch = np.zeros((j - i, words), dtype=np.int64)
                for w in range(words if len(some) else 0):
                    set_ = 2 * votes(mix64(h + salts[w]), at) > np.diff(at)[:, None]
                    sketch[some, w] = np.packbits(set_, axis=1, bitorder="little").view(np.int64)[:, 0]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(digests(texts, size)), *(pa.array(sketch[:, w].copy()) for w in range(words))], ["doc_id", "digest", *(f"s{w}" for w in range(words))]
                )
        freed()

    return run


def _variants(bits: int, pieces: int, names: list[str], carried: tuple[str, ...] = ()):
    """key, flip, digest and the carried columns: each piece as it is (flip 0)
    and with one bit flipped."""
    masks = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(bits, dtype=np.uint64)])
    flips = np.arange(bits + 1, dtype=np.int8)

    def run(batches):
        for whole in batches:
            for lo in range(0, len(whole), 1000):
                batch = whole.slice(lo, 1000)
                bit = np.unpackbits(_bits_of(batch, names).view(np.uint8), axis=1, bitorder="little").astype(np.uint64)
                rows = pa.array(np.repeat(np.arange(len(batch)), bits + 1))
                kept = [batch.column(c).take(rows) for c in ("digest", *carried)]
                for t in range(pieces):
                    value = (bit[:, t * bits : (t + 1) * bits] << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
                    key = (value[:, None] ^ masks | np.uint64(t) << np.uint64(bits)).view(np.int64).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.tile(flips, len(batch))), *kept], ["key", "flip", "digest", *carried])

    return run


def _runs(batches, names: tuple[str, ...], most: int, overlap: int):
    """Rows sorted by their first column, as arrays of whole groups; a group
    over `most` rows comes in several runs that share `overlap` rows."""
    held = None
    for batch in batches:
        rows = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in names)
        if held is not None:
            rows = tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
        key = rows[0]
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))
        if len(key) - last > most:
            yield rows
            held = tuple(x[-overlap:] for x in rows)
        else:
            if last:
                yield tuple(x[:last] for x in rows)
            held = tuple(x[last:] for x in rows)
    if held is not None and len(held[0]):
        yield held


def _pairs_of(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    x, y = np.concatenate([*a, np.empty(0, np.int64)]), np.concatenate([*b, np.empty(0, np.int64)])
    return different(np.minimum(x, y), np.maximum(x, y))


def _met(batches):
    """a < b: pairs to verify of the groups at each variant, early where both
    have the piece itself; a = b names a member of a group that was not paired
    whole. Two equal pieces meet at every variant; they are paired at the one
    that neither has flipped."""
    for key, flip, digest in _runs(batches, ("key", "flip", "digest"), 100_000, MOST_PAIRED + 1):
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(start, len(key)))
        large = count > MOST_PAIRED
        a, b, early_a, early_b = [], [], [], []
        small, size = start[~large & (count > 1)], count[~large & (count > 1)]
        for step in range(1, int(size.max(initial=0))):
            wide = size > step
            s, c = small[wide], size[wide] - step
            left = np.repeat(s - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
            apart = (flip[left] != flip[left + step]) | (flip[left] == 0)
            left = left[apart]
            same = (flip[left] == 0) & (flip[left + step] == 0)
            early_a.append(digest[left[same]])
            early_b.append(digest[left[same] + step])
            a.append(digest[left[~same]])
            b.append(digest[left[~same] + step])
        for s, c in zip(start[large].tolist(), count[large].tolist(), strict=True):
            order = s + np.argsort(mix64(digest[s : s + c].view(np.uint64) ^ mix64(key[s : s + 1].view(np.uint64))))
            own, same = digest[order], digest[order[flip[order] == 0]]
            early_a += [own, same[:-1]]
            early_b += [own, same[1:]]
        for early, pairs in ((True, _pairs_of(early_a, early_b)), (False, _pairs_of(a, b))):
            yield pa.RecordBatch.from_arrays([*pairs.columns, pa.array(np.full(len(pairs), early))], ["a", "b", "early"])


def _bits_of(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """The fingerprints as rows of words."""
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1).view(np.uint64)


def _own_pieces(bits: int, pieces: int, names: list[str]):
    """key, order and the columns of each row, once for each piece as it is."""

    def run(batches):
        for batch in batches:
            bit = np.unpackbits(_bits_of(batch, names).view(np.uint8), axis=1, bitorder="little").astype(np.uint64)
            digest = batch.column("digest").to_numpy(zero_copy_only=False).view(np.uint64)
            for t in range(pieces):
                value = (bit[:, t * bits : (t + 1) * bits] << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
                key = value | np.uint64(t) << np.uint64(bits)
                order = mix64(digest ^ mix64(key))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(order.view(np.int64)), *batch.columns], ["key", "order", *batch.schema.names])

    return run


def _central(names: list[str]):
    """digest of the centres of each large group. Rows come sorted by key and
    order; the majority is that of a group's first BLOCK members."""

    def run(batches):
        name, held = None, []

        def centres():
            digest, bits = (np.concatenate(c) for c in zip(*held, strict=True))
            digest, bits = digest[:BLOCK], bits[:BLOCK]
            if len(digest) <= MOST_PAIRED:
                return
            bit = np.unpackbits(bits.view(np.uint8), axis=1)
            most = np.packbits(2 * bit.sum(axis=0, dtype=np.int64) > len(bit)).view(np.uint64)
            middle = np.argsort(np.bitwise_count(bits ^ most).sum(axis=1), kind="stable")[:CENTRES]
            yield pa.RecordBatch.from_arrays([pa.array(digest[middle])], ["digest"])

        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False)
            cut = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key)).tolist() if len(key) else [0]
            digest, bits = batch.column("digest").to_numpy(zero_copy_only=False), _bits_of(batch, names)
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if key[i] != name:
                    if held:
                        yield from centres()
                    name, held = key[i], []
                if sum(len(h[0]) for h in held) < BLOCK:
                    held.append((digest[i:j].copy(), bits[i:j].copy()))
        if held:
            yield from centres()

    return run


def _with_centres(batches):
    """a < b: members of a group with its centres, where the components differ.
    Rows come sorted by key, centres first, those of most groups at the head."""
    name, held = None, []
    for batch in batches:
        key, flip, digest, root, other = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "flip", "digest", "root", "other"))
        cut = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key)).tolist() if len(key) else [0]
        a, b = [], []
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            whole = key[i] != name and j < len(key)
            if key[i] != name:
                name, held = key[i], []
            if whole and j - i <= MOST_PAIRED:  # these were paired
                continue
            for c in range(i, min(j, i + MOST_CENTRES - len(held))):
                if not other[c]:
                    break
                held.append((flip[c], digest[c], root[c]))
            for f, d, r in held:
                hit = np.flatnonzero((root[i:j] != r) & ((flip[i:j] != f) | (flip[i:j] == 0))) + i
                a.append(digest[hit])
                b.append(np.full(len(hit), d))
        if a:
            yield _pairs_of(a, b)


def _texts_of(size: int, field):
    """Digest and text of the rows that the field marks."""

    def run(batches):
        bits = np.frombuffer(field.value, np.uint8)
        for batch in batches:
            for i, j, texts in lowered(batch.column("t")):
                digest = digests(texts, size)
                slot = (field_hash(digest, batch.column("doc_id").to_numpy(zero_copy_only=False)[i:j]) >> np.uint64(64 - FIELD_BITS)).astype(np.int64)
                rows = pa.array(np.flatnonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i).take(rows), pa.array(digest).take(rows), batch.column("t").slice(i, j - i).take(rows)], ["doc_id", "digest", "t"])
        freed()

    return run


def field_hash(digest: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    return mix64(digest.view(np.uint64) ^ mix64(doc_id.astype(np.int64).view(np.uint64) + np.uint64(1)))


def _slots(batches):
    for batch in batches:
        slot = distinct(field_hash(batch.column("digest").to_numpy(zero_copy_only=False), batch.column("sid").to_numpy(zero_copy_only=False)) >> np.uint64(64 - FIELD_BITS)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(slot >> 6), pa.array(slot & 63)], ["at", "bit"])


def _similar(size: int, least: float):
    """a, b of the pairs whose shingle sets are at least so similar."""

    def run(batches):
        for batch in batches:
            bytes_ = sum(np.diff(text_buffers(batch.column(c))[1]) for c in ("ta", "tb"))
            at, i = np.concatenate([[0], np.cumsum(bytes_)]), 0
            while i < len(batch):
                j = max(i + 1, min(i + 2048, int(np.searchsorted(at, at[i] + SLICE_BYTES, "right")) - 1))
                sets = []
                for c in ("ta", "tb"):
                    data, offsets = text_buffers(batch.column(c).slice(i, j - i))
                    h, edge = shingle_sets(Texts(LOWER[data], offsets), size, _SHINGLE)
                    sets.append(np.repeat(np.arange(j - i, dtype=np.uint64), np.diff(edge)) << _HASH_BITS | h)
                both = np.sort(np.concatenate(sets))
                pair = (both >> _HASH_BITS).astype(np.int64)
                shared = np.bincount(pair[1:][both[1:] == both[:-1]], minlength=j - i)
                alike = shared >= least * (np.bincount(pair, minlength=j - i) - shared) - 1e-9
                yield batch.slice(i, j - i).select(["a", "b"]).filter(pa.array(alike))
                i = j
        freed()

    return run


def _bucket_counts(size: int):
    """How many sets hold a shingle of each bucket."""

    def run(batches):
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for _, _, texts in lowered(batch.column("t")):
                h, _ = shingle_sets(texts, size, _SHINGLE)
                counts += np.bincount((h & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])
        freed()

    return run


def _rarest(size: int, least: float, sent):
    """Of each set its rarest shingles, so many that similar sets share one,
    with the root, the size of the set and its parity bits."""

    def run(batches):
        counts = np.frombuffer(sent.value, "<i8")
        for batch in batches:
            for i, j, texts in lowered(batch.column("t")):
                h, edge = shingle_sets(texts, size, _SHINGLE)
                n = np.diff(edge)
                owner = np.repeat(np.arange(j - i), n)
                bits = np.zeros((j - i, 64 * PARITY), dtype=np.uint8)
                np.bitwise_xor.at(bits, (owner, (mix64(h) >> np.uint64(32)).astype(np.int64) % (64 * PARITY)), 1)
                order = np.lexsort((h, counts[(h & np.uint64(BUCKETS - 1)).astype(np.int64)], owner))
                rank = np.arange(len(h)) - edge[:-1][owner]
                order = order[rank < (n - np.ceil(least * n - 1e-6).astype(np.int64) + 1)[owner]]
                rows = pa.array(owner[order])
                parity = pa.array([b.tobytes() for b in np.packbits(bits, axis=1)], pa.binary())
                columns = [pa.array(h[order].astype(np.int64)), *(batch.column(c).slice(i, j - i).take(rows) for c in ("root", "digest")), pa.array(n[owner[order]].astype(np.int32)), parity.take(rows)]
                yield pa.RecordBatch.from_arrays(columns, ["shingle", "root", "digest", "n", "parity"])
        freed()

    return run


def _across(least: float):
    """a < b: pairs of other roots that share a rare shingle and can be similar.
    Rows come sorted by shingle and root. The sets differ in at least as many
    shingles as their parities in bits."""

    def pairs(root, digest, n, parity):
        for lo in range(0, len(root), SIDE):
            x = slice(lo, lo + SIDE)
            for at in range(lo, len(root), SIDE):
                y = slice(at, at + SIDE)
                if root[x][0] == root[y][-1]:  # sorted: all of one component
                    continue
                i, j = np.nonzero(root[x][:, None] < root[y][None, :])
                i, j = i + lo, j + at
                keep = np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-6
                i, j = i[keep], j[keep]
                apart = np.bitwise_count(parity[i] ^ parity[j]).sum(axis=1, dtype=np.int64)
                both = n[i].astype(np.int64) + n[j]
                keep = both - apart >= least * (both + apart) - 1e-6
                if keep.any():
                    yield _pairs_of([digest[i[keep]]], [digest[j[keep]]])

    def run(batches):
        held, name = [], None
        for batch in batches:
            key = batch.column("shingle").to_numpy(zero_copy_only=False)
            root, digest, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("root", "digest", "n"))
            parity = text_buffers(batch.column("parity"))[0].view(np.uint64).reshape(-1, PARITY)
            cut = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key)).tolist() if len(key) else [0]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if key[i] != name:
                    if held:
                        yield from pairs(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    held, name = [], key[i]
                if held or j == len(key) or root[i] != root[j - 1]:
                    held.append((root[i:j].copy(), digest[i:j].copy(), n[i:j].copy(), parity[i:j].copy()))
        if held:
            yield from pairs(*(np.concatenate(c) for c in zip(*held, strict=True)))
        freed()

    return run


class _Classes:
    """The classes of a table of texts, and the verification of their pairs."""

    def __init__(self, docs: DataFrame, size: int, least: float):
        self.size, self.least = size, least
        self.docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t"))
        self.total = self.docs.count()
        self.bits = piece_bits(self.total)
        self.pieces = pieces_of(self.bits)
        self.words = -(-self.bits * self.pieces // 64)
        self.names = [f"s{w}" for w in range(self.words)]
        self.rows = written(self.docs.mapInArrow(_prints(size, self.words), "doc_id long, digest long, " + ", ".join(f"{s} long" for s in self.names)), "near-prints")
        kept = [F.min("doc_id").alias("sid"), F.count("*").alias("n"), *(F.min(s).alias(s) for s in self.names)]
        self.classes = written(self.rows.groupBy("digest").agg(*kept), "near-classes")
        self.tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def variants(self, classes: DataFrame) -> DataFrame:
        return classes.select("digest", *self.names).mapInArrow(_variants(self.bits, self.pieces, self.names), "key long, flip tinyint, digest long")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of different digests that are similar, written."""
        spark = pairs.sparkSession
        sides = [self.classes.select(F.col("digest").alias(k), F.col("sid").alias(f"sid_{k}"), *(F.col(s).alias(f"{k}{s}") for s in self.names)) for k in ("a", "b")]
        differ = sum((F.bit_count(F.col(f"a{s}").bitwiseXOR(F.col(f"b{s}"))) for s in self.names), F.lit(0))
        close = written(pairs.join(sides[0], "a").join(sides[1], "b").where(differ <= int(FAR * 64 * self.words)).select("a", "b", "sid_a", "sid_b"), "near-close")
        texts = self.texts(close.select(F.col("a").alias("digest"), F.col("sid_a").alias("sid")).unionAll(close.select("b", "sid_b")).distinct())
        links = self.similar(close, texts)
        dropped(close, texts)
        return links

    def texts(self, needed: DataFrame) -> DataFrame:
        """digest, t: the texts of the classes (digest, sid), written."""
        spark = needed.sparkSession
        marks = needed.mapInArrow(_slots, "at long, bit long").groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("bits")).toArrow()
        bits = np.zeros(1 << (FIELD_BITS - 6), dtype="<i8")
        bits[marks["at"].to_numpy()] = marks["bits"].to_numpy()
        field = spark.sparkContext.broadcast(bits.tobytes())
        named = needed.select(F.col("digest").alias("d"), "sid")
        found = self.docs.mapInArrow(_texts_of(self.size, field), "doc_id long, digest long, t string").join(named, F.expr("digest = d and doc_id = sid"))
        texts = written(found.groupBy("digest").agg(F.min(F.coalesce("t", F.lit(""))).alias("t")), "near-texts")
        field.destroy()
        return texts

    def similar(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar, written."""
        of = [texts.select(F.col("digest").alias(k), F.col("t").alias(f"t{k}")) for k in ("a", "b")]
        return written(pairs.select("a", "b").join(of[0], "a").join(of[1], "b").select("a", "b", "ta", "tb").mapInArrow(_similar(self.size, self.least), "a long, b long"), "near-links")

    def apart(self, pairs: DataFrame, roots: DataFrame, crowded: DataFrame) -> DataFrame:
        """The pairs (a, b) that are not of one component yet and not both of
        the crowded classes (digest), all pairs of which rest() joins."""
        of = roots.join(crowded, F.col("node") == F.col("digest"), "full").select(F.coalesce("node", "digest").alias("n"), F.coalesce("root", "digest").alias("r"), F.col("digest").isNotNull().alias("c"))
        for end in ("a", "b"):
            pairs = pairs.join(of.toDF(f"n{end}", f"r{end}", f"c{end}"), F.col(end) == F.col(f"n{end}"), "left")
        both = F.coalesce("ca", F.lit(False)) & F.coalesce("cb", F.lit(False))
        return pairs.where((F.coalesce("ra", "a") != F.coalesce("rb", "b")) & ~both).select("a", "b")

    def rest(self, crowded: DataFrame, roots: DataFrame) -> DataFrame:
        """All links between components of the crowded classes (digest): exact."""
        some = self.classes.join(crowded, "digest", "left_semi").select("digest", "sid")
        texts = self.texts(some)
        rooted = texts.join(roots, F.col("digest") == F.col("node"), "left").select("digest", F.coalesce("root", "digest").alias("root"), "t")
        met = texts.mapInArrow(_bucket_counts(self.size), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(BUCKETS, dtype="<i8")
        counts[met["bucket"].to_numpy()] = met["n"].to_numpy()
        sent = crowded.sparkSession.sparkContext.broadcast(counts.tobytes())
        rows = rooted.mapInArrow(_rarest(self.size, self.least, sent), "shingle long, root long, digest long, n int, parity binary")
        pairs = rows.repartition(self.tasks, "shingle").sortWithinPartitions("shingle", "root").mapInArrow(_across(self.least), "a long, b long")
        links = self.similar(pairs.distinct(), texts)
        sent.destroy()
        dropped(texts)
        return links

    def roots(self) -> DataFrame:
        """node, root of the components that all links make of the digests."""
        met = self.variants(self.classes).repartition(self.tasks, "key").sortWithinPartitions("key", "digest").mapInArrow(_met, "a long, b long, early boolean")
        met = written(met.groupBy("a", "b").agg(F.max("early").alias("early")), "near-met")

        def joined(links: DataFrame, roots: DataFrame) -> DataFrame:
            return written(connected_components(links.unionAll(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))), "near-roots")

        roots = written(connected_components(self.verified(met.where("a <> b and early").select("a", "b"))), "near-roots")
        crowded = met.where("a = b").select(F.col("a").alias("digest"))
        some = bool(crowded.limit(1).count())
        if some:  # most of a crowd is one component then, and its other pairs need no look
            roots = joined(self.verified(self.central(crowded, roots).join(met, ["a", "b"], "left_anti")), roots)
        late = met.where("a <> b and not early").select("a", "b")
        roots = joined(self.verified(self.apart(late, roots, crowded)), roots)
        if some:
            roots = joined(self.rest(crowded, roots), roots)
        dropped(met)
        return roots

    def central(self, crowded: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs (a, b) of the crowded classes (digest) with the centres of their groups."""
        some = self.classes.join(crowded, "digest", "left_semi").select("digest", *self.names)
        rooted = written(some.join(roots, F.col("digest") == F.col("node"), "left").select("digest", F.coalesce("root", "digest").alias("root"), *self.names), "near-crowds")
        fields = "key long, order long, digest long, root long, " + ", ".join(f"{s} long" for s in self.names)
        owned = rooted.mapInArrow(_own_pieces(self.bits, self.pieces, self.names), fields).repartition(self.tasks, "key").sortWithinPartitions("key", "order")
        chosen = owned.mapInArrow(_central(self.names), "digest long").groupBy(F.col("digest").alias("centre")).agg(F.count("*").alias("times"))
        marked = rooted.join(written(chosen, "near-centres"), F.col("digest") == F.col("centre"), "left").withColumn("other", (-F.coalesce("times", F.lit(0))).cast("int"))
        rows = marked.mapInArrow(_variants(self.bits, self.pieces, self.names, ("root", "other")), "key long, flip tinyint, digest long, root long, other int")
        more = rows.repartition(self.tasks, "key").sortWithinPartitions("key", "other", "digest").mapInArrow(_with_centres, "a long, b long")
        found = written(more.distinct(), "near-central")
        dropped(rooted)
        return found


def near_copies(docs: DataFrame, size: int = SIZE, least: float = LEAST) -> DataFrame:
    """doc_id, digest, component_id, root: one row for each input row with a
    doc_id; component_id is the least doc_id that links of a Jaccard similarity
    of at least `least` over `size`-word shingles (A-Z lower-cased) reach, and
    root names the component.

    Links are found with a probability, not surely: by calculation over 99 in
    100 at 0.8 where single words were changed and some 9 in 10 where a passage
    was added, more above that (the README has what was measured). Texts that
    meet in groups of over MOST_PAIRED are joined exactly with each other. Null
    and empty texts have an empty set and are copies of each other only. Rows
    without a doc_id take no part. Rows of one doc_id are judged each on its own
    text; repeated rows give repeated rows. A very long text is one set of
    hashes in one task. Two classes of n share a digest by chance with odds of
    n * n / 2**65. An empty table gives an empty result. Only doc_id and text
    are read.
    """
    held = _Classes(docs, size, least)
    roots = held.roots()
    rooted = held.classes.join(roots, F.col("digest") == F.col("node"), "left").select(F.col("digest").alias("d"), "sid", "n", F.coalesce("root", "digest").alias("root"))
    rooted = written(rooted, "near-rooted")
    named = rooted.groupBy(F.col("root").alias("r")).agg(F.min("sid").alias("component_id"), F.count("*").alias("m"))
    by_class = written(joined_by_key(rooted, "root", named, "r", "m", rooted.count()).select("d", "n", "root", "component_id"), "near-named")
    return joined_by_key(held.rows.select("doc_id", "digest"), "digest", by_class, "d", "n", held.total).select("doc_id", "digest", "component_id", "root")


def _with_digest(size: int, carried: int):
    def run(batches):
        for batch in batches:
            for i, j, texts in lowered(batch.column("t")):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(carried)), pa.array(digests(texts, size))], [*batch.schema.names[:carried], "digest"])
        freed()

    return run


def one_of_each(docs: DataFrame, carry: tuple[str, ...], size: int = SIZE, least: float = LEAST) -> DataFrame:
    """doc_id and the carried columns (text among them): of each component of
    near copies the row of the least doc_id (then the least digest; of rows
    that repeat both, the least by their columns), and all rows without a
    doc_id. Texts are shuffled only if doc_ids repeat or over MOST_SENT rows go.
    """
    groups = written(near_copies(docs, size, least), "near-groups")
    total = groups.count()
    best = groups.groupBy(F.col("root").alias("r")).agg(F.min(F.struct("doc_id", "digest")).alias("best"), F.count("*").alias("n"))
    judged = joined_by_key(groups, "root", written(best, "near-best"), "r", "n", total)
    gone = written(judged.where("doc_id <> best.doc_id or digest <> best.digest").select(F.col("doc_id").alias("k"), F.col("digest").alias("d")).distinct(), "near-gone")
    few = F.broadcast(gone) if gone.count() <= MOST_SENT else gone
    if not groups.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return docs.select("doc_id", *carry).join(few.select("k"), F.col("doc_id") == F.col("k"), "left_anti")
    kept = ["doc_id", *carry]
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("c0"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry, 1)), F.col("text").alias("t"))
    fields = ", ".join(f"c{i} {named.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(kept)))
    marked = named.mapInArrow(_with_digest(size, len(kept)), f"{fields}, digest long").join(few, F.expr("c0 = k and digest = d"), "left_anti")
    once = marked.groupBy("c0", "digest").agg(F.min(F.struct(*(f"c{i}" for i in range(1, len(kept))))).alias("row")).select("c0", "row.*").toDF(*kept)
    return once.unionByName(docs.where("doc_id is null").select(*kept))
