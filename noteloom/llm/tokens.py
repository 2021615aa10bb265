"""Token ids of whole texts, equal to those of the tokenizers library.

No pre-token of these vocabularies spans a joint between two words, so ids are
looked up word by word: words are found and hashed (64 bits) as arrays, their
ids lie in a hash table of arrays, and only words that a worker has not met are
made strings and encoded, many at a time. Texts with unusual white space, and
words with special tokens or uncommon letters, go to the library itself.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import regex
import tiktoken

from noteloom.llm.common import LOWER, Texts, freed, mix64, slices

#: Words whose ids a worker keeps at most; beyond that it starts anew.
MOST_KEPT = 500_000
#: Texts that are encoded together.
ROWS = 512

_GPT_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
_WIDE = ("\x85", "\xa0", " ", *map(chr, range(0x2000, 0x200B)), " ", " ", " ", " ", "　")


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for a byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


_ALPHA = np.zeros(256, dtype=bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
_CONTROL = np.zeros(256, dtype=bool)
_CONTROL[28:32] = True


def _strange(data: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Bytes that a word of the regular kind has not: those that may begin a
    special token, separators that are no white space to Spark, characters from
    U+0250 on, U+0130, which lower-cases to two, and wide spaces below that."""
    after = np.append(data[1:], 0) if len(data) else data
    out = marks[data] | _CONTROL[data] | (data > 0xC9) | (data == 0xC9) & (after >= 0x90) | (data == 0xC4) & (after == 0xB0)
    return out | (data == 0xC2) & ((after == 0x85) | (after == 0xA0))


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, mark: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of spans, each with a mark behind it, and their sizes with it."""
    sizes = ends - starts + 1
    ahead = np.cumsum(sizes) - sizes
    at = np.minimum(np.repeat(starts - ahead, sizes) + np.arange(int(sizes.sum())), len(data) - 1)
    out = data[at]
    out[ahead + sizes - 1] = mark
    return out, sizes


class _Words:
    """Ids by 64-bit hash, by open addressing. A length of -1 marks words whose
    text must be encoded as a whole."""

    BITS = 20

    def __init__(self) -> None:
        self.hashes = np.zeros(1 << self.BITS, dtype=np.uint64)
        self.start = np.zeros(1 << self.BITS, dtype=np.int32)
        self.length = np.zeros(1 << self.BITS, dtype=np.int32)
        self.pool = np.zeros(1 << 16, dtype="<u4")
        self.n = self.used = 0

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each hash, and whether it is there."""
        slot = (hashes >> np.uint64(64 - self.BITS)).astype(np.int64)
        held = self.hashes[slot]
        hit = held == hashes
        live = np.flatnonzero(~hit & (held != 0))
        while len(live):
            slot[live] = (slot[live] + 1) & ((1 << self.BITS) - 1)
            held = self.hashes[slot[live]]
            hit[live] = held == hashes[live]
            live = live[~hit[live] & (held != 0)]
        return slot, hit

    def add(self, hashes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Different hashes that are not there, and their ids one after another."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(2 * (self.used + len(ids)), dtype="<u4")])
        self.pool[self.used : self.used + len(ids)] = ids
        size = np.maximum(lengths, 0)
        start = self.used + np.cumsum(size) - size
        self.used, self.n = self.used + len(ids), self.n + len(hashes)
        slot, live = (hashes >> np.uint64(64 - self.BITS)).astype(np.int64), np.arange(len(hashes))
        while len(live):
            free = live[self.hashes[slot[live]] == 0]
            self.hashes[slot[free]] = hashes[free]
            done = live[self.hashes[slot[live]] == hashes[live]]
            self.start[slot[done]], self.length[slot[done]] = start[done], lengths[done]
            live = live[self.hashes[slot[live]] != hashes[live]]
            slot[live] = (slot[live] + 1) & ((1 << self.BITS) - 1)


class Encoder:
    """encode(texts) -> for each text its ids as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = spec["model"].get("end_of_word_suffix") == "</w>"
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.marks = np.zeros(256, dtype=bool)
        self.marks[[t.encode()[0] for t in self.special if t]] = True
        letters, suffix = _byte_letters(), "</w>"
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            ends = self.by_word and token.endswith(suffix) and len(token) > len(suffix)
            ranks[bytes(letters[c] for c in (token[: -len(suffix)] if ends else token)) + b" " * ends] = i
        self.core = tiktoken.Encoding("own", pat_str="[^ \\n]+ " if self.by_word else _GPT_SPLIT, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.width = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.ends = np.zeros(len(self.width), dtype=bool)
        for token, i in ranks.items():
            self.width[i] = len(token)
            self.ends[i] = token.endswith(b" ")
        self.words = _Words()
        self.newline = None if self.by_word else self._slow("\n")

    def _slow(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _one_by_one(self, run: Texts, units: np.ndarray, kinds: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """Ids and lengths of units that the library must see, in order."""
        raw, got = run.data, []
        for k, (a, b) in enumerate(zip(run.starts[units].tolist(), run.ends[units].tolist(), strict=True)):
            w = raw[a:b].tobytes().decode("utf-8", "surrogateescape")
            if kinds is None:
                got.append(self._slow(w))
            elif any(c in w for c in _ODD) or any(c in w for c in _WIDE):
                got.append(None)
            else:
                kind = int(kinds[units[k]])
                got.append(self._slow(" " + w) if kind == 0 else self._slow(w) if kind == 1 else np.concatenate([self.newline, self._slow(w)]))
        lengths = np.array([-1 if g is None else len(g) for g in got], dtype=np.int64)
        return np.concatenate([g for g in got if g is not None] or [np.empty(0, "<u4")]), lengths

    def _together(self, run: Texts, units: np.ndarray, kinds: np.ndarray | None) -> list[tuple[np.ndarray, ...]]:
        """(units, ids, lengths) of units of the regular kind, each kind of them
        encoded in one string."""
        out = []
        if kinds is None:
            if not len(units):
                return out
            data, sizes = _joined(run.data, run.starts[units], run.ends[units], ord("a"))
            word = np.logical_and.reduceat(_ALPHA[data], np.cumsum(sizes) - sizes)
            for own, split in ((units[word], False), (units[~word], True)):
                if not len(own):
                    continue
                data, _ = _joined(run.data, run.starts[own], run.ends[own], 10 if split else 32)
                text, counts = LOWER[data].tobytes().decode(), np.ones(len(own), np.int64)
                if split:
                    text = _WORD_SPLIT.sub(r"\g<0> ", unicodedata.normalize("NFC", text).lower())
                    marks = np.frombuffer(text.encode(), np.uint8)
                    spaces = np.cumsum(marks == 32)[marks == 10]
                    counts = np.diff(spaces, prepend=0)
                ids = np.array(self.core.encode_ordinary(text), dtype="<u4")
                stop = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
                out.append((own, ids, np.diff(stop[np.concatenate([[0], np.cumsum(counts)])])))
            return out
        for own, mark, skip in ((units[kinds[units] == 0], 32, 0), (units[kinds[units] == 1], 10, 1), (units[kinds[units] == 2], 10, 0)):
            if not len(own):
                continue
            data, sizes = _joined(run.data, run.starts[own], run.ends[own], mark)
            ids = np.array(self.core.encode_ordinary(chr(mark) + data[:-1].tobytes().decode()), dtype="<u4")
            cut = np.concatenate([[0], np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(sizes)) + 1])
            if skip:  # the line break before each, which is an id of its own
                ids = np.delete(ids, cut[:-1])
                cut = cut - np.arange(len(cut))
            out.append((own, ids, np.diff(cut)))
        return out

    def _learn(self, run: Texts, hashes: np.ndarray, kinds: np.ndarray | None) -> np.ndarray:
        """The slots of all units of a run, once those not met are added."""
        slot, hit = self.words.find(hashes)
        new = np.flatnonzero(~hit)
        if not len(new):
            return slot
        if self.words.n > MOST_KEPT:
            self.words = _Words()
            new = np.arange(len(hashes))
        order = np.argsort(hashes[new])
        new = new[order]
        first = np.ones(len(new), dtype=bool)
        first[1:] = hashes[new[1:]] != hashes[new[:-1]]
        new = new[first]
        data, sizes = _joined(run.data, run.starts[new], run.ends[new], 32)
        at = np.cumsum(sizes) - sizes
        regular = ~np.logical_or.reduceat(_strange(data, self.marks), at)
        for own, ids, lengths in self._together(run, new[regular], kinds):
            self.words.add(hashes[own], ids, lengths)
        others = new[~regular]
        self.words.add(hashes[others], *self._one_by_one(run, others, kinds))
        return self.words.find(hashes)[0]

    def _run(self, run: Texts, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a run of texts, and where each text's begin."""
        n, count = len(run.first) - 1, np.diff(run.first)
        whole = np.zeros(n, dtype=bool)
        hashes, kinds = run.hashes, None
        if not self.by_word:
            # one space or line break between words, none at the ends
            some = count > 0
            heads, tails = run.first[:-1][some], run.first[1:][some] - 1
            before = np.where(run.starts > 0, run.data[np.maximum(run.starts - 1, 0)], 0)
            gap = np.empty(len(hashes), dtype=np.int64)
            gap[1:] = run.starts[1:] - run.ends[:-1]
            gap[heads] = run.starts[heads] - run.offsets[:-1][some] + 1
            kinds = np.where(before == 10, 2, 0)
            kinds[heads] = 1
            odd = np.flatnonzero((gap != 1) | (kinds == 0) & (before != 32))
            whole[np.searchsorted(run.first, odd, "right") - 1] = True
            whole[some] |= run.ends[tails] != run.offsets[1:][some]
            whole[~some] |= np.diff(run.offsets)[~some] > 0
            hashes = mix64(hashes ^ kinds.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        hashes = np.where(hashes == 0, np.uint64(1), hashes)
        slot = self._learn(run, hashes, kinds)
        length, start = self.words.length.take(slot).astype(np.int64), self.words.start.take(slot).astype(np.int64)
        if not self.by_word:
            whole[np.searchsorted(run.first, np.flatnonzero(length < 0), "right") - 1] = True
            length[np.repeat(whole, count)] = 0
        ahead = np.concatenate([[0], np.cumsum(length)])
        ids = self.words.pool.take(np.repeat(start - ahead[:-1], length) + np.arange(ahead[-1]))
        edge = ahead[run.first]
        if not whole.any():
            return ids, edge
        # texts that the library must see take their place between the others
        slow = [self._slow(column[i].as_py() or "") if w else None for i, w in enumerate(whole.tolist())]
        parts = [ids[a:b] if x is None else x for x, a, b in zip(slow, edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def forget(self) -> None:
        """Free what was learnt: a worker lives on after its task, next to the
        tasks of other stages."""
        self.words = _Words()
        freed()

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        out: list[bytes] = []
        for i, j, run in slices(column, 1 << 19):
            ids, edge = self._run(run, column.slice(i, j - i))
            raw, cut = ids.tobytes(), (4 * edge).tolist()
            out += [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file; it keeps one at a time."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def text_runs(texts: list[str | None], most: int = 2_000_000):
    """(from, to) of runs of about `most` characters."""
    i = 0
    while i < len(texts):
        j, held = i, 0
        while j < len(texts) and (j == i or held + len(texts[j] or "") <= most):
            held += len(texts[j] or "")
            j += 1
        yield i, j
        i = j
