import hashlib
import random
import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from noteloom.llm import common, near_copies, simhash
from noteloom.llm.automaton import SuffixAutomaton, remove_reference_passages
from noteloom.llm.components import connected_components
from noteloom.llm.substring_dedup import remove_repeated_passages

SPACE = re.compile("[\x20\x09-\x0d]+")


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"W{i}" for i in range(60)]
    shared = [" ".join(rng.choices(vocabulary, k=40)) for _ in range(3)]
    out = [(None, shared[0]), (900, None), (901, ""), (902, " \t\n "), (903, "one"), (904, "b a " * 6000), (905, "b a " * 30), (7, shared[1]), (7, shared[1])]
    for i in range(120):
        own = " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))
        out.append((i * 3, rng.choice([own, own + "\n" + rng.choice(shared) + "\u00a0x", shared[2], own.replace(" ", "  ")])))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    clashing = ["t", "k", "c0", "gone", "h1", "first", "anchor", "fp", "root", "least", "component_id", "kept_text"]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return df.select("doc_id", "text", *(F.lit(1).alias(c) for c in clashing)).persist()


def brute_cut(rows, window=13):
    first = {}
    for doc, text in rows:
        w = words_of(text)
        for i in range(len(w) - window + 1):
            if doc is not None:
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = words_of(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[i : i + window])] < doc:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot_share", [2000, 10**9])
def test_substring_dedup_equals_brute_force(docs, rows, monkeypatch, hot_share):
    from noteloom.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "HOT_SHARE", hot_share)
    got = remove_repeated_passages(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert sorted(map(tuple, got.collect()), key=str) == brute_cut(rows)


def test_substring_dedup_of_hot_windows(spark):
    rows = [(i, "x y z " * 5 + f"own{i} " + "p q r s t u v " * 2) for i in range(1500)]
    got = remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert sorted(map(tuple, got.collect()), key=str) == brute_cut(rows)


def test_substring_dedup_of_nothing(spark):
    assert remove_repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_automaton(spark):
    rng = random.Random(2)
    words = [rng.randint(0, 3) for _ in range(200)]
    automaton = SuffixAutomaton()
    automaton.add(words[:100])
    automaton.add(words[50:])
    factors = {tuple(s[i:j]) for s in (words[:100], words[50:]) for i in range(len(s)) for j in range(i, len(s) + 1)}
    asked = [rng.randint(0, 4) for _ in range(60)]
    for i, n in enumerate(automaton.statistics(asked)):
        assert n == max(k for k in range(i + 2) if tuple(asked[i + 1 - k : i + 1]) in factors)
    reference = spark.createDataFrame([("a b c d e",), (None,)], "text string")
    df = spark.createDataFrame([(1, "x a b c d y"), (2, "a b"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in remove_reference_passages(df, reference, 4).collect()}
    assert got == {1: (6, 4, "x y"), 2: (2, 0, "a b"), 3: (0, 0, "")}


def brute_print(text, size=4):
    w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    """Least doc_id that each fingerprint reaches, over (doc_id, fingerprint)."""
    prints = sorted({p for _, p in pairs})
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for doc, p in pairs:
        if doc is not None:
            least[find(p)].append(doc)
    return {p: min(least[find(p)], default=None) for p in prints}


def test_simhash_equals_brute_force(docs, rows):
    pairs = [(doc, brute_print(text)) for doc, text in rows]
    names = brute_components(pairs)
    want = sorted(((doc, f"{p:016x}", names[p]) for doc, p in pairs), key=str)
    assert sorted(map(tuple, simhash.near_duplicate_groups(docs).collect()), key=str) == want


@pytest.mark.parametrize("most", [64, 3])
def test_links_connect_as_all_pairs_do(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST_PAIRED", most)
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    prints = set(seeds)
    for s in seeds:
        for _ in range(25):
            x = s
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
            prints.add(x)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    distinct = spark.createDataFrame(signed, "fp long")
    roots = {r.node: r.root for r in connected_components(simhash.links(distinct)).collect()}
    got = defaultdict(set)
    for (p,) in signed:
        got[roots.get(p, p)].add(p % (1 << 64))
    names = brute_components([(i, p) for i, p in enumerate(sorted(prints))])
    want = defaultdict(set)
    for p, n in names.items():
        want[n].add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_simhash_of_nothing(spark):
    assert simhash.near_duplicate_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert {n: r for n, r in got.items() if n != r} == {i: 0 for i in range(1, 41)} | {101: 100}


@pytest.mark.parametrize("hot", [(1000, 100), (3, 2)])
def test_components_with_hot_nodes(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_SHARE", hot[0])
    monkeypatch.setattr(common, "LEAST_HOT", hot[1])
    edges = [(0, i) for i in range(1, 60)] + [(500, i) for i in range(501, 560)] + [(i, 1000 + i) for i in range(0, 560, 7)] + [(None, 3), (3, None)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    adjacent = defaultdict(set)
    for a, b in edges[:-2]:
        adjacent[a].add(b)
        adjacent[b].add(a)
    want = {}
    for n in sorted(adjacent):
        if n not in want:
            held = [n]
            while held:
                x = held.pop()
                if x not in want:
                    want[x] = n
                    held += adjacent[x]
    assert got == {n: r for n, r in want.items() if n != r}


def shingles(text, size=5):
    w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def similar_components(pairs, least=0.8):
    """Least doc_id that each set reaches, over (doc_id, set)."""
    sets = list({s for _, s in pairs})
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= least * len(a | sets[j]):
                root[find(i)] = find(j)
    names = defaultdict(list)
    number = {s: i for i, s in enumerate(sets)}
    for doc, s in pairs:
        names[find(number[s])].append(doc)
    return [(doc, min(names[find(number[s])])) for doc, s in pairs]


def edited(rng, words, k):
    words = list(words)
    for i in rng.sample(range(len(words)), k):
        words[i] = f"new{rng.random()}"
    return words


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows = [(9000, None), (9001, ""), (9002, " \t"), (9003, "one"), (9004, "ONE"), (9005, "two three"), (9006, "same id"), (9006, "of another text"), (9006, "of another text"), (9007, "b a " * 300_000), (9008, "b a " * 30)]
    doc = 0
    for _ in range(40):
        own = rng.choices(vocabulary, k=rng.randint(100, 400))
        for k in (0, 1, 2, 3, 30):
            doc += 1
            rows.append((doc, " ".join(edited(rng, own, k)).upper() if k == 2 else "  ".join(edited(rng, own, k))))
        rows.append((doc + 5000, " ".join(own + rng.choices(vocabulary, k=len(own) // 8))))
    return rows


@pytest.mark.parametrize("most", [64, 3])
def test_near_copies_equal_brute_force(spark, copies, monkeypatch, most):
    monkeypatch.setattr(near_copies, "MOST_PAIRED", most)
    # as workers import the module anew, what they use is passed in a closure
    met, central = near_copies._met, near_copies._central

    def few(batches):
        near_copies.MOST_PAIRED = most
        yield from met(batches)

    def centred(names):
        run = central(names)

        def few_centres(batches):
            near_copies.MOST_PAIRED, near_copies.BLOCK = most, 5
            yield from run(batches)

        return few_centres

    if most == 3:
        monkeypatch.setattr(near_copies, "_met", few)
        monkeypatch.setattr(near_copies, "_central", centred)
    df = spark.createDataFrame([*copies, (None, "no id")], "doc_id long, text string").select("*", *(F.lit(1).alias(c) for c in ("digest", "s0", "sid", "root", "component_id", "n", "k", "t"))).repartition(4)
    got = sorted((r.doc_id, r.component_id) for r in near_copies.near_copies(df).collect())
    assert got == sorted(similar_components([(d, shingles(t)) for d, t in copies]))


def test_many_copies_of_one_text(spark):
    """Copies with changes of their own are similar to the text, not always to
    each other: all are one component, without all their pairs."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(0, " ".join(base))] + [(i, " ".join(edited(rng, base, 6))) for i in range(1, 301)] + [(5000 + i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(300))) for i in range(50)]
    sets = {d: shingles(t) for d, t in rows}
    apart = sum(len(sets[i] & sets[i + 1]) < 0.8 * len(sets[i] | sets[i + 1]) for i in range(1, 300))
    assert apart > 250
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(similar_components([(d, shingles(t)) for d, t in rows]))
    assert sum(c == 0 for c in got.values()) == 301


def test_links_within_a_crowd_without_a_centre(spark):
    """Copies of a text that is not there are not similar to each other, but
    some have a copy of their own among them: no such link is lost."""
    rng = random.Random(13)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(i, edited(rng, base, 7)) for i in range(500)]
    rows += [(1000 + i, edited(rng, rows[i][1], 4)) for i in range(150)]
    rows = [(i, " ".join(w)) for i, w in rows]
    want = dict(similar_components([(d, shingles(t)) for d, t in rows]))
    assert sum(d != c for d, c in want.items()) >= 140
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_one_row_of_each_group_stays(spark, copies):
    rows = [(d, t, "x") for d, t in copies]
    df = spark.createDataFrame([*rows, (None, None, "y"), (None, "no id", None)], "doc_id long, text string, lang string").repartition(4)
    named = similar_components([(d, shingles(t)) for d, t in copies])
    want = {}
    for (d, t), (_, name) in zip(copies, named, strict=True):
        key = (name, d != name)
        if not key[1] and d != 9006:
            want[d] = t
    got = near_copies.one_of_each(df, ("text", "lang")).collect()
    assert {r.doc_id: r.text for r in got if r.doc_id not in (None, 9006)} == want
    # one id with two unrelated texts: both stay, one of the repeated row
    assert sorted(r.text for r in got if r.doc_id == 9006) == ["of another text", "same id"]
    assert sum(r.doc_id is None for r in got) == 2
    assert near_copies.one_of_each(df.where("false"), ("text", "lang")).count() == 0
    plain = spark.createDataFrame([(1, "a b c", "x"), (2, "A  b c", "y"), (3, None, None)], "doc_id long, text string, lang string")
    assert sorted(map(tuple, near_copies.one_of_each(plain, ("text", "lang")).collect())) == [(1, "a b c", "x"), (3, None, None)]


def test_votes():
    import numpy as np

    h = np.random.default_rng(1).integers(0, 1 << 63, 2000).astype(np.uint64)
    edge = np.array([0, 1, 700, 1999, 2000])
    got = near_copies.votes(h, edge)
    for i in range(4):
        assert got[i].tolist() == [int(((h[edge[i] : edge[i + 1]] >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)]
