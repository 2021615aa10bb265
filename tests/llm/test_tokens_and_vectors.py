import os
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from noteloom.llm import ann_search, token_file
from noteloom.llm.packing import pack_documents, pack_histogram
from noteloom.llm.sentencepiece_sampling import Sampler, decode_pieces, encode_sampled
from noteloom.llm.tokens import Encoder
from noteloom.llm.topk_search import exact_top_k

SF = "/root/testdata/sf0.01"
BYTES, WORDS, PIECES = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = [
    None, "", " ", "a", "A b  c\n\nd", " lead", "trail ", "tab\tx", "it's we're I'LL", "caf\u00e9 \u00c9T\u00c9 \u4e2d\u6587\u5b57", "\u00a0x\u2003y", "a\u0301bc \u0130 \ufb01", "<|endoftext|> and <|startoftext|>",
    "emoji \U0001f600 \U0001f9d1\u200d\U0001f680", "12345 3.14 a1b2", "x\x1cy", "\u2581under \u2581", "word " * 3000, "q" * 9000, "$$##!! --> end",
]


def documents(spark):
    rows = [(i * 3, t) for i, t in enumerate(ODD)] + [(None, "no id"), (6, "again"), (6, "again")]
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("t"), F.lit(2).alias("start"), F.lit(3).alias("part"), F.lit(4).alias("length")).repartition(3)


def plain_ids(path, texts):
    t = Tokenizer.from_file(path)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_equal_the_library(path):
    rng = random.Random(1)
    letters = "abcXYZ019 '\n.,-\u00e9\u00df\u4e2d\u00a0\u0301!?"
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(400)]
    got = [np.frombuffer(b, "<u4").tolist() for b in Encoder(path).encode([t or "" for t in texts])]
    assert got == plain_ids(path, texts)


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_packing(spark):
    docs = documents(spark)
    rows = pack_documents(docs, BYTES).collect()
    texts = docs.select("doc_id", "text").collect()
    pool = defaultdict(list)
    for r in rows:
        pool[r.doc_id, r.doc_tokens].append(r)
    for r, ids in zip(texts, plain_ids(BYTES, [t.text for t in texts]), strict=True):
        ids = [*ids, 0]
        pieces = pool[r.doc_id, len(ids)]
        at = 0
        while at < len(ids):
            p = next(p for p in pieces if p.start == at and p.ids_crc32 == crc(ids[at : at + p.length]))
            pieces.remove(p)
            at += p.length
    assert not any(pool.values())
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for spans in by_sequence.values():
        spans.sort()
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))] and sum(n for _, n in spans) <= 1024
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert pack_documents(docs.where("false"), BYTES).count() == 0


def test_histogram_packs_tight():
    rng = random.Random(4)
    counts = {n: rng.randint(1, 500) for n in rng.sample(range(1, 1024), 400)}
    patterns = pack_histogram(counts)
    used = defaultdict(int)
    for number, lengths in patterns:
        assert sum(lengths) <= 1024
        for n in lengths:
            used[n] += number
    assert dict(used) == counts and len(patterns) <= 2048
    assert sum(n * c for n, c in counts.items()) / (1024 * sum(n for n, _ in patterns)) > 0.97


def test_token_files(spark):
    docs = documents(spark)
    files = token_file.write_token_files(docs, WORDS)
    got = token_file.read_token_files(files).orderBy("start").collect()
    texts = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    at = 0
    for r, t, ids in zip(got, texts, plain_ids(WORDS, [t.text for t in texts]), strict=True):
        ids = [*ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (t.doc_id, at, len(ids), crc(ids))
        at += len(ids)
    assert token_file.read_token_files(token_file.write_token_files(docs.where("false"), WORDS)).count() == 0


def test_range_coder():
    rng = np.random.default_rng(0)
    ids = np.minimum(rng.zipf(1.3, 30_000), 49_407).astype("<u4")
    lengths = [10_000, 0, 20_000]
    data = token_file.encode_segment(lengths, ids.tobytes())
    got, raw = token_file.decode_segment(data)
    assert got.tolist() == lengths and raw == ids.tobytes() and len(data) < 2 * len(ids)
    for same in ([7] * 5000, [], [0], list(range(4100))):
        raw = np.array(same, dtype="<u4").tobytes()
        assert token_file.decode_segment(token_file.encode_segment([len(same)], raw))[1] == raw
    damaged = bytearray(data)
    damaged[-40] ^= 1
    with pytest.raises(ValueError):
        token_file.decode_segment(bytes(damaged))


def test_pieces(spark):
    docs = documents(spark)
    encoded = encode_sampled(docs, PIECES).persist()
    back = decode_pieces(encoded, PIECES)
    want = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == want
    again = encode_sampled(docs.repartition(1), PIECES)
    assert sorted(map(str, encoded.collect())) == sorted(map(str, again.collect()))
    other = encode_sampled(docs, PIECES, seed=8)
    assert sorted(map(str, encoded.collect())) != sorted(map(str, other.collect()))


def test_pieces_follow_their_odds():
    s = Sampler(PIECES)
    text = "hello"
    weight = defaultdict(float)

    def walk(at, w, path):
        if at == len(text) + 1:
            weight[tuple(path)] += w
        for k in range(at + 1, len(text) + 2):
            hit = s.pieces.get((" " + text)[at:k])
            if hit:
                walk(k, w * hit[1], [*path, hit[0]])

    walk(0, 1.0, [])
    n = 20_000
    seen = defaultdict(int)
    for ids in s.sample([text] * n, np.arange(n)):
        seen[tuple(ids.tolist())] += 1
    total = sum(weight.values())
    best = max(weight, key=weight.get)
    assert set(seen) <= set(weight) and abs(seen[best] / n - weight[best] / total) < 0.02


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", F.lit(1).alias("v"), F.lit(2).alias("label"), F.lit(3).alias("score"), F.lit(4).alias("node")).repartition(4)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    x[50:60] = x[50]
    x[100] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (500, [1.0, None] * 4), (600, [float("nan")] * 8), (None, [1.0] * 8), (700, [1.0, 2.0]), (800, [])]
    df = vectors(spark, rows)
    got = defaultdict(list)
    for r in exact_top_k(df, df.where("vec_id % 50 = 0"), 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    e = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    for q in range(0, 300, 50):
        want = sorted(((int(-(e[q] @ e[c])), c) for c in range(300) if c != q))[:10]
        assert got[q] == [(c, -s) for s, c in want]
    assert not set(got) - set(range(0, 300, 50))
    assert exact_top_k(df.where("false"), df.where("false")).count() == 0
    assert exact_top_k(df.where("vec_id < 3"), df.where("vec_id = 1")).count() == 2


def test_bounds_spare_most_products_of_clusters():
    """Of clustered vectors under 30 in 100 get exact products, and the result
    is that of all products."""
    from noteloom.llm import topk_search as t

    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 64)) * np.repeat(rng.standard_normal((60, 16)), 4, axis=1)
    x = np.floor(1024 * (centres[rng.integers(0, 60, 12_000)] + 0.1 * rng.standard_normal((12_000, 64))))
    ids = np.arange(len(x))
    names, q = ids[::50], x[::50]
    seed = t._products(q, x[:4096])
    seed[names[:, None] == ids[None, :4096]] = np.iinfo(np.int64).min
    groups = t.grouped(names, q, 10, np.sort(seed, axis=1)[:, -10].astype(float))
    t.pass_by(groups, ids, x)
    assert sum(g.computed * len(g.names) for g in groups) < 0.3 * len(x) * len(q)
    for g in groups:
        query, score, found = g.best.rows
        for k, name in enumerate(g.names.tolist()):
            s = t._products(x[[name]], x)[0]
            want = sorted((-int(v), int(i)) for i, v in enumerate(s) if i != name)[:10]
            assert [(-int(a), int(b)) for a, b in zip(score[query == k], found[query == k], strict=True)] == want


@pytest.mark.parametrize("bytes_", [32 << 20, 200])
def test_top_k_in_blocks_and_overflow(spark, monkeypatch, bytes_):
    from noteloom.llm import topk_search as t

    monkeypatch.setattr(t, "QUERY_BYTES", bytes_)
    df = vectors(spark, [(i, [float(i % 7), float(i % 5)]) for i in range(40)])
    got = exact_top_k(df, df.where("vec_id % 10 = 0"), 3).orderBy("query_id", "rank").collect()
    e = [(1024 * (i % 7), 1024 * (i % 5)) for i in range(40)]
    for q in (0, 10, 20, 30):
        want = sorted((-(e[q][0] * e[c][0] + e[q][1] * e[c][1]), c) for c in range(40) if c != q)[:3]
        assert [(-r.score, r.vec_id) for r in got if r.query_id == q] == want
    far = vectors(spark, [(0, [3e37, 1.0]), (1, [3e37, 1.0])])
    with pytest.raises(Exception, match="fit a long"):
        exact_top_k(far, far).collect()


def test_top_k_with_a_repeated_id(spark):
    x = np.random.default_rng(6).integers(-9, 9, (60, 4)).astype(np.float32)
    rows = [(0, [50.0] * 4)] * 3 + [(i, v.tolist()) for i, v in enumerate(x) if i]
    df = vectors(spark, rows).coalesce(1)
    got = [(r.vec_id, r.score) for r in exact_top_k(df, df.where("vec_id = 0"), 10).orderBy("rank").collect()]
    want = sorted((-int(1024 * 1024 * 50 * v.sum()), i) for i, v in enumerate(x) if i)[:10]
    assert got == [(i, -s) for s, i in want]


def recall_of(spark, df, x, ids, every, k=20):
    got = defaultdict(list)
    for r in ann_search.nearest(df, F.expr(f"vec_id % {every} = 0"), k).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    found = total = 0
    place = {v: i for i, v in enumerate(ids)}
    for q in (v for v in ids if v % every == 0):
        s = x.astype(np.float64) @ x[place[q]].astype(np.float64)
        want = sorted((-s[i], v) for i, v in enumerate(ids) if v != q)[:k]
        rows = sorted(got[q])
        assert [r for r, _, _ in rows] == list(range(1, len(want) + 1))
        assert all(abs(score - s[place[v]]) < 1e-9 and v != q for _, v, score in rows)
        assert [(-sc, v) for _, v, sc in rows] == sorted((-sc, v) for _, v, sc in rows)
        found += len({v for _, v, _ in rows} & {v for _, v in want})
        total += len(want)
    return found / total


def test_sampled_units_are_filtered_in_parts():
    """Units are filtered few at a time, each new one once, whatever the part:
    the draws are those of one text at a time."""
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(3000)) + " \u4e2d\u6587 \u2581" for _ in range(4)]
    s, sizes = Sampler(PIECES), []
    plain = s._together
    s._together = lambda units: sizes.append(len(units)) or plain(units)
    got = s.sample(texts, np.arange(4))
    assert 8000 < sum(sizes) < 12_000 and max(sizes) <= 8192
    for k, t in enumerate(texts):
        assert s.sample([t], np.array([k]))[0].tolist() == got[k].tolist()
        assert s.decode(got[k].tolist()) == t
    assert [g.tolist() for g in s.sample(["", ""], np.arange(2))] == [[], []] and s.sample([], np.arange(0)) == []


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 16))
    x = np.concatenate([centres[rng.integers(0, 30, 1500)] + 0.4 * rng.standard_normal((1500, 16)), np.tile(centres[:1], (60, 1))]).astype(np.float32)
    ids = list(range(len(x)))
    odd = [(5000, None), (5020, [0.0] * 16), (5040, [float("inf")] * 16), (None, [1.0] * 16)]
    df = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)] + odd)
    assert recall_of(spark, df, x, ids, 100) >= 0.9
    assert ann_search.nearest(df.where("false"), F.expr("true")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_nearest_neighbours_of_the_tables(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in rows], dtype=np.float32)
    assert recall_of(spark, vectors(spark, [(r.vec_id, r.embedding) for r in rows]), x, [r.vec_id for r in rows], 20) >= 0.9


def test_nearest_neighbours_without_clusters(spark):
    x = np.random.default_rng(4).standard_normal((4000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    assert recall_of(spark, df, x, list(range(4000)), 50) >= 0.9


def test_nearest_neighbours_of_lone_vectors_and_far_clusters(spark):
    """A vector opposite to all others, and clusters of 5 in directions of
    their own, still get all the neighbours that are owed."""
    rng = np.random.default_rng(8)
    cluster = np.array([10.0] + [0.0] * 15) + 0.1 * rng.standard_normal((1499, 16))
    far = np.concatenate([3 * np.eye(16)[1 + i] + 0.01 * rng.standard_normal((5, 16)) for i in range(10)])
    x = np.concatenate([-cluster[:1], cluster, far]).astype(np.float32)
    df = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    assert recall_of(spark, df, x, list(range(len(x))), 10) >= 0.9


def test_nearest_neighbours_with_hubs(spark):
    """A few long vectors are neighbours of all."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((2500, 16)).astype(np.float32)
    x[:10] *= 40
    x[10:20] *= 1e-6
    df = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    assert recall_of(spark, df, x, list(range(len(x))), 25) >= 0.9


def test_nearest_neighbours_by_cells_and_blocks(spark, monkeypatch):
    """Over PLAIN vectors there are cells, and queries come in blocks: the
    measured recall holds, and a task keeps no more than is owed."""
    monkeypatch.setattr(ann_search, "QUERY_BYTES", 1 << 14)
    x = np.random.default_rng(10).standard_normal((5000, 16)).astype(np.float32)
    x[:20] *= 30
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert recall_of(spark, vectors(spark, rows), x, list(range(len(x))), 20) >= 0.9
    cells = ann_search._Cells(np.arange(1), np.zeros((1, 16), np.float32), np.array([5000]), np.ones(1))
    held = ann_search._Queries(np.arange(50), x[50:100], np.full(50, 21), np.full(50, -np.inf, np.float32), np.full(50, -np.inf), cells)
    monkeypatch.setattr(ann_search, "_KEPT", 1000)
    for at in range(0, 5000, 500):
        held.batch(np.zeros(500, np.int64), pa.array([[i] for i in range(at, at + 500)]), x[at : at + 500])
        assert held.n + held.added <= 2 * 50 * 21 + 1000
    held.settle()
    order = np.argsort(-(x[50:100].astype(float) @ x.T.astype(float)), axis=1, kind="stable")[:, :21]
    assert held.rows[1].tolist() == order.ravel().tolist()


def test_nearest_neighbours_of_few_and_of_other_lengths(spark):
    rows = [(0, [1.0, 2.0]), (20, [2.0, 1.0]), (1, [1.0, 1.0]), (40, [1.0, 2.0, 3.0]), (41, [3.0, 1.0, 0.0]), (60, [1e200, 1.0, 1.0, 1.0]), (61, [1e200, 1.0, 1.0, 2.0]), (80, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann_search.nearest(df, F.expr("vec_id % 20 = 0")).collect()}
    assert got == {(0, 1): (20, 4.0), (0, 2): (1, 3.0), (20, 1): (0, 4.0), (20, 2): (1, 3.0), (40, 1): (41, 5.0), (60, 1): (61, float("inf"))}


def test_mixing_adds_probabilities():
    """Text-like ids take fewer bits than their order 0 entropy; predictions
    that agree, differ, or are missing are coded back exactly."""
    rng = np.random.default_rng(3)
    follow = rng.integers(0, 900, (900, 3))
    ids = [1, 2]
    for u, v in zip(rng.random(40_000), rng.zipf(1.5, 40_000) % 900, strict=True):
        ids.append(int(follow[ids[-1], 0] if u < 0.5 else follow[ids[-2], 1] if u < 0.7 else v))
    ids = np.array(ids, dtype="<u4")
    share = np.bincount(ids)[np.bincount(ids) > 0] / len(ids)
    data = token_file.encode_segment([len(ids)], ids.tobytes())
    assert token_file.decode_segment(data)[1] == ids.tobytes()
    assert 8 * len(data) < 0.95 * len(ids) * -(share * np.log2(share)).sum()
    edges = np.array([0, 65_535, 0, 65_535, 65_535, 1] * 700, dtype="<u4")
    assert token_file.decode_segment(token_file.encode_segment([len(edges)], edges.tobytes()))[1] == edges.tobytes()
    with pytest.raises(ValueError):
        token_file.encode_segment([1], np.array([65_536], dtype="<u4").tobytes())


def test_a_text_longer_than_a_slice(spark):
    rng = random.Random(3)
    long = " ".join(rng.choices(["alpha", "beta", "gamma,", "delta.", "\u00e9psilon"], k=300_000))
    assert len(long) > 1 << 20
    docs = spark.createDataFrame([(1, long), (2, long + " more"), (3, "short")], "doc_id long, text string")
    ids = plain_ids(WORDS, [long, long + " more", "short"])
    got = token_file.read_token_files(token_file.write_token_files(docs, WORDS)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.ids_crc32) for r in got] == [(len(i) + 1, crc([*i, 2])) for i in ids]
    ids = plain_ids(BYTES, [long])[0]
    pieces = sorted((r.start, r.length, r.ids_crc32) for r in pack_documents(docs, BYTES).where("doc_id = 1").collect())
    assert pieces == [(a, min(1024, len(ids) + 1 - a), crc([*ids, 0][a : a + 1024])) for a in range(0, len(ids) + 1, 1024)]
