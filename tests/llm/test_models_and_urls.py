import os

import pytest
from pyspark.sql import functions as F

import oracle
from noteloom.llm import queries
from noteloom.llm.quality import ACCEPT, estimate, score_quality
from noteloom.llm.toxicity import THRESHOLD, held_out, score_toxicity
from noteloom.llm.url_filter import judge_urls, match_rules, split_url

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    oracle.assert_same(queries.QUERIES[name](spark, SF), queries.ORACLES[name], oracle.connect(SF))


def rates(rows):
    """(recall of label 1, share of label 0 called 1)"""
    hit = [p for label, p in rows if label == 1]
    clean = [p for label, p in rows if label == 0]
    return sum(hit) / max(1, len(hit)), sum(clean) / max(1, len(clean))


@tables
def test_toxicity_on_held_out_labels(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    scored = score_toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where(held_out(F.col("doc_id")))
    recall, false = rates([(r.toxic, r.score >= THRESHOLD) for r in scored.collect()])
    assert recall >= 0.6 and false <= 0.02


@tables
def test_quality_on_labels_it_never_saw(spark):
    labels = read(spark, "labels").select("doc_id", "quality")
    rows = score_quality(read(spark, "documents")).join(labels, "doc_id").collect()
    good, bad = rates([(r.quality, r.score >= ACCEPT) for r in rows])
    assert good >= 0.97 and bad <= 0.5


def odd_docs(spark):
    rows = [(1, None), (2, ""), (3, "a"), (None, "words of no id"), (4, "long words " * 5000), (5, "same"), (5, "same")]
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("x").alias("label"), F.lit("y").alias("score"), F.lit(1).alias("d"), F.lit(2).alias("pattern"), F.lit(3).alias("k"))


@pytest.mark.parametrize("which", ["quality", "toxicity"])
def test_scores_of_odd_rows(spark, which):
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    docs = odd_docs(spark)
    got = (score_quality(docs) if which == "quality" else score_toxicity(docs, labels)).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    none = docs.where("false")
    assert (score_quality(none) if which == "quality" else score_toxicity(none, labels.where("false"))).count() == 0


def test_em_trusts_labellers_that_agree():
    posterior = estimate({0: 9000, 0b11: 700, 0b01: 20, 0b10: 30, 0b100: 15})
    assert posterior[0] < 0.1 and posterior[0b11] > 0.95


def test_em_equals_one_over_documents():
    """Over pattern counts as over each document, in plain Python."""
    import math

    from noteloom.llm.quality import LABELLERS, MOST_FALSE

    patterns = {0: 300, 0b11: 40, 0b1: 6, 0b10: 9, 0b1000: 4, 0b1011: 12}
    docs = [[k >> j & 1 for j in range(len(LABELLERS))] for k, n in patterns.items() for _ in range(n)]
    share, bad, good = 0.1, [0.4] * len(LABELLERS), [0.02] * len(LABELLERS)

    def likelihood(p, d):
        return math.prod(q if x else 1 - q for q, x in zip(p, d, strict=True))

    for _ in range(50):
        post = []
        for d in docs:
            a, b = share * likelihood(bad, d), (1 - share) * likelihood(good, d)
            post.append(a / (a + b))
        n_bad, n_good = sum(post), len(docs) - sum(post)
        share = min(max((n_bad + 0.1) / (len(docs) + 1), 1e-4), 0.5)
        bad = [min(max((sum(p * d[j] for p, d in zip(post, docs, strict=True)) + 0.4) / (n_bad + 1), 1e-4), 0.9999) for j in range(len(LABELLERS))]
        good = [min(max((sum((1 - p) * d[j] for p, d in zip(post, docs, strict=True)) + 0.02) / (n_good + 1), 1e-5), MOST_FALSE) for j in range(len(LABELLERS))]
    got = estimate(patterns)
    at = 0
    for k, n in patterns.items():
        assert abs(got[k] - post[at]) < 1e-6
        at += n


def test_labellers_equal_plain_counts():
    import numpy as np
    import pyarrow as pa

    from noteloom.llm.common import slices
    from noteloom.llm.quality import fires

    texts = ["", "SHOUTING TEXT here", "a = b; {c} #x $y", "wow! no! hey! yes", "| a | b | c", "go go go go stop", "x" * 30, "1234 5678 90", " ".join(f"word{i}" for i in range(40)), "Plain words. They end here.", "a b c d", "\u00e9\u00e8 caf\u00e9"]

    def plain(t):
        raw, words = t.encode(), t.split()
        letters = sum(65 <= b < 91 or 97 <= b < 123 or b >= 128 for b in raw)
        size, n = max(1, len(raw)), max(1, len(words))
        mean = sum(len(w.encode()) for w in words) / n
        fired = [
            sum(65 <= b < 91 for b in raw) / max(1, letters) > 0.3, sum(chr(b) in "#$%&*+<=>@\\^_`{|}~" for b in raw) / size > 0.02, t.count("!") / n > 0.2, t.count("|") / n > 0.1,
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / n > 0.15, mean > 20 or bool(words) and mean < 2, sum(48 <= b < 58 for b in raw) / size > 0.2, len(words) >= 30 and t.count(".") / n < 0.004,
        ]
        return sum(f << k for k, f in enumerate(fired))

    ((_, _, run),) = slices(pa.array(texts))
    assert fires(run).tolist() == [plain(t) for t in texts]
    assert len(np.unique(fires(run))) > 5


def test_ngrams_of_long_texts_equal_sets(monkeypatch):
    import pyarrow as pa

    from noteloom.llm import toxicity
    from noteloom.llm.common import slices

    monkeypatch.setattr(toxicity, "STRETCH", 16)
    texts = ["", "abc", "One text\tof WORDS, one text of words", "xyz" * 40, "caf\u00e9 caf\u00e9"]

    def grams(t):
        raw = bytes(32 if 9 <= b < 14 else b + 32 if 65 <= b < 91 else b for b in t.encode())
        return {raw[i : i + n] for n in toxicity.SIZES for i in range(len(raw) - n + 1)}

    buckets = {}
    for t in texts:
        for g in grams(t):
            buckets[g] = next(b[0] for n, b in toxicity._ngrams(__import__("numpy").frombuffer(g, "u1")) if n == len(g))
    ((_, _, run),) = slices(pa.array(texts))
    text, feature = toxicity._present(run)
    assert set(zip(text.tolist(), feature.tolist(), strict=True)) == {(i, int(buckets[g])) for i, t in enumerate(texts) for g in grams(t)}


def test_ratios_and_regression_equal_plain_ones():
    import math

    import numpy as np
    import pyarrow as pa

    from noteloom.llm import toxicity
    from noteloom.llm.linear import fit_logistic

    rng = np.random.default_rng(5)
    size = (1 << toxicity.BITS) // toxicity.PARTS
    counts = np.zeros((toxicity.FOLDS, 2, size), np.int32)
    counts[:, :, :40] = rng.integers(0, 30, (toxicity.FOLDS, 2, 40))
    group = np.array([[60, 50], [55, 52], [58, 51]])
    halves = [pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([c.astype(np.int32).tobytes()], pa.binary())], ["part", "counts"]) for c in (counts // 2, counts - counts // 2)]
    (out,) = toxicity._ratios(group)(iter(halves))
    used = np.frombuffer(out["used"][0].as_py(), "<i4")
    found = np.frombuffer(out["ratios"][0].as_py(), "<f4").reshape(toxicity.FOLDS + 1, -1)

    def ratio(j, without):
        folds = [f for f in range(toxicity.FOLDS) if f != without]
        clean, toxic = (sum(int(counts[f, c, j]) for f in folds) for c in (0, 1))
        n_clean, n_toxic = (sum(int(group[f, c]) for f in folds) for c in (0, 1))
        r = math.log((toxic + 1) / (n_toxic + 2)) - math.log((clean + 1) / (n_clean + 2))
        return 0 if clean + toxic < toxicity.LEAST_TEXTS or abs(r) < toxicity.LEAST_RATIO else r

    for j in range(40):
        want = [ratio(j, f) for f in (0, 1, 2, None)]
        at = np.flatnonzero(used == 2 * size + j)
        got = found[:, at[0]].tolist() if len(at) else [0] * 4
        assert all(abs(a - b) < 1e-5 for a, b in zip(got, want, strict=True))

    x = rng.random((30, 12)) < 0.4
    y = (x[:, 0] | x[:, 3]).astype(float)
    scale = rng.normal(size=12).astype(np.float32)
    index, edge = np.nonzero(x)[1], np.concatenate([[0], np.cumsum(x.sum(axis=1))])
    w, b = fit_logistic(index, edge, y, 12, l2=1e-3, scale=scale, rounds=40, rate=0.3)
    pw, pb, sw, sb = np.zeros(12), 0.0, np.full(12, 1e-8), 1e-8
    for _ in range(40):
        z = (x * scale) @ pw + pb
        error = (1 / (1 + np.exp(-z)) - y) / 30
        g, gb = (x * scale).T @ error + 1e-3 * pw, error.sum()
        sw, sb = sw + g * g, sb + gb * gb
        pw, pb = pw - 0.3 * g / np.sqrt(sw), pb - 0.3 * gb / np.sqrt(sb)
    assert np.allclose(w, pw, atol=1e-5) and abs(b - pb) < 1e-5


URLS = [
    ("http://Example.ORG/en/12?q", "example.org", "/en/12", "example.org/en/1", "block"),
    ("https://a.example.org/en/2#x", "a.example.org", "/en/2", "org/", "allow"),
    ("x://www.shop.com/de/", "www.shop.com", "/de/", "com/de/", "block"),
    ("x://shop.com/fr/a", "shop.com", "/fr/a", "com/fr/", "allow"),
    ("x://notexample.org", "notexample.org", "", None, None),
    ("x://myorg/", "myorg", "/", None, None),
    ("no scheme", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("http://É.com?/fr/", "É.com", "", None, None),
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "page_id long, url string")
    host, path = split_url(F.col("url"))
    hit = match_rules(F.col("host"), F.col("path"))
    got = df.select("page_id", host.alias("host"), path.alias("path")).withColumn("hit", hit).orderBy("page_id").collect()
    assert [(r.host, r.path, r.hit and r.hit.rule, r.hit and r.hit.verdict) for r in got] == [u[1:] for u in URLS]


def test_reputation_decides_the_rest(spark):
    urls = [(i, f"http://good.net/{i}") for i in range(40)] + [(100 + i, f"http://bad.net/{i}") for i in range(40)] + [(200, "http://new.net/"), (200, "http://new.net/"), (None, None)]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("verdict", F.lit("clash")).withColumn("host", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)] + [(None, 1), (200, None)], "doc_id long, quality int")
    got = {r.page_id: r.verdict for r in judge_urls(pages, labels).collect()}
    assert got[3] == "allow" and got[103] == "block" and set(got) >= {200, None}
    assert judge_urls(pages, labels).count() == 83
    assert judge_urls(pages.where("false"), labels).count() == 0
    assert judge_urls(pages, labels.where("false")).where("verdict is null").count() == 0
    plan = judge_urls(pages, labels)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_a_bad_host_among_many_is_blocked(spark):
    """100,000 pages of 2,000 hosts, a third of them of one: a host whose few
    labels are bad goes, one without labels stands with its domain."""
    i = F.col("id")
    host = F.when(i % 3 == 0, "hot.site.net").when(i % 50 == 1, "casino.spam.biz").when(i % 50 == 2, "new.spam.biz").otherwise(F.concat(F.lit("h"), (i % 2000).cast("string"), F.lit(".site.net")))
    pages = spark.range(100_000).select(i.alias("page_id"), F.concat(F.lit("http://"), host, F.lit("/p/"), i.cast("string")).alias("url"))
    labels = pages.where("page_id % 10 = 1").select(F.col("page_id").alias("doc_id"), (~F.col("url").contains("casino")).cast("int").alias("quality"))
    got = {r.host: (r.verdict, r.n) for r in judge_urls(pages, labels).groupBy("host", "verdict").agg(F.count("*").alias("n")).collect()}
    assert got["casino.spam.biz"][0] == got["new.spam.biz"][0] == "block"
    assert got["hot.site.net"] == ("allow", 33_334) and sum(n for _, n in got.values()) == 100_000
    assert {v for h, (v, _) in got.items() if h.endswith("site.net")} == {"allow"}
