import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from noteloom.llm.near_copies import near_copies
from noteloom.llm.packing import pack_documents
from noteloom.llm.quality import ACCEPT, score_quality
from noteloom.llm.substring_dedup import remove_repeated_passages
from noteloom.llm.toxicity import THRESHOLD, score_toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_do_what_their_operators_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held, now = texts(docs), docs
    out = {}
    for name, stage in p.STAGES[:-1]:
        out[name] = stage(spark, now, SF).cache()
        assert out[name].columns == docs.columns
        got = texts(out[name])
        if name == "quality":
            kept = {r.doc_id for r in score_quality(now).collect() if r.score >= ACCEPT}
        elif name == "toxicity":
            kept = {r.doc_id for r in score_toxicity(now, labels).collect() if r.score < THRESHOLD}
        elif name == "near_dedup":
            kept = {r.doc_id for r in near_copies(now).collect() if r.doc_id == r.component_id}
        else:
            cut = {r.doc_id: r for r in remove_repeated_passages(now).collect()}
            kept = set(cut)
            held = {d: cut[d].kept_text if cut[d].n_removed else t for d, t in held.items() if d in cut}
        assert got == {d: held[d] for d in kept} and out[name].count() == len(kept)
        held, now = got, out[name]
    want = pack_documents(now, __import__("public_tokenizers").path("byte_bpe_50k.json"))
    key = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    assert sorted(map(tuple, p.run(spark, SF).select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))


def test_stages_take_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, "s", 0), (3, "a few words", "en", None, None), (3, "a few words", "en", None, None), (4, "some more words " * 300, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (docs, docs.where("false")):
        for name, f in p.STAGES[:-1]:
            got = f(spark, stage.withColumn("extra", F.lit(1)), SF)
            assert got.columns == docs.columns and got.count() <= stage.count(), name
        assert p.packing(spark, stage, SF).count() >= stage.count()
