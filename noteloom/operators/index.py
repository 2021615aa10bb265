"""TF-IDF postings and keyword search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions.text import index_text, snippet, tokens

MOST_TERMS = 100_000
#: Rows that are counted, and rows that are given out, at once.
ROWS_AT_ONCE, ROWS_GIVEN = 512, 1 << 16


def _counted(wanted: list[str] | None):
    """name, term, tf, most of rows (name, t: its tokens); only of the wanted
    terms, if they are given. most is the largest tf of all."""
    sought = None if wanted is None else pa.array(wanted, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), ROWS_AT_ONCE):
                part = whole.slice(at, ROWS_AT_ONCE)
                name, t = part.column(0), part.column(1)
                word = t.flatten().dictionary_encode()
                n = len(word.dictionary)
                if not n:
                    continue
                place = pc.list_parent_indices(t).to_numpy().astype(np.int64) * n + word.indices.to_numpy()
                pair, tf = np.unique(place, return_counts=True)
                row, code = pair // n, pair % n
                first = np.flatnonzero(np.diff(row, prepend=-1))
                most = np.repeat(np.maximum.reduceat(tf, first), np.diff(first, append=len(row)))
                if sought is not None:
                    kept = pc.is_in(word.dictionary, value_set=sought).to_numpy(zero_copy_only=False)[code]
                    row, code, tf, most = row[kept], code[kept], tf[kept], most[kept]
                for i in range(0, len(row), ROWS_GIVEN):
                    to = slice(i, i + ROWS_GIVEN)
                    columns = [name.take(pa.array(row[to])).cast(pa.string()), word.dictionary.take(pa.array(code[to])).cast(pa.string()), pa.array(tf[to], pa.int64()), pa.array(most[to], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["name", "term", "tf", "most"])

    return run


def postings(pages: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """term, name, weight with weight = tf / max tf * ln(pages / (1 + pages
    with the term)).

    The tokens of a page are counted within its row, some rows at a time; only
    where names repeat (counted) are the texts of a name brought together first.

    For queries (query_id, text) only the postings of their terms. Up to
    MOST_TERMS of these (counted) they go along with the count and their page
    counts are broadcast, so a term that every page has is no hot key of a join.
    """
    text = index_text(F.col("name"), F.coalesce("content", F.lit("")), F.col("tags"))
    n, rows = pages.agg(F.countDistinct("name"), F.count("*")).first()
    texts = pages.select("name", text.alias("text"))
    if rows > n:
        texts = texts.groupBy("name").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    few, wanted = False, None
    if queries is not None:
        asked = queries.select(F.explode(tokens(F.col("text"))).alias("q")).distinct()
        first = [r["q"] for r in asked.limit(MOST_TERMS + 1).collect()]
        few = len(first) <= MOST_TERMS
        wanted = first if few else None
    tf = texts.select("name", tokens(F.col("text")).alias("t")).mapInArrow(_counted(wanted), "name string, term string, tf long, most long")
    if queries is not None and not few:
        tf = tf.join(asked, F.col("term") == F.col("q"), "left_semi")
    df = tf.groupBy(F.col("term").alias("t")).agg(F.count("*").alias("df"))
    found = tf.join(F.broadcast(df) if few else df, F.col("term") == F.col("t"))
    return found.select("term", "name", (F.col("tf") / F.col("most") * F.ln(F.lit(n) / (1 + F.col("df")))).alias("weight"))


def keyword_scores(index: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, name, score: a word counts as often as a query repeats it."""
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("t")).groupBy("query_id", "t").agg(F.count("*").alias("times"))
    return index.join(asked, F.col("term") == F.col("t")).groupBy("query_id", "name").agg(F.sum(F.col("weight") * F.col("times")).alias("score"))


def keyword_search(index: DataFrame, pages: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """query_id, rank, name, category, score (3 decimals), snippet. Texts join
    after the cut to `limit`."""
    score = keyword_scores(index, queries).withColumn("score", F.bround("score", 3))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "name"))
    top = score.withColumn("rank", rank).where(F.col("rank") <= limit)
    text = pages.select(F.col("name").alias("n"), "category", "content")
    return top.join(text, F.col("name") == F.col("n")).select("query_id", "rank", "name", "category", "score", snippet(F.col("content")).alias("snippet"))


def normalised(hits: DataFrame) -> DataFrame:
    """Scores over the query's largest; a largest of zero counts as one, a
    negative one is kept."""
    most = F.max("score").over(Window.partitionBy("query_id"))
    return hits.withColumn("score", F.col("score") / F.when(most == 0, 1.0).otherwise(most))
