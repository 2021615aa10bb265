"""Link graph over pages(name, category, tags, related, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions.text import unbracketed, wikilinks

# The largest tag group and the tags that say nothing.
MOST_MEMBERS = 16
GENERIC_TAGS = ("LLM-synthesized", "概念", "策略", "系統", "架構", "raw")


def unique_pages(pages: DataFrame) -> DataFrame:
    """One page a name: that of the greatest path."""
    latest = F.row_number().over(Window.partitionBy("name").orderBy(F.desc_nulls_last("path")))
    return pages.withColumn("_r", latest).where("_r = 1").drop("_r")


def frontmatter_edges(pages: DataFrame) -> DataFrame:
    """src, dst of related pages that exist; a page may name itself."""
    named = pages.select(F.col("name").alias("src"), F.explode("related").alias("r")).select("src", unbracketed(F.col("r")).alias("dst"))
    return named.join(pages.select(F.col("name").alias("n")), F.col("dst") == F.col("n"), "left_semi").distinct()


def link_edges(pages: DataFrame) -> DataFrame:
    """src, dst of links in the text to other pages that exist."""
    named = pages.select(F.col("name").alias("src"), F.explode(wikilinks(F.col("content"))).alias("dst")).where("src <> dst")
    return named.join(pages.select(F.col("name").alias("n")), F.col("dst") == F.col("n"), "left_semi").distinct()


def tag_edges(pages: DataFrame, most: int = MOST_MEMBERS) -> DataFrame:
    """src < dst, tag: pages that share a tag of 2 to `most` pages. Counting
    before the self-join bounds every group of the join."""
    tagged = pages.select("name", F.explode("tags").alias("tag")).where(~F.col("tag").isin(*GENERIC_TAGS)).distinct()
    small = tagged.groupBy("tag").agg(F.count("*").alias("n")).where(F.col("n").between(2, most)).select(F.col("tag").alias("t"))
    members = tagged.join(small, F.col("tag") == F.col("t"), "left_semi")
    other = members.select(F.col("name").alias("dst"), F.col("tag").alias("t"))
    return members.join(other, (F.col("tag") == F.col("t")) & (F.col("name") < F.col("dst"))).select(F.col("name").alias("src"), "dst", "tag")


def graph_edges(pages: DataFrame, most: int = MOST_MEMBERS) -> DataFrame:
    """a <= b, confidence, source: one edge a pair, related pages before links
    before shared tags (of several tags the least is named)."""
    parts = [
        frontmatter_edges(pages).select("src", "dst", F.lit(1).alias("p"), F.lit("frontmatter").alias("source")),
        link_edges(pages).select("src", "dst", F.lit(2).alias("p"), F.lit("wikilink").alias("source")),
        tag_edges(pages, most).select("src", "dst", F.lit(3).alias("p"), F.concat(F.lit("tag:"), "tag").alias("source")),
    ]
    every = parts[0].unionAll(parts[1]).unionAll(parts[2])
    best = every.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min(F.struct("p", "source")).alias("best"))
    return best.select("a", "b", F.when(F.col("best.p") < 3, "EXTRACTED").otherwise("INFERRED").alias("confidence"), F.col("best.source").alias("source"))


def neighbours(edges: DataFrame) -> DataFrame:
    """name, neighbour in both directions."""
    return edges.select(F.col("a").alias("name"), F.col("b").alias("neighbour")).unionAll(edges.where("a <> b").select("b", "a"))


def orphans(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Names of pages on no edge."""
    on_edge = edges.select(F.explode(F.array("a", "b")).alias("n"))
    return pages.select("name").join(on_edge, F.col("name") == F.col("n"), "left_anti")


def broken_links(pages: DataFrame) -> DataFrame:
    """name, target of every link to no page, repeats included."""
    named = pages.select("name", F.explode(wikilinks(F.col("content"))).alias("target"))
    return named.join(pages.select(F.col("name").alias("n")), F.col("target") == F.col("n"), "left_anti")


def graph_stats(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: pages, edges by confidence and density."""
    n = pages.agg(F.count("*").alias("pages"))
    e = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("confidence") == "EXTRACTED").alias("extracted"), F.count_if(F.col("confidence") == "INFERRED").alias("inferred"))
    density = F.when(F.col("pages") > 1, F.round(2 * F.col("edges") / (F.col("pages") * (F.col("pages") - 1)), 4)).otherwise(0.0)
    return n.join(e).select("pages", "edges", "extracted", "inferred", density.alias("density"))


def category_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("category").agg(F.count("*").alias("pages"))


def diagnostics(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: pages on no edge, broken links, pages without a header."""
    return (
        orphans(pages, edges).agg(F.count("*").alias("orphans"))
        .join(broken_links(pages).agg(F.count("*").alias("broken_links")))
        .join(pages.agg(F.count_if(~F.coalesce("has_header", F.lit(False))).alias("no_header")))
    )


def diagnostic_lists(pages: DataFrame, edges: DataFrame, most: int = 100) -> DataFrame:
    """kind (orphan, broken_link, no_header), n (all there are), names: the
    first `most` by name, links as "page -> target"."""
    parts = [
        orphans(pages, edges).select(F.lit("orphan").alias("kind"), "name"),
        broken_links(pages).select(F.lit("broken_link").alias("kind"), F.concat_ws(" -> ", "name", "target").alias("name")),
        pages.where(~F.coalesce("has_header", F.lit(False))).select(F.lit("no_header").alias("kind"), "name"),
    ]
    every = parts[0].unionAll(parts[1]).unionAll(parts[2])
    place = F.row_number().over(Window.partitionBy("kind").orderBy("name"))
    first = every.withColumn("r", place).where(F.col("r") <= most).groupBy("kind").agg(F.array_sort(F.collect_list("name")).alias("names"))
    counts = every.groupBy(F.col("kind").alias("k")).agg(F.count("*").alias("n"))
    return counts.join(first, F.col("k") == F.col("kind")).select("kind", "n", "names")


def concept_lookup(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """asked, name: the page of that name, else the least name that holds the
    asked one or is held by it, ignoring case; null for none.

    Exact names resolve by an equi-join; only the rest compares names, of a
    stated set of asked names against the table."""
    names = pages.select("name").distinct()
    exact = wanted.join(names, F.col("asked") == F.col("name"), "left")
    rest = exact.where("name is null").select("asked")
    holds = F.lower("name").contains(F.lower("asked")) | F.lower("asked").contains(F.lower("name"))
    near = rest.join(names, holds, "left").groupBy("asked").agg(F.min("name").alias("name"))
    return exact.where("name is not null").select("asked", "name").unionAll(near)
