"""A knowledge base as one object: what a caller can ask of it.

Every method returns DataFrames; queries come in batches (query_id, text). All
search paths end in ranking.two_stage_hybrid.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.config import Config
from noteloom.functions.scoring import needs_expansion
from noteloom.functions.text import recall_snippet
from noteloom.operators import codegraph, graph, index, ranking, recall, sections, vectors
from noteloom.providers import EmbeddingProvider, TextProvider, embed, embedded, expansions, rewrite
from noteloom.sources import pages as page_source
from noteloom.sources import tables
from noteloom.sources.adapters import adapter_documents, folder_documents
from noteloom.sources.python_files import git_head, python_files

CHUNK_SHOWN = 1000


class KnowledgeBase:
    """Pages, their graph and their index, as of when it was made; make a new
    one when stale() says that files have changed."""

    def __init__(self, spark: SparkSession, root: str, config: Config, store: str, embedder: EmbeddingProvider | None = None, writer: TextProvider | None = None):
        self.spark, self.root, self.config, self.store = spark, root, config, store
        self.embedder, self.writer = embedder, writer
        self.files = page_source.scan(spark, root)
        self.listing = self.files.select("path", "mtime")
        self._parsed: DataFrame | None = None

    @cached_property
    def parsed(self) -> DataFrame:
        """The parsed files, written once: a persisted scan would be taken for
        that of a later object over the same folder, and be out of date."""
        return tables.staged(page_source.parsed_pages(self.files) if self._parsed is None else self._parsed, self.store)

    @cached_property
    def pages(self) -> DataFrame:
        return page_source.latest(self.parsed).persist()

    @cached_property
    def edges(self) -> DataFrame:
        return graph.graph_edges(self.pages).persist()

    @cached_property
    def postings(self) -> DataFrame:
        return index.postings(self.pages).persist()

    @property
    def model_version(self) -> str:
        return self.config.model_version(self.embedder.dimension if self.embedder else 0)

    def close(self) -> None:
        """Free what is held in memory, and all that is staged below the store;
        what reads it must have been read by then."""
        tables.drop_staging(self.spark, self.store)
        for name in ("pages", "edges", "postings"):
            if name in self.__dict__:
                self.__dict__.pop(name).unpersist()
        self.__dict__.pop("parsed", None)

    def stale(self, manifest: DataFrame) -> bool:
        """Whether files differ from a listing (path, mtime) kept before."""
        return page_source.needs_rebuild(page_source.scan(self.spark, self.root).select("path", "mtime"), manifest)

    def refreshed(self) -> KnowledgeBase:
        """The knowledge base as files are now: only those that changed since
        this one was made are read; graph and index are made anew."""
        other = KnowledgeBase(self.spark, self.root, self.config, self.store, self.embedder, self.writer)
        other._parsed = page_source.refreshed(self.parsed, other.files, self.parsed.select("path", "mtime"))
        return other

    # -- reading -------------------------------------------------------------

    def concept(self, asked: DataFrame) -> DataFrame:
        """asked, the page that it means, and its neighbours by name."""
        found = graph.concept_lookup(self.pages, asked)
        near = graph.neighbours(self.edges).groupBy(F.col("name").alias("n")).agg(F.array_sort(F.collect_set("neighbour")).alias("neighbours"))
        page = self.pages.select(F.col("name").alias("p"), "category", "metadata", "content")
        return found.join(page, F.col("name") == F.col("p")).join(near, F.col("name") == F.col("n"), "left").drop("p", "n")

    def outline(self) -> DataFrame:
        return sections.outline(self.pages)

    def section(self, wanted: DataFrame) -> DataFrame:
        return sections.section_read(self.pages, wanted)

    def stats(self) -> DataFrame:
        return graph.graph_stats(self.pages, self.edges).join(graph.diagnostics(self.pages, self.edges))

    def diagnostics(self, most: int = 100) -> DataFrame:
        return graph.diagnostic_lists(self.pages, self.edges, most)

    # -- searching -----------------------------------------------------------

    def keyword(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        """Hits of a batch of queries; the index is only made of its terms,
        unless all of it is there already."""
        held = self.postings if "postings" in self.__dict__ else index.postings(self.pages, queries)
        return index.keyword_search(held, self.pages, queries, limit)

    def _vector_hits(self, queries: DataFrame, k: int) -> DataFrame | None:
        if self.embedder is None:
            return None
        asked = queries.select("query_id", embed(F.col("text"), self.embedder).alias("vec"))
        held = tables.read(self.spark, self.store, "embeddings")
        return vectors.vector_search(held, asked, k, self.model_version)

    def _ranked(self, queries: DataFrame, top_k: int, now: Column | None, intents: DataFrame | None) -> DataFrame:
        k = ranking.over_fetch(top_k)
        kw = self.keyword(queries, k).select("query_id", "rank", F.col("name").alias("concept"), "score")
        snapshot = None
        if self.config.recency.enabled:
            snapshot = ranking.recency_snapshot(tables.read(self.spark, self.store, "embeddings"), self.model_version)
        r = self.config.recency
        return ranking.two_stage_hybrid(
            kw, self._vector_hits(queries, k), self.pages, self.edges, top_k, intents, intents and intents.select("query_id", "w_keyword", "w_vector"), snapshot,
            F.current_timestamp() if now is None else now, recency={"base": r.base_lambda, "floor": r.floor, "ratios": dict(r.category_ratio or {}), "evergreen": tuple(r.evergreen)},
        )

    def hybrid(self, queries: DataFrame, top_k: int = 10, now: Column | None = None) -> DataFrame:
        """The hybrid ranking with plain weights."""
        return self._with_text(self._ranked(queries, top_k, now, None))

    def smart(self, queries: DataFrame, top_k: int = 10, now: Column | None = None) -> DataFrame:
        """Weights and boosts by intent; queries with a weak best hit or several
        subjects are searched again in up to three other wordings. The text
        provider is asked once a query; a failed reply gives no wordings."""
        custom = {k: tuple(v) for k, v in self.config.intent_patterns.items()}
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "text")
        first = self._ranked(asked, top_k, now, ranking.classified(asked, custom))
        if self.writer is None:
            return self._with_text(first)
        first = tables.staged(first, self.store)
        best = first.groupBy(F.col("query_id").alias("b")).agg(F.max("score").alias("best"))
        weak = asked.join(best, F.col("query_id") == F.col("b"), "left").where(needs_expansion(F.col("best"), F.col("text"))).select("query_id", "text")
        prompt = "Give three other wordings of this question, one a line:\n{content}"
        raw = weak.select(F.col("query_id").cast("string").alias("rel"), F.lit("").alias("hash"), F.col("text").alias("content"))
        replies = tables.staged(rewrite(raw, self.writer, prompt), self.store)
        parts = replies.select(F.col("rel").cast("long").alias("of"), F.posexplode(expansions(F.col("text"))).alias("part", "text"))
        more = parts.select((F.col("of") * 4 + F.col("part") + 1).alias("query_id"), "text")
        again = self._ranked(more, top_k, now, ranking.classified(more, custom)).withColumn("part", F.pmod("query_id", F.lit(4)).cast("int")).withColumn("query_id", F.floor(F.col("query_id") / 4))
        every = first.withColumn("part", F.lit(0)).drop("rank").unionByName(again.drop("rank"))
        return self._with_text(ranking.expansion_merge(every, top_k))

    def answers(self, queries: DataFrame, top_k: int = 10, now: Column | None = None, smart: bool = False) -> DataFrame:
        """query_id, text, degradation, results: one row for each query, with
        its hits in order and why they are poorer, if they are. Without vectors
        the hits are those of the keyword search alone."""
        kw = self.keyword(queries, ranking.over_fetch(top_k))
        if self.embedder is None:
            found = ranking.keyword_as_ranked(kw).where(F.col("rank") <= top_k)
        else:
            found = self.smart(queries, top_k, now) if smart else self.hybrid(queries, top_k, now)
        found = tables.staged(found.select("query_id", "rank", "concept", "section", "category", "chunk", F.bround("score", 4).alias("score")), self.store)
        flags = ranking.degradation(queries, kw, found, self.embedder is not None).select(F.col("query_id").alias("d"), "degradation")
        lists = found.groupBy(F.col("query_id").alias("q")).agg(F.array_sort(F.collect_list(F.struct("rank", "concept", "section", "category", "score", "chunk"))).alias("results"))
        none = F.array().cast(lists.schema["results"].dataType)
        return queries.select("query_id", "text").join(flags, F.col("query_id") == F.col("d"), "left").join(lists, F.col("query_id") == F.col("q"), "left").select("query_id", "text", "degradation", F.coalesce("results", none).alias("results"))

    def _with_text(self, ranked: DataFrame) -> DataFrame:
        """The chunk of the best section, else the page's first line."""
        held = tables.read(self.spark, self.store, "embeddings").where(F.col("model_version") == self.model_version)
        chunk = held.select(F.col("concept").alias("kc"), F.col("section").alias("ks"), F.left("chunk", F.lit(CHUNK_SHOWN)).alias("chunk"))
        return ranked.join(chunk, (F.col("concept") == F.col("kc")) & (F.col("section") == F.col("ks")), "left").drop("kc", "ks")

    def hit_rate(self, found: DataFrame, asked: DataFrame, top_n: int = 3, when: Column | None = None) -> DataFrame:
        """Share of asked (query_id, wanted) in found; the day's row is kept in
        the history, in place of an earlier one of that day."""
        result = ranking.hit_rate(found, asked, top_n)
        history = tables.read(self.spark, self.store, "eval_history")
        day = F.current_date() if when is None else F.to_date(when)
        row = result.select(day.alias("eval_date"), "hit_rate", F.col("total_q").cast("int").alias("total_q"), F.col("hits").cast("int").alias("hits"), F.lit(top_n).alias("top_n"), F.current_timestamp().alias("created_at"))
        others = history.join(row.select(F.col("eval_date").alias("d")), F.col("eval_date") == F.col("d"), "left_anti")
        tables.commit(self.spark, self.store, {"eval_history": others.unionByName(row)})
        return result

    def evaluate(self, sample: int = 20, top_n: int = 3, seed: int = 0, template: str = "{name}") -> DataFrame:
        """The hit rate over sampled pages, each asked for by its name."""
        names = ranking.sampled(self.pages, sample, seed).withColumn("query_id", F.xxhash64("name"))
        text = F.replace(F.lit(template), F.lit("{name}"), F.col("name"))
        found = tables.staged(self.hybrid(names.select("query_id", text.alias("text")), max(top_n, 5)).select("query_id", "rank", "concept"), self.store)
        return self.hit_rate(found, names.select("query_id", F.col("name").alias("wanted")), top_n)

    # -- writing -------------------------------------------------------------

    def pending(self, now: Column | None = None) -> DataFrame:
        """What an embed run would do: the store after it, without vectors."""
        incoming = sections.chunk_sections(self.pages).join(self.pages.select(F.col("name").alias("pn"), "category", "mtime"), F.col("name") == F.col("pn"))
        name = F.when(F.col("occurrence") > 1, F.concat("section", F.lit(" ("), F.col("occurrence").cast("string"), F.lit(")"))).otherwise(F.col("section"))
        rows = incoming.select(F.col("name").alias("concept"), name.alias("section"), F.lit(self.model_version).alias("model_version"), "content_hash", "category", F.col("mtime").alias("source_mtime"), "chunk")
        stored = tables.read(self.spark, self.store, "embeddings")
        diff = sections.upsert(stored, rows, F.current_timestamp() if now is None else now)
        key = ["concept", "section", "model_version"]
        old = stored.select(*key, F.col("vec").alias("old_vec"), F.col("chunk").alias("old_chunk"))
        return diff.join(rows.select(*key, "chunk"), key, "left").join(old, key, "left").withColumn("chunk", F.coalesce("chunk", "old_chunk")).drop("old_chunk")

    def embed_sections(self, prune: bool = False, now: Column | None = None) -> DataFrame:
        """Bring the store up to date: only new and changed sections are
        embedded, once each. action and rows; failed counts sections without a
        vector: an old row stays as it was, and the next run tries again."""
        if self.embedder is None:
            raise ValueError("no embedding provider is set")
        key = ["concept", "section", "model_version"]
        diff = tables.staged(self.pending(now), self.store)
        changed = sections.to_embed(diff).withColumn("e", embedded(F.col("chunk"), self.embedder)).drop("old_vec")
        changed = tables.staged(changed.select("*", F.col("e.vec").alias("vec"), F.col("e.error").alias("error")).drop("e"), self.store)
        counts = diff.groupBy("action").agg(F.count("*").alias("rows")).collect()
        done = {r["action"]: r["rows"] for r in counts}
        failed = {r["action"]: r["rows"] for r in changed.where("vec is null").groupBy("action").agg(F.count("*").alias("rows")).collect()}
        stored = tables.read(self.spark, self.store, "embeddings")
        kept = stored.join(changed.where("vec is null").select(*key), key, "left_semi").withColumn("action", F.lit("failed"))
        same = diff.where(~F.col("action").isin("insert", "update")).withColumnRenamed("old_vec", "vec")
        every = same.unionByName(changed.where("vec is not null").drop("error")).unionByName(kept, allowMissingColumns=True)
        if prune and any(a != "keep" for a in done):
            every = every.where((F.col("model_version") != self.model_version) | (F.col("action") != "keep"))
        tables.commit(self.spark, self.store, {"embeddings": every})
        tables.unstaged(diff, changed)
        out = {a: n - failed.get(a, 0) for a, n in done.items()} | ({"failed": sum(failed.values())} if failed else {})
        return self.spark.createDataFrame([(a, n) for a, n in out.items() if n], "action string, rows long")

    def ingest(self, raw: str, prompt: str = "Rewrite these notes as one page:\n{content}") -> DataFrame:
        """New and changed raw files become pages, by the text provider; what
        adapters bring is kept below raw first. Files that fail are noted and
        tried again by the next run. status and files, as noted."""
        if self.writer is None:
            raise ValueError("no text provider is set")
        fetched = []
        for source in self.config.adapters:
            if source.module:
                fetched.append(adapter_documents(self.spark, source.module))
            elif source.type == "filesystem":
                fetched.append(folder_documents(self.spark, source.source))
        for one in fetched:
            tables.write_texts(one.select(F.col("filename").alias("name"), F.col("content").alias("text")), raw)
        state = tables.read(self.spark, self.store, "ingest_state")
        fresh = page_source.to_ingest(folder_documents(self.spark, raw).select(F.col("filename").alias("path"), "content"), state)
        made = tables.staged(rewrite(fresh, self.writer, prompt), self.store)
        tables.write_texts(made.where("text is not null").select(F.concat(F.regexp_replace("rel", r"\.[^.]*$", ""), F.lit(".md")).alias("name"), "text"), self.root)
        status = F.when(F.col("error").isNull(), "ingested").otherwise("failed")
        news = made.select("rel", "hash", status.alias("status"), F.current_timestamp().alias("ingested_at"), "error")
        kept = state.join(news.select(F.col("rel").alias("r")), F.col("rel") == F.col("r"), "left_anti")
        tables.commit(self.spark, self.store, {"ingest_state": kept.unionByName(news)})
        tables.unstaged(made)
        return page_source.ingest_stats(tables.read(self.spark, self.store, "ingest_state"))

    # -- code ----------------------------------------------------------------

    def sync_code(self, folder: str, repo: str, method: str = "all", exclude: tuple[str, ...] = ()) -> DataFrame:
        """Index a repository and link its symbols to pages. One row: counts."""
        if method not in ("all", "name_only", "embedding_only"):
            raise ValueError(f"no such method: {method}")
        files = codegraph.module_names(python_files(self.spark, folder, exclude))
        found = codegraph.facts(files, repo).persist()
        head = git_head(folder)
        known = codegraph.symbols(found, repo).withColumns({"git_head": F.lit(head).cast("string"), "indexed_at": F.current_timestamp()})
        calls = codegraph.call_edges(found, known).select(F.lit(repo).alias("repo"), F.xxhash64("caller").alias("caller_id"), F.xxhash64("callee").alias("callee_id"), F.lit("call").alias("call_type"))
        imports = codegraph.import_edges(found).select(F.lit(repo).alias("repo"), F.xxhash64("importer").alias("importer_id"), "imported", "is_type_only")
        known = tables.staged(known, self.store)
        links = tables.staged(self._linked(known, method).select(F.lit(repo).alias("repo"), "symbol_id", "concept", "link_type", "score"), self.store)
        counts = found.agg(F.count_if(F.col("kind") == "error").alias("error_count"), F.count_if(F.col("kind") == "bind").alias("import_edge_count"))
        state = known.agg(F.count("*").alias("symbol_count")).join(calls.agg(F.count("*").alias("call_edge_count"))).join(counts)
        row = state.select(F.lit(repo).alias("repo"), F.lit(folder).alias("repo_path"), F.lit(head).cast("string").alias("git_head"), F.current_timestamp().alias("indexed_at"), *(F.col(c).cast("int").alias(c) for c in ("symbol_count", "call_edge_count", "import_edge_count", "error_count")))
        # one commit: readers see the old index or the new one, whole
        tables.commit(self.spark, self.store, {"symbols": known, "call_edges": calls, "import_edges": imports, "links": links, "index_state": row}, repo)
        tables.unstaged(known, links)
        found.unpersist()
        return tables.read(self.spark, self.store, "index_state").where(F.col("repo") == repo)

    def _linked(self, known: DataFrame, method: str) -> DataFrame:
        held = tables.read(self.spark, self.store, "embeddings")
        if self.embedder is not None:
            held = held.where(F.col("model_version") == self.model_version)
        named, concepts, nearest = known.select(F.col("id").alias("symbol_id"), "short_name"), held.select("concept").distinct(), None
        if method != "name_only" and self.embedder is not None:
            text = codegraph.embedding_text(F.col("short_name"), F.col("docstring"))
            asked = known.select(F.col("id").alias("query_id"), text.alias("text")).where("text is not null")
            near = vectors.vector_search(held, asked.select("query_id", embed(F.col("text"), self.embedder).alias("vec")), codegraph.NEAREST)
            nearest = codegraph.rank_concepts(near.select(F.col("query_id").alias("symbol_id"), "concept", "score"))
        if method == "embedding_only":
            return self.spark.createDataFrame([], "symbol_id long, concept string, link_type string, score double") if nearest is None else nearest
        return codegraph.name_match(named, concepts) if nearest is None else codegraph.links(named, concepts, nearest)

    def code_table(self, name: str) -> DataFrame:
        """symbols, links, call_edges, import_edges or index_state."""
        return tables.read(self.spark, self.store, name)

    def code_search(self, query: str, repo: str | None = None, limit: int = 20) -> DataFrame:
        known = self.code_table("symbols")
        return codegraph.search_links(codegraph.code_search(known, query, repo, limit), self.code_table("links"), known)

    def code_status(self, repo: str, folder: str) -> DataFrame:
        wanted = self.spark.createDataFrame([(repo,)], "repo string")
        heads = self.spark.createDataFrame([(repo, git_head(folder))], "repo string, current_head string")
        return codegraph.index_status(wanted, self.code_table("index_state"), heads)

    def code_links(self, symbol: str | None = None, concept: str | None = None, link_type: str | None = None, repo: str | None = None, limit: int = 200) -> DataFrame:
        return codegraph.wiki_links(self.code_table("links").drop("repo"), self.code_table("symbols"), symbol, concept, link_type, repo, limit)

    def code_link_counts(self) -> DataFrame:
        return codegraph.link_counts(self.code_table("links"))

    def code_coverage(self, repo: str, exclude: tuple[str, ...] = ()) -> DataFrame:
        return codegraph.coverage(self.code_table("symbols"), self.code_table("links"), repo, exclude)

    # -- recall --------------------------------------------------------------

    def recall_hits(self, asked: DataFrame, seen: DataFrame, decision: bool = False, now: Column | None = None) -> DataFrame:
        """What to bring to mind for asked (session, text): pages over the
        threshold that the session has not seen; at a decision or an edit only
        pages about failures."""
        r = self.config.recall
        numbered = asked.select(F.xxhash64("session", "text").alias("query_id"), "session", F.left("text", F.lit(300)).alias("text"))
        found = self.hybrid(numbered.select("query_id", "text"), 15 if decision else 12, now)
        named = found.join(numbered.select(F.col("query_id").alias("nq"), "session"), F.col("query_id") == F.col("nq"))
        hits = named.select("session", F.col("concept").alias("name"), "category", "score", "section", recall_snippet(F.col("chunk")).alias("snippet"))
        return recall.pick(hits, seen, r.decision_min_score if decision else r.min_score, tuple(r.failure_categories) if decision else None, r.max_inject)


def sync_files(make: Callable[[], KnowledgeBase]) -> Callable[[DataFrame], None]:
    """For streaming.recall.sync_stream: each batch of changed files brings the
    whole store up to date, so a batch that runs twice does no harm."""

    def sync(_: DataFrame) -> None:
        base = make()
        base.embed_sections(prune=True)
        base.close()

    return sync
