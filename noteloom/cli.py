"""python -m noteloom.cli: the knowledge base from a shell. Results are lines
of JSON."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from noteloom.api import MOST_CODE, MOST_RESULTS, Api, Refused, number, rows
from noteloom.config import from_yaml
from noteloom.engine import KnowledgeBase
from noteloom.hooks import Hooks
from noteloom.providers import provider


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="noteloom")
    top.add_argument("--config", default="noteloom.yml")
    top.add_argument("--wiki", default="wiki")
    top.add_argument("--store", default="store")
    top.add_argument("--dimension", type=int, default=64)
    acts = top.add_subparsers(dest="act", required=True)
    acts.add_parser("ingest").add_argument("raw")
    acts.add_parser("embed").add_argument("--prune", action="store_true")
    acts.add_parser("stats")
    acts.add_parser("check")
    search = acts.add_parser("search")
    search.add_argument("query")
    search.add_argument("--hybrid", action="store_true")
    search.add_argument("--smart", action="store_true")
    search.add_argument("--limit", default="10")
    rate = acts.add_parser("eval")
    rate.add_argument("--sample", type=int, default=20)
    rate.add_argument("--top-n", type=int, default=3)
    rate.add_argument("--seed", type=int, default=0)
    serve = acts.add_parser("serve")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8000)
    code = acts.add_parser("code").add_subparsers(dest="code", required=True)
    for name in ("sync", "status", "coverage"):
        one = code.add_parser(name)
        one.add_argument("repo")
        if name != "coverage":
            one.add_argument("folder")
        if name == "sync":
            one.add_argument("--method", default="all", choices=("all", "name_only", "embedding_only"))
        one.add_argument("--exclude", action="append", default=[])
    found = code.add_parser("search")
    found.add_argument("query")
    found.add_argument("--repo")
    found.add_argument("--limit", default="20")
    hook = acts.add_parser("hook")
    hook.add_argument("moment", choices=("prefetch", "decision-point"))
    return top


def _asked(base: KnowledgeBase, text: str) -> DataFrame:
    return base.spark.createDataFrame([(1, text)], "query_id long, text string")


def act(base: KnowledgeBase, given: argparse.Namespace) -> Iterable[Any]:
    """What a command prints, value by value."""
    match given.act:
        case "ingest":
            return rows(base.ingest(given.raw))
        case "embed":
            return rows(base.embed_sections(given.prune))
        case "stats":
            return rows(base.stats())
        case "check":
            return rows(base.diagnostics())
        case "search":
            limit = number(vars(given), "limit", 10, MOST_RESULTS)
            if given.hybrid or given.smart:
                return rows(base.answers(_asked(base, given.query), limit, smart=given.smart))
            return rows(base.keyword(_asked(base, given.query), limit))
        case "eval":
            return rows(base.evaluate(given.sample, given.top_n, given.seed))
        case "serve":
            Api(base).serve(given.host, given.port)
        case "hook":
            said = Hooks(base).run(sys.stdin.read())
            wanted = said and (said[0] == "prompt") == (given.moment == "prefetch")
            return [{"moment": said[0], "text": said[1]}] if wanted else []
    match getattr(given, "code", None):
        case "sync":
            return rows(base.sync_code(given.folder, given.repo, given.method, tuple(given.exclude)))
        case "status":
            return rows(base.code_status(given.repo, given.folder))
        case "coverage":
            return rows(base.code_coverage(given.repo, tuple(given.exclude)))
        case "search":
            return rows(base.code_search(given.query, given.repo, number(vars(given), "limit", 20, MOST_CODE)))
    return []


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = parser().parse_args(argv)
    config = from_yaml(given.config)
    spark = spark or SparkSession.builder.appName("noteloom").getOrCreate()
    base = KnowledgeBase(spark, given.wiki, config, given.store, provider(config.embedding.provider, dimension=given.dimension))
    try:
        for value in act(base, given):
            print(json.dumps(value, ensure_ascii=False, default=str))
    except Refused as e:
        print(e, file=sys.stderr)
        return 2
    finally:
        base.close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
