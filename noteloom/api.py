"""Requests as (path, parameters) -> (status, JSON value), and a small server.

Numbers outside their bounds are refused, not cut, as are empty queries.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame

from noteloom.engine import KnowledgeBase

# Bounds of the limits.
MOST_RESULTS, MOST_CODE, MOST_LINKS = 50, 100, 1000


class Refused(ValueError):
    """Parameters that are missing or out of bounds."""


def number(given: Mapping[str, str], name: str, default: int, most: int) -> int:
    try:
        value = int(given.get(name, default))
    except ValueError as e:
        raise Refused(f"{name} is no number") from e
    if not 1 <= value <= most:
        raise Refused(f"{name} must be from 1 to {most}")
    return value


def words(given: Mapping[str, str], name: str = "q") -> str:
    if not given.get(name):
        raise Refused(f"{name} is missing")
    return given[name]


def rows(df: DataFrame) -> list[dict[str, Any]]:
    """The rows of a result that a limit of its operator bounds."""
    return [r.asDict(recursive=True) for r in df.collect()]


class Api:
    def __init__(self, base: KnowledgeBase):
        self.base, self.spark = base, base.spark
        self.routes: dict[str, Callable[[Mapping[str, str]], Any]] = {
            "/health": lambda g: {"status": "ok"},
            "/api/stats": lambda g: rows(base.stats())[0],
            "/api/diagnostics": lambda g: rows(base.diagnostics()),
            "/api/search": lambda g: rows(base.keyword(self._asked(g), number(g, "limit", 10, MOST_RESULTS))),
            "/api/hybrid_search": lambda g: self._answer(g, False),
            "/api/smart_search": lambda g: self._answer(g, True),
            "/api/concept": lambda g: rows(base.concept(self.spark.createDataFrame([(words(g, "name"),)], "asked string")))[0],
            "/api/section": lambda g: rows(base.section(self.spark.createDataFrame([(words(g, "name"), words(g, "section"))], "name string, asked string"))),
            "/api/code/search": lambda g: rows(base.code_search(words(g), g.get("repo"), number(g, "limit", 20, MOST_CODE))),
            "/api/code/wiki_links": lambda g: rows(base.code_links(g.get("symbol"), g.get("concept"), g.get("link_type"), g.get("repo"), number(g, "limit", 200, MOST_LINKS))),
            "/api/code/coverage": lambda g: rows(base.code_coverage(words(g, "repo")))[0],
            "/api/code/status": lambda g: rows(base.code_status(words(g, "repo"), g.get("path", "")))[0],
        }

    def _asked(self, given: Mapping[str, str]) -> DataFrame:
        return self.spark.createDataFrame([(1, words(given))], "query_id long, text string")

    def _answer(self, given: Mapping[str, str], smart: bool) -> dict[str, Any]:
        asked, top_k = self._asked(given), number(given, "top_k", 10, MOST_RESULTS)
        return rows(self.base.answers(asked, top_k, smart=smart).drop("query_id"))[0]

    def handle(self, path: str, given: Mapping[str, str]) -> tuple[int, Any]:
        if path not in self.routes:
            return 404, {"error": f"nothing is at {path}"}
        try:
            return 200, self.routes[path](given)
        except Refused as e:
            return 422, {"error": str(e)}
        except IndexError:
            return 404, {"error": "not found"}

    def serve(self, host: str = "127.0.0.1", port: int = 8000) -> None:
        handle = self.handle

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:
                url = urlsplit(self.path)
                status, value = handle(url.path, dict(parse_qsl(url.query)))
                body = json.dumps(value, ensure_ascii=False, default=str).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json; charset=utf-8")
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

        ThreadingHTTPServer((host, port), Handler).serve_forever()
