"""Questions and answers as plain dictionaries, and an optional HTTP server."""

from __future__ import annotations

import json
from typing import Any

from .config import Settings
from .operators.search import Filters, Result, search
from .plans.jobs import load_corpus
from .rules import KOREAN, RulePack
from .sources.store import Store

EVIDENCE = ("source_type", "note_title", "published_at", "url", "chunk_text", "event_type", "event_title", "start_at", "end_at", "target_scope", "realm_scope", "limit_per_account", "policy")


def answer_text(result: Result, rules: RulePack = KOREAN) -> str:
    if not result.hits:
        return rules.answers["none"]
    if result.policy_applied == "preserve_history":
        return rules.answers["history"].format(n=len(result.hits))
    return rules.answers["latest"].format(title=result.hits[0]["note_title"])


def response(result: Result, debug: bool, rules: RulePack = KOREAN) -> dict[str, Any]:
    evidence = []
    for hit in result.hits:
        item = {name: hit[name] for name in EVIDENCE}
        evidence.append(item | {"topic_type": hit["topic_types"][0] if hit["topic_types"] else None, "score": round(hit["final_score"], 4)})
    out = {"answer": answer_text(result, rules), "evidence": evidence, "policy_applied": result.policy_applied, "total_hits": result.total_hits, "debug": None}
    if debug:
        out["debug"] = {
            "sql_hits": result.total_hits,
            "vector_hits": result.vector_hits,
            "dense_hits": result.dense_hits,
            "merged_candidates": result.merged_candidates,
            "rerank_weights": result.weights,
            "elapsed_ms": result.elapsed_ms,
        }
    return out


def checked(question: Any, top_k: Any) -> None:
    if not isinstance(question, str) or not question:
        raise ValueError("question must have a character at least")
    if top_k is not None and (isinstance(top_k, bool) or not isinstance(top_k, int) or not 1 <= top_k <= 30):
        raise ValueError("top_k must lie between 1 and 30")


class Service:
    """Answers over a store; indexes are loaded again when their version changes."""

    def __init__(self, store: Store, rules: RulePack = KOREAN, settings: Settings | None = None) -> None:
        self.store, self.rules, self.settings = store, rules, settings or Settings()

    def query(self, question: str, filters: dict | None = None, top_k: int | None = None, debug: bool = False) -> dict[str, Any]:
        checked(question, top_k)
        unknown = set(filters or {}) - {"topic_type", "date_from", "date_to"}
        if unknown:
            raise ValueError(f"unknown filters: {sorted(unknown)}")
        corpus = load_corpus(self.store, self.settings)
        return response(search(self.store.spark, corpus, question, Filters(**(filters or {})), top_k, self.rules, self.settings), debug, self.rules)

    def query_debug(self, question: str, topic_type: str | None = None, date_from: str | None = None, date_to: str | None = None, top_k: int | None = None) -> dict[str, Any]:
        return self.query(question, {"topic_type": topic_type, "date_from": date_from, "date_to": date_to}, top_k, debug=True)


def serve(service: Service, host: str = "127.0.0.1", port: int = 8000):
    """An HTTP server with ``POST /query`` and ``GET /query/debug``; call ``serve_forever`` on it."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, urlparse

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, make) -> None:
            try:
                code, body = 200, make()
            except (ValueError, TypeError, KeyError) as e:
                code, body = 422, {"detail": str(e)}
            data = json.dumps(body, ensure_ascii=False, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_POST(self) -> None:
            if urlparse(self.path).path != "/query":
                return self.send_error(404)
            payload = self.rfile.read(int(self.headers.get("Content-Length") or 0))

            def make():
                asked = json.loads(payload)
                return service.query(asked["question"], asked.get("filters"), asked.get("top_k"))

            return self._answer(make)

        def do_GET(self) -> None:
            url = urlparse(self.path)
            if url.path != "/query/debug":
                return self.send_error(404)
            given = {k: v[-1] for k, v in parse_qs(url.query).items()}

            def make():
                top_k = int(given["top_k"]) if "top_k" in given else None
                return service.query_debug(given.get("question", ""), given.get("topic_type"), given.get("date_from"), given.get("date_to"), top_k)

            return self._answer(make)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
