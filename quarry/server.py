"""JSON-RPC tool server over HTTP or standard input and output."""

from __future__ import annotations

import json
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import TextIO

from pyspark.sql import functions as F

from quarry import render
from quarry.models import QUERY_PREFIX, Engine, NoModelError, StubEngine
from quarry.operators import hybrid, lookup, search
from quarry.schemas import LIMIT, MIN_COSINE, OBSERVATIONS
from quarry.sources import files
from quarry.sources.store import Store

PROTOCOL = "2024-11-05"
_QUERY = {
    "query": {"type": "string", "description": "Words and \"quoted phrases\" that all have to occur; title:word looks in titles."},
    "limit": {"type": "integer", "description": f"How many results to give, {LIMIT} if not said."},
    "collection": {"type": "string", "description": "Look in this collection only."},
    "minScore": {"type": "number", "description": "Leave results below this score out."},
    "maxChars": {"type": "integer", "description": "Shorten the answer to so many characters."},
    "note": {"type": "string", "description": "What you conclude; kept with the best result and shown again if it goes stale."},
}
_SHORT = {"maxChars": _QUERY["maxChars"]}
_TOOLS = {
    "search": ("Ranked keyword search", _QUERY, ["query"]),
    "vector_search": ("Search by meaning", _QUERY, ["query"]),
    "deep_search": ("Expansion, fusion and reranking", _QUERY, ["query"]),
    "research": ("Keyword and vector search in one call", _QUERY, ["query"]),
    "get": ("One document by docid or path", {"ref": {"type": "string", "description": "A docid, with or without #, or a path."}, "maxLines": {"type": "integer", "description": "Give the first lines only."}, **_SHORT}, ["ref"]),
    "multi_get": ("Documents by a comma list of patterns", {"pattern": {"type": "string", "description": "Paths with * for any text, docids and paths, separated by commas."}, "maxBytes": {"type": "integer", "description": "Leave larger documents out."}, **_SHORT}, ["pattern"]),
    "status": ("State of the index", {}, []),
}
_NEED_MODEL = {"vector_search", "deep_search", "research"}


class ToolError(Exception):
    pass


class Server:
    def __init__(self, store: Store, engine: Engine | None = None, notes: str | None = None) -> None:
        self.store, self.engine = store, engine or StubEngine()
        self.notes = notes or f"{store.root}/notes.json"

    # protocol

    def dispatch(self, request: dict) -> dict:
        answer = {"jsonrpc": "2.0", "id": request.get("id")}
        method = request.get("method")
        try:
            if method == "initialize":
                result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "quarry", "version": "1"}, "instructions": self.instructions()}
            elif method == "tools/list":
                result = {"tools": self.tools()}
            elif method == "tools/call":
                params = request.get("params") or {}
                result = self.call(params.get("name"), params.get("arguments") or {})
            else:
                result = {}
        except Exception as e:  # any failure of a tool is the caller's to see
            return {**answer, "error": {"code": -1, "message": str(e)}}
        return {**answer, "result": result}

    def instructions(self) -> str:
        """What is indexed, collection by collection, and which tools fit the models there are."""
        docs = self.store.read("documents").where("active").groupBy("collection").count()
        held = {r["collection"]: r["count"] for r in docs.collect()}
        about = [(r["name"], r["context"]) for r in self.store.read("collections").orderBy("name").collect()]
        lines = [f"{sum(held.values())} documents in {len(about)} collections can be searched."]
        lines += [f"- {name}: {held.get(name, 0)} documents" + (f" ({context})" if context else "") for name, context in about]
        if self.engine.has_embedder:
            lines.append("Begin with research, which looks for words and for meaning at once; search is for exact words, vector_search for meaning.")
            if self.engine.has_expander and self.engine.has_reranker:
                lines.append("deep_search ranks best and takes longest.")
        else:
            lines.append("No embedding model is there, so only search, by words, finds documents.")
        lines.append("get and multi_get look documents up; status tells how far the index is.")
        return "\n".join(lines)

    def tools(self) -> list[dict]:
        return [
            {"name": name, "description": what, "inputSchema": {"type": "object", "properties": properties, "required": required}}
            for name, (what, properties, required) in _TOOLS.items()
            if name not in _NEED_MODEL or self.engine.has_embedder
        ]

    def call(self, name: str, args: dict) -> dict:
        run = {"search": self._search, "vector_search": self._vector, "deep_search": self._deep, "research": self._research, "get": self._get, "multi_get": self._multi_get, "status": self._status}.get(name)
        if run is None:
            raise ToolError(f"unknown tool: {name}")
        value = run(args)
        out = render.envelope(value)
        out["content"][0]["text"] = render.shorten(out["content"][0]["text"], int(args.get("maxChars") or 0))
        return out

    # tools

    @staticmethod
    def _common(args: dict) -> tuple[str, str | None, int]:
        return args.get("query") or "", args.get("collection") or None, int(args.get("limit") or 0) or LIMIT

    def _finish(self, found, args: dict, least: float | None = None) -> list[dict] | None:
        least = float(args.get("minScore") or 0) if least is None else least
        if least > 0:
            found = found.where(F.col("score") >= least)
        rows = [{k: v for k, v in r.asDict().items() if k != "rank"} for r in found.orderBy("rank").collect()]
        if args.get("note") and rows:
            top = rows[0]
            full = lookup.get_document(self.store.documents(), top["docid"]).first()
            files.save_note(self.notes, {"docid": top["docid"], "path": top["path"], "hash": full["hash"] if full else "", "note": args["note"], "timestamp": str(int(time.time()))})
        return rows or None

    def _search(self, args: dict):
        query, collection, limit = self._common(args)
        return self._finish(hybrid.keyword(self.store.source(), query, collection, limit, True), args)

    def _vector(self, args: dict):
        query, collection, limit = self._common(args)
        vector = self.engine.embed(QUERY_PREFIX + query, True)
        found = search.vector_search(self.store.source(), self.store.read("vectors"), vector, collection, limit)
        return self._finish(found, args, float(args.get("minScore") or 0) or MIN_COSINE)

    def _deep(self, args: dict):
        query, collection, limit = self._common(args)
        return self._finish(hybrid.hybrid(self.store.source(), self.store.read("vectors"), self.engine, query, collection, limit, True), args)

    def stale(self):
        notes = files.load_notes(self.notes)
        rows = [tuple(n.get(c) for c in ("docid", "path", "hash", "note", "timestamp")) + (i,) for i, n in enumerate(notes)]
        table = self.store.spark.createDataFrame(rows, OBSERVATIONS + ", ord int")
        return lookup.stale_notes(table, self.store.documents())

    def _research(self, args: dict):
        query, collection, limit = self._common(args)
        try:
            vector = self.engine.embed(QUERY_PREFIX + query, True)
        except NoModelError:
            vector = None
        found = hybrid.research(self.store.source(), self.store.read("vectors"), query, vector, collection, limit, float(args.get("minScore") or 0), True)
        return self._finish(lookup.attach_notes(found, self.stale()), args, 0)

    def _get(self, args: dict):
        row = lookup.get_document(self.store.documents(), args.get("ref") or "").first()
        if row is None:
            raise ToolError(f"document not found: {args.get('ref')}")
        return row.asDict()

    def _multi_get(self, args: dict):
        rows = lookup.multi_get(self.store.documents(), args.get("pattern") or "").collect()
        return [{k: v for k, v in r.asDict().items() if k != "ord"} for r in rows] or None

    def _status(self, args: dict):
        s = self.store.status()
        return {"collections": s["collections"], "documents": s["documents"], "chunks": s["chunks"], "needsEmbedding": s["needs_embedding"], "hasVectorIndex": s["has_vector_index"], "staleObservations": self.stale().count()}

    def health(self) -> dict:
        return {"status": "ok", **{t: self.store.read(t).count() for t in ("collections", "documents", "vectors")}}

    # transports

    def stdio(self, source: TextIO, sink: TextIO) -> None:
        """One JSON request after another until the end of input."""
        decoder, held = json.JSONDecoder(), ""
        for line in source:
            held += line
            while held.strip():
                try:
                    request, end = decoder.raw_decode(held := held.lstrip())
                except ValueError:
                    break
                held = held[end:]
                sink.write(json.dumps(self.dispatch(request)) + "\n")
                sink.flush()

    def http(self, address: tuple[str, int]) -> ThreadingHTTPServer:
        server = self

        class Handler(BaseHTTPRequestHandler):
            def answer(self, code: int, value: dict) -> None:
                data = json.dumps(value).encode()
                self.send_response(code)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def do_GET(self) -> None:
                self.answer(200, server.health()) if self.path == "/health" else self.answer(404, {"error": "not found"})

            def do_POST(self) -> None:
                try:
                    request = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
                except ValueError:
                    return self.answer(400, {"error": "invalid JSON"})
                self.answer(200, server.dispatch(request)) if self.path == "/mcp" else self.answer(404, {"error": "not found"})

            def log_message(self, *args) -> None:
                pass

        return ThreadingHTTPServer(address, Handler)


def remote(address: str, tool: str, arguments: dict) -> str:
    """Call a tool of another server and return its text."""
    from urllib.request import Request, urlopen

    address = address if "://" in address else f"http://{address}"
    address = address if address.rstrip("/").endswith("/mcp") else address.rstrip("/") + "/mcp"
    body = {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": tool, "arguments": arguments}}
    with urlopen(Request(address, json.dumps(body).encode(), {"Content-Type": "application/json"})) as f:
        answer = json.load(f)
    if "error" in answer:
        raise ToolError(answer["error"]["message"])
    return answer["result"]["content"][0]["text"]
