"""Command line: ``python -m quarry.cli COMMAND``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from quarry import render
from quarry.models import Engine, StubEngine
from quarry.schemas import GLOB, LIMIT


def folders(index: str) -> tuple[str, str]:
    """Configuration file and data folder of a named index, after the XDG variables."""
    config = os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
    cache = os.environ.get("XDG_CACHE_HOME") or os.path.expanduser("~/.cache")
    return os.path.join(config, "quarry", f"{index}.yml"), os.path.join(cache, "quarry", index)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quarry", description="Search text collections with Spark")
    out.add_argument("--index", default="index")
    out.add_argument("-n", "--limit", type=int, default=LIMIT)
    out.add_argument("--format", choices=render.FORMATS, default="text")
    out.add_argument("--remote", help="address of a running server")
    out.add_argument("-c", "--collection")
    out.add_argument("-q", "--quiet", action="store_true")
    out.add_argument("-v", "--verbose", action="store_true")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, /, *arguments: str, aliases: tuple[str, ...] = (), **optional: str | None) -> argparse.ArgumentParser:
        own = commands.add_parser(name, aliases=list(aliases))
        for a in arguments:
            own.add_argument(a, **({"nargs": "+"} if a == "query" else {}))
        for key, default in optional.items():
            own.add_argument(f"--{key}", default=default)
        return own

    command("add", "path", name=None, glob=GLOB, context="")
    command("sync", aliases=("update", "embed"))
    for name in ("search", "vsearch", "query", "smart"):
        command(name, "query")
    command("get", "reference")
    command("multi-get", "pattern")
    command("status")
    command("mcp", http=None)
    command("context", "uri", "text")
    command("models")
    command("export", "file")
    command("import", "file")
    return out


def main(argv: list[str] | None = None, spark=None, engine: Engine | None = None) -> int:
    args = parser().parse_args(argv)
    engine = engine or StubEngine()
    config_path, root = folders(args.index)
    query = " ".join(getattr(args, "query", []))
    if args.remote and query:
        from quarry.server import remote

        tool = {"search": "search", "vsearch": "vector_search", "query": "deep_search", "smart": "research"}[args.command]
        found = json.loads(remote(args.remote, tool, {"query": query, "limit": args.limit, "collection": args.collection or ""}))
        print(render.render(found or [], args.format))
        return 0

    from pyspark.sql import SparkSession

    from quarry.operators import hybrid, lookup, search
    from quarry.server import Server
    from quarry.sources import files
    from quarry.sources.store import Store

    spark = spark or SparkSession.builder.appName("quarry").getOrCreate()
    store, config = Store(spark, root), files.load_config(config_path)
    say = (lambda *x: None) if args.quiet or not sys.stderr.isatty() else (lambda *x: print(*x, file=sys.stderr))

    def sync() -> int:
        errors = store.sync(config, engine if engine.has_embedder else None)
        for e in errors:
            print(e, file=sys.stderr)
        return 0

    def show(found) -> int:
        print(render.render([r.asDict() for r in found.orderBy("rank").collect()], args.format))
        return 0

    if args.command == "add":
        name = args.name or os.path.basename(os.path.abspath(args.path))
        entry = {"name": name, "path": os.path.abspath(args.path), "glob": args.glob, "context": args.context}
        config["collections"] = [c for c in config["collections"] if c["name"] != name] + [entry]
        files.save_config(config_path, config)
        say("indexing", name)
        return sync()
    if args.command in ("sync", "update", "embed"):
        return sync()
    if args.command == "search":
        return show(search.bm25(store.source(), query, args.collection, args.limit, stemmed=True))
    if args.command == "vsearch":
        from quarry.models import QUERY_PREFIX

        vector = engine.embed(QUERY_PREFIX + query, True)
        return show(search.vector_search(store.source(), store.read("vectors"), vector, args.collection, args.limit))
    if args.command in ("query", "smart"):
        run = hybrid.hybrid if args.command == "query" else hybrid.smart
        return show(run(store.source(), store.read("vectors"), engine, query, args.collection, args.limit, True))
    if args.command == "get":
        row = lookup.get_document(store.documents(), args.reference).first()
        print(json.dumps(row.asDict(), ensure_ascii=False) if row else "not found")
        return 0 if row else 1
    if args.command == "multi-get":
        for r in lookup.multi_get(store.documents(), args.pattern).collect():
            print(f"#{r['docid']} {r['path']} {r['title']}")
        return 0
    if args.command == "status":
        for key, value in store.status().items():
            print(f"{key}: {value}")
        return 0
    if args.command == "mcp":
        server = Server(store, engine)
        if args.http:
            host, _, port = args.http.rpartition(":")
            server.http((host or "127.0.0.1", int(port))).serve_forever()
        else:
            server.stdio(sys.stdin, sys.stdout)
        return 0
    if args.command == "context":
        config["contexts"] = [c for c in config["contexts"] if c["uri"] != args.uri] + [{"uri": args.uri, "context": args.text}]
        files.save_config(config_path, config)
        return 0
    if args.command == "models":
        print("embedder:", engine.has_embedder, "expander:", engine.has_expander, "reranker:", engine.has_reranker)
        return 0
    if args.command == "export":
        store.export(config, args.file)
        return 0
    files.save_config(config_path, store.restore(args.file))
    return 0


if __name__ == "__main__":
    sys.exit(main())
