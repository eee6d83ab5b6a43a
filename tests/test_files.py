import io
import json
import os
import urllib.request
from threading import Thread

import pytest
from pyspark.sql import functions as F

from quarry import cli, render
from quarry.functions import text, vectors
from quarry.models import HashingEngine
from quarry.operators.chunker import chunk
from quarry.operators import index
from quarry.operators.index import Index
from quarry.operators.query import parse
from quarry.server import Server, remote
from quarry.sources import files
from quarry.sources.store import Store
from quarry.streaming.ingest import watch


def put(root, name, data):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


@pytest.fixture
def folder(tmp_path):
    root = str(tmp_path / "notes")
    put(root, "a.md", "# Alpha\n\nalpha beta gamma")
    put(root, "sub/b.md", "beta only\r\n# Title B\r\nmore")
    put(root, ".dot.md", "dot file")
    put(root, "_u.md", "underscore")
    put(root, "c.txt", "not taken")
    put(root, "node_modules/n.md", "skipped")
    put(root, ".hid/h.md", "skipped")
    put(root, "bin511.md", b"x" * 511 + b"\0")
    put(root, "bin512.md", b"x" * 512 + b"\0")
    put(root, "big.md", b"y" * (1 << 20))
    put(root, "bigger.md", b"y" * ((1 << 20) + 1))
    return root


def test_scan_rules(spark, folder, tmp_path):
    got = {r["path"]: r for r in files.scan(spark, folder, "n").collect()}
    assert set(got) == {"a.md", "sub/b.md", ".dot.md", "_u.md", "bin512.md", "big.md"}
    assert (got["a.md"]["title"], got["sub/b.md"]["title"], got["_u.md"]["title"]) == ("Alpha", "Title B", "_u")
    assert got["big.md"]["doc_len"] == 1 << 18
    put(str(tmp_path), "build/x.md", "x")
    assert list(files.walk(str(tmp_path / "build"))) == []
    store = {r["path"] for r in files.scan_store(spark, folder, "n").collect()}
    assert store == set(got) - {".dot.md", "_u.md"}


def test_globs():
    assert text.expand_glob("**/*.{go, py}") == ["*.go", "*.py"] and text.expand_glob("*.{a,b") == ["*.{a,b"]
    assert text.matches_glob("d/x.py", "**/*.{go,py}") and not text.matches_glob("d/x.PY", "*.py")
    assert text.matches_glob("docs/x.md", "docs/*.md") and not text.matches_glob("docs/s/x.md", "docs/*.md")
    assert text.matches_glob("docs/s/x.md", "docs/**/*.md") and not text.matches_glob("docs/x.md", "docs/**/*.md")


def test_titles(spark):
    rows = [("# A", "x.md"), ("#A", "d/x.y.md"), ("#\n\nB", "x"), ("a\r\n# C \r\n", "x"), ("", ".md")]
    df = spark.createDataFrame(rows, "c string, p string")
    assert [r[0] for r in df.select(text.title(F.col("c"), F.col("p"))).collect()] == ["A", "x.y", "B", "C", ".md"]


def test_break_scores(spark):
    lines = ["# a", "## a", "### a", "```x", "#### a", "##### a", "---", "***", "###### a", "", "  ", "- a", "* a", "12. a", "12.a", "text", "\t# t"]
    want = [100, 90, 80, 80, 70, 60, 60, 60, 50, 20, 20, 5, 5, 5, 1, 1, 100]
    assert [text.break_score(x) for x in lines] == want
    df = spark.createDataFrame([(x,) for x in lines], "l string")
    assert [r[0] for r in df.select(text.break_score_column(F.col("l"))).collect()] == want


def test_chunker():
    assert chunk("") == [] and [c.text for c in chunk("one line")] == ["one line"]
    giant = chunk("x" * 10_000)
    assert giant[0] == (0, 0, "x" * 10_000)
    body = "\n".join(f"line {i} " + "w" * 60 for i in range(200))
    parts = chunk(body)
    assert len(parts) > 3 and [c.seq for c in parts] == list(range(len(parts)))
    assert all(a.pos < b.pos for a, b in zip(parts, parts[1:]))
    head = chunk("\n".join(["w" * 80] * 30 + ["## Section"] + ["w" * 80] * 30))
    assert head[1].text.split("## Section")[0].count("w" * 80) <= 7
    fence = "```\n" + "\n".join(["code " * 16] * 100) + "\n```"
    assert chunk(fence)[0].text == fence


def test_vector_codec(spark):
    df = spark.createDataFrame([([1.0, -2.5, 3e-8],), ([],), (None,)], "v array<float>")
    assert [r[0] for r in df.select(vectors.unpack(vectors.pack("v"))).collect()] == [r[0] for r in df.collect()]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0, 0.0]


def test_render():
    rows = [{"docid": "abc", "path": "a,b.md", "title": "T", "context": "c", "score": 0.12345}]
    assert render.render(rows, "csv") == "docid,score,path,context\nabc,0.1235,a,b.md,c" or render.render(rows, "csv").endswith("a,b.md,c")
    assert json.loads(render.render(rows, "json"))[0]["docid"] == "abc"
    assert render.render(rows, "files") == "a,b.md" and "T" in render.render(rows) and "T" in render.render(rows, "md")
    assert [render.render([], f).endswith("no results") for f in render.FORMATS] == [True] * 5
    assert render.shorten("é" * 10, 3).startswith("é") and "truncated to 3" in render.shorten("é" * 10, 3) and render.shorten("ab", 0) == "ab"


def test_store_from_scan_to_bundle(spark, folder, tmp_path):
    store, engine = Store(spark, str(tmp_path / "index")), HashingEngine(16)
    config = {"collections": [{"name": "n", "path": folder}, {"name": "missing", "path": str(tmp_path / "none")}], "contexts": []}
    config["collections"][0]["context"] = "my notes"
    assert len(store.sync(config, engine)) <= 1
    s = store.status()
    assert s["documents"] == 6 and s["needs_embedding"] == 0 and s["has_vector_index"]
    put(folder, "a.md", "# Alpha two\n\nalpha changed")
    os.remove(os.path.join(folder, "_u.md"))
    store.sync(config, engine)
    docs = {r["path"]: r for r in store.documents().collect()}
    assert docs["a.md"]["title"] == "Alpha two" and docs["a.md"]["active"] and not docs["_u.md"]["active"]
    assert docs["a.md"]["context"] == "my notes"
    put(folder, "_u.md", "underscore")
    store.sync(config)
    assert not {r["path"]: r for r in store.documents().collect()}["_u.md"]["active"]
    built = store.source()
    assert isinstance(built, Index)
    found = {r["field"]: r["hits"] for r in index.hits(built.stems, parse("alpha", True)[0]).collect()}
    assert found == {"title": 1, "content": 2}
    store.upsert_collection("n", folder, context="my notes")
    assert not isinstance(store.source(), Index)
    store.build_index()
    assert isinstance(store.source(), Index) and len(store._versions("documents")) == 2
    store.export(config, str(tmp_path / "x.tar.gz"))
    other = Store(spark, str(tmp_path / "other"))
    assert other.restore(str(tmp_path / "x.tar.gz"))["collections"][0]["path"] == "notes"
    assert other.status() == store.status()

    server = Server(store, engine)
    ask = lambda m, **p: server.dispatch({"id": 1, "method": m, "params": p})
    tool = lambda n, **a: ask("tools/call", name=n, arguments=a)
    assert len(ask("tools/list")["result"]["tools"]) == 7 and len(Server(store).tools()) == 4
    assert ask("other")["result"] == {} and ask("initialize")["result"]["instructions"]
    found = json.loads(tool("search", query="alpha", note="look")["result"]["content"][0]["text"])
    assert found[0]["path"] == "a.md"
    assert tool("search", query="nosuchword")["result"]["content"][0]["text"] == "null"
    assert tool("search", query="AND")["error"]["code"] == -1 and tool("nope")["error"]["code"] == -1
    for name in ("vector_search", "deep_search", "research"):
        assert json.loads(tool(name, query="alpha changed")["result"]["content"][0]["text"])
    assert json.loads(tool("get", ref="a.md")["result"]["content"][0]["text"])["hash"] == docs["a.md"]["hash"]
    assert len(json.loads(tool("multi_get", pattern="*.md")["result"]["content"][0]["text"])) == 5
    put(folder, "a.md", "edited once more")
    store.sync(config)
    assert json.loads(tool("status")["result"]["content"][0]["text"])["staleObservations"] == 1
    out = io.StringIO()
    server.stdio(io.StringIO('{"id": 1, "method": "x"}{"id":\n 2, "method": "y"}'), out)
    assert [json.loads(x)["id"] for x in out.getvalue().splitlines()] == [1, 2]
    http = server.http(("127.0.0.1", 0))
    Thread(target=http.serve_forever, daemon=True).start()
    address = f"127.0.0.1:{http.server_address[1]}"
    assert json.load(urllib.request.urlopen(f"http://{address}/health"))["documents"] == 6
    assert json.loads(remote(address, "search", {"query": "beta"}))[0]["path"] == "sub/b.md"
    http.shutdown()


def test_command_line(spark, folder, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "conf"))
    monkeypatch.setenv("XDG_CACHE_HOME", str(tmp_path / "cache"))
    run = lambda *a: (cli.main(list(a), spark), capsys.readouterr().out)
    assert run("add", folder, "--name", "n")[0] == 0
    assert run("--format", "files", "search", "alpha")[1] == "a.md\n"
    assert "no results" in run("search", "zzz")[1]
    assert run("get", "a.md")[0] == 0 and run("get", "zz")[0] == 1
    assert "documents: 6" in run("status")[1] and "sub/b.md" in run("multi-get", "sub*")[1]
    assert run("context", "uri", "words")[0] == 0 and run("models")[0] == 0
    assert run("export", str(tmp_path / "b.tgz"))[0] == 0 and run("--index", "two", "import", str(tmp_path / "b.tgz"))[0] == 0
    assert run("--index", "two", "--format", "files", "search", "alpha")[1] == "a.md\n"


def test_streaming_ingest(spark, tmp_path):
    root = str(tmp_path / "in")
    put(root, "one.md", "# One\nfirst")
    store = Store(spark, str(tmp_path / "index"))
    query = watch(spark, store, root, "live", str(tmp_path / "check"))
    query.processAllAvailable()
    put(root, "two.md", "# Two\nsecond")
    query.processAllAvailable()
    query.stop()
    assert sorted(r["title"] for r in store.documents().collect()) == ["One", "Two"]
