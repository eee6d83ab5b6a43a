import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.models import HashingEngine, StubEngine, WorkerEngine, clip_words, yes_probability
from quarry.operators import hybrid, index, lookup, search
from quarry.operators.query import Phrase, QuerySyntaxError, expansions, parse

SCHEMA = "id long, collection string, path string, title string, docid string, hash string, active boolean, doc_len long, content string, context string"


def table(spark, rows):
    """rows: (id, collection, title, content, active)"""
    df = spark.createDataFrame(rows, "id long, collection string, title string, content string, active boolean")
    h = text.content_hash(F.col("content"))
    return df.select("id", "collection", F.concat(F.lit("p"), "id").alias("path"), "title", text.docid(h).alias("docid"), h.alias("hash"), "active", text.token_estimate(F.col("content")).alias("doc_len"), "content", F.lit("").alias("context"))


def corpus(n=60, seed=0):
    rng = random.Random(seed)
    words = "deploy deployment deployed deploying running runner ran alpha beta gamma connect connected connection flies fly happy happily relational école ÉCOLE straße".split()
    return [(i, rng.choice(["a", "b", "c"]), " ".join(rng.choices(words, k=3)), " ".join(rng.choices(words, k=rng.randint(4, 60))), rng.random() < 0.8) for i in range(n)]


def fts(rows, query, tokenizer):
    con = sqlite3.connect(":memory:")
    con.execute(f"create virtual table f using fts5(title, content, docid, content='', tokenize='{tokenizer}')")
    import hashlib

    for i, _, title, content, _ in rows:
        con.execute("insert into f(rowid, title, content, docid) values (?,?,?,?)", (i, title, content, hashlib.sha256(content.encode()).hexdigest()[:6]))
    return {i: -s for i, s in con.execute("select rowid, bm25(f, 5.0, 1.0, 0.0) from f where f match ?", (query,))}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """The index of the corpus, terms over several files."""
    path = str(tmp_path_factory.mktemp("index"))
    index.build(table(spark, corpus()), path)
    return index.load(spark, path)


@pytest.mark.parametrize("stemmed", [False, True])
@pytest.mark.parametrize(
    "query, match",
    [
        ("deploy", "deploy*"),
        ("alpha beta", "alpha* AND beta*"),
        ('"alpha beta"', '"alpha beta"'),
        ('alpha "gamma"', 'alpha* AND "gamma"'),
        ("title:run", "title:run*"),
        ("^alpha", "^alpha*"),
        ("alpha+be", "alpha+be*"),
        ("connection ecole", "connection* AND ecole*"),
    ],
)
def test_scores_equal_sqlite(spark, built, stemmed, query, match):
    rows = corpus()
    want = fts(rows, match, "porter unicode61" if stemmed else "unicode61")
    active = {r[0] for r in rows if r[4]}
    got = {r["path"]: r["score"] for r in search.bm25(table(spark, rows), query, limit=1000, corrected=False, stemmed=stemmed).collect()}
    want = pytest.approx({f"p{i}": s for i, s in want.items() if i in active}, rel=1e-9)
    assert got == want
    assert {r["path"]: r["score"] for r in search.bm25(built, query, limit=1000, corrected=False, stemmed=stemmed).collect()} == want


def test_index_ranks_as_the_documents_do(spark, built):
    """Ties at the limit, collections, no result, a term that is not there, no documents."""
    docs = table(spark, corpus())
    for query, limit in (("alpha", 3), ("beta gamma", 100), ("alpha zzz", 2)):
        assert search.bm25(built, query, None, limit).collect() == search.bm25(docs, query, None, limit).collect()
        assert search.bm25_normalized(built, query, limit).collect() == search.bm25_normalized(docs, query, limit).collect()
    assert search.bm25(built, "docid:a", "b", 5).collect() == search.bm25(docs, "docid:a", "b", 5).collect()
    copies = table(spark, [(i, "a", "same", "alpha text", True) for i in range(9)])
    path = spark.conf.get("spark.checkpoint.dir") + "/copies"
    index.build(copies, path)
    assert search.bm25(index.load(spark, path), "alpha", None, 4).collect() == search.bm25(copies, "alpha", None, 4).collect()
    index.build(copies.where("false"), path)
    assert search.bm25(index.load(spark, path), "alpha", stemmed=True).collect() == []


def test_a_query_reads_the_postings_of_its_terms_only(built):
    plan = search.bm25(built, "alpha", limit=5)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,alpha)" in plan and "content:string" not in plan


def test_stems_equal_sqlite():
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(t, tokenize='porter unicode61')")
    con.execute("create virtual table v using fts5vocab(f, instance)")
    bits = "relate national condition rational valency hesitancy digitizer conform radical different vile analogous vietnam predicate operator feudal decisive hopeful callous formal sensitive sensible triplicate formative formalize electric electrical hopeful goodness revival allowance inference airliner gyroscopic adjust defensible irritant replacement adjustment dependent adoption homolog communism activate angular homologous effective bowdlerize probate rate cease control roll sky happy feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing caresses ponies ties caress cats yes by as".split()
    rng = random.Random(3)
    words = {b + e for b in bits for e in ("", "s", "ed", "ing", "ational", "ization", "ness", "ly", "y", "fully", "iveness", "ies")} | {"".join(rng.choices("aeioustlyrn", k=rng.randint(2, 11))) for _ in range(1500)}
    for i, w in enumerate(sorted(words)):
        con.execute("insert into f(rowid, t) values (?, ?)", (i, w))
    got = dict(con.execute("select doc, term from v"))
    assert {w: got[i] for i, w in enumerate(sorted(words))} == {w: text.stem(w) for w in sorted(words)}


def test_parser():
    assert parse("a b") == [Phrase(("a",), True), Phrase(("b",), True)]
    assert parse('"a b" "c"') == [Phrase(("a", "b")), Phrase(("c",))]
    assert parse("'a' title:x") == [Phrase(("a",), True), Phrase(("x",), True, "title")]
    assert parse('"a b') == [Phrase(("a",), True), Phrase(("b",), True)]
    assert parse('""') == [Phrase(())]
    for bad in ("", "AND", "foo-bar", "foo:bar", ".", "a/b", "*"):
        with pytest.raises(QuerySyntaxError):
            parse(bad)


def test_expansions():
    assert expansions("1. foo\n2. bar", "q") == [("foo", "lex"), ("bar", "vec")]
    assert expansions("lex: x\nq\n\nvec: y\nz", "q") == [("x", "lex"), ("y", "vec")]
    assert expansions("", "q") == [("q", "lex"), ("q", "vec")]
    assert expansions("- one", "q") == [("one", "lex"), ("q", "vec")]


def test_length_factor(spark):
    got = [r[0] for r in spark.createDataFrame([(0,), (50,), (100,), (200,), (400,)], "n long").select(search.length_factor(F.col("n"), 100)).collect()]
    assert got == pytest.approx([1, 1.16, 1, 0.8857142857, 0.8153846154])


def test_limit_precedes_correction_and_inactive_rows_count(spark):
    rows = [(i, "a", "t", "word " * (i + 1), True) for i in range(6)]
    docs = table(spark, rows)
    top = [r["path"] for r in search.bm25(docs, "word", limit=2, corrected=False).collect()]
    assert sorted(r["path"] for r in search.bm25(docs, "word", limit=2).collect()) == sorted(top)
    more = table(spark, rows + [(9, "a", "t", "other", False)])
    a, b = (search.bm25(d, "word", limit=1, corrected=False).first()["score"] for d in (docs, more))
    assert a != b


def test_normalized_adds_up_copies(spark):
    rows = [(1, "a", "x", "alpha one", True), (2, "b", "x", "alpha one", True), (3, "b", "x", "alpha two", True), (4, "c", "y", "nothing", False)]
    got = {r["path"]: r["score"] for r in search.bm25_normalized(table(spark, rows), "alpha").collect()}
    assert got["p1"] > got["p3"] and len(got) == 2
    alone = search.bm25_normalized(table(spark, rows[:1]), "alpha").first()["score"]
    assert alone != pytest.approx(1 / 61)


def test_order_and_partitions_do_not_matter(spark):
    rows = corpus()
    a = search.bm25_normalized(table(spark, rows), "alpha").collect()
    b = search.bm25_normalized(table(spark, rows[::-1]).repartition(7), "alpha").collect()
    assert a == b


def test_vectors(spark):
    docs = table(spark, [(i, "a" if i < 3 else "b", f"t{i}", f"text {i}", i != 2) for i in range(5)])
    h = {r["id"]: r["hash"] for r in docs.collect()}
    chunks = spark.createDataFrame(
        [(h[0], 0, [1.0, 0.0]), (h[0], 1, [0.6, 0.8]), (h[1], 0, [0.0, 0.0]), (h[2], 0, [1.0, 0.1]), (h[3], 0, [-1.0, 0.0]), (h[4], 0, [0.1, 1.0]), (h[4], 1, None), (h[4], 2, [1.0])],
        "hash string, seq int, vec array<float>",
    )
    got = [(r["path"], round(r["score"], 4)) for r in search.vector_search(docs, chunks, [1.0, 0.0]).orderBy("rank").collect()]
    assert got == [("p0", 1.0), ("p4", 0.0995)]
    assert [r["path"] for r in search.vector_search(docs, chunks, [1.0, 0.0], limit=2).collect()] == ["p0"]
    assert [r["path"] for r in search.vector_search(docs, chunks, [1.0, 0.0], "b").collect()] == ["p4"]
    assert [r["path"] for r in search.vector_search(docs, chunks, [1.0, 0.0], min_score=0.3).collect()] == ["p0"]
    assert search.vector_search(docs, chunks, [0.0, 0.0]).collect() == []
    assert lookup.unembedded(docs, chunks.where("vec is null")).count() == 4
    centre = search.centroid(docs, chunks, [r["docid"] for r in docs.where("id in (0)").collect()])
    assert centre == pytest.approx([0.894427, 0.447214], abs=1e-5)


def test_constant_reranker_lifts_the_tail(spark):
    one = spark.createDataFrame([(i, f"d{i:02d}", f"p{i}", "t", "", 1.0) for i in range(20)], "rank int, docid string, path string, title string, context string, score double")
    fused = hybrid.weighted_fusion([(one, 2.0), (one, 2.0), (one, 1.0), (one, 1.0)])
    scores = spark.createDataFrame([(f"d{i:02d}", 0.5) for i in range(20)], "docid string, rerank double")
    got = [int(r["docid"][1:]) for r in hybrid.blend(fused, scores, 20).orderBy("rank").collect()]
    assert got == [0, *range(10, 20), *range(1, 10)]


def test_hybrid_feedback_and_smart(spark):
    rows = corpus(30)
    docs, engine = table(spark, rows), HashingEngine(16)
    chunks = spark.createDataFrame([(r["hash"], 0, engine.embed(r["content"], False)) for r in docs.collect()], "hash string, seq int, vec array<float>")
    assert hybrid.hybrid(docs, chunks, engine, "alpha").count() == 10
    assert hybrid.hybrid(docs, chunks, StubEngine(), "alpha").count() == 10
    assert hybrid.hybrid(docs, chunks, StubEngine(), "foo-bar").count() == 0
    assert hybrid.feedback(docs, chunks, "alpha", None, 5).count() == 5
    assert hybrid.feedback(docs, chunks.where("false"), "alpha", None, 5).count() == 5
    assert hybrid.smart(docs, chunks, engine, "alpha", None, 5).count() == 5
    assert hybrid.smart(docs, chunks, StubEngine(), "alpha", "a", 2).count() == 2
    assert hybrid.research(docs, chunks, "foo-bar", engine.embed("alpha", True)).count() == 10
    assert yes_probability(2, 2) == 0.5


def test_lookups(spark):
    docs = table(spark, [(1, "a", "t", "x", True), (2, "a", "t", "y", False), (3, "b", "t", "x", True)])
    d = docs.first()["docid"]
    assert lookup.get_document(docs, "#" + d).first()["path"] == "p1"
    assert lookup.get_document(docs, "p2").count() == 0
    assert [(r["ord"], r["path"]) for r in lookup.multi_get(docs, "P*, p3,, zz").collect()] == [(0, "p1"), (0, "p3"), (1, "p3")]
    notes = spark.createDataFrame([(d, "p1", "old", "n1", "0"), ("zzz", "p9", "h", "n2", "0"), (d, "p1", docs.first()["hash"], "n3", "0")], "docid string, path string, hash string, note string, timestamp string")
    stale = lookup.stale_notes(notes, docs)
    assert sorted(r["note"] for r in stale.collect()) == ["n1", "n2"]
    shown = lookup.attach_notes(docs.select("docid", "context"), stale)
    assert {r["context"] for r in shown.collect()} == {"", " [STALE observation: n1]"}
    assert lookup.has_chunks(spark.createDataFrame([("h",)], "hash string"), "h")


def test_merge_keeps_restored_files_inactive(spark):
    schema = "id long, collection string, path string, hash string, active boolean"
    old = spark.createDataFrame([(1, "a", "same", "h1", True), (2, "a", "gone", "h2", True), (3, "a", "back", "h3", False), (4, "a", "edit", "h4", False)], schema)
    scan = spark.createDataFrame([("a", "same", "h1"), ("a", "back", "h3"), ("a", "edit", "h5"), ("a", "new", "h6")], "collection string, path string, hash string")
    got = {r["path"]: (r["hash"], r["active"]) for r in lookup.merge(old, scan).collect()}
    assert got == {"same": ("h1", True), "gone": ("h2", False), "back": ("h3", False), "edit": ("h5", True), "new": ("h6", True)}
    assert {r["path"]: r["active"] for r in lookup.merge(old, scan, compat=False).collect()}["back"]
    assert {r["path"]: r["status"] for r in lookup.change_status(old, scan).collect()} == {"same": "unchanged", "gone": "missing", "back": "unchanged", "edit": "changed", "new": "new"}


def test_snippets(spark):
    rows = [(1, "a", "t", "x " * 300 + "Here Alpha  stands\nstill. " + "y " * 300, True), (2, "a", "alpha", "nothing of it", True), (3, "a", "alpha", "", True)]
    docs = table(spark, rows)
    found = search.with_snippets(search.bm25(docs, "alpha"), docs, "alpha", 80)
    got = {r["path"]: r["snippet"] for r in found.collect()}
    assert "Here Alpha stands still." in got["p1"] and len(got["p1"]) <= 80 and got["p2"] == "nothing of it" and got["p3"] == ""


def test_worker_engine():
    made = []

    class Own(HashingEngine):
        def __init__(self):
            super().__init__(8)
            made.append(1)

        def clip(self, words, n):
            return words[:n]

    engine = WorkerEngine(Own, idle=1000, max_tokens=3)
    assert engine.embed("abcdef", False) == Own().embed("abc", False) and engine.embed("abc", True) and len(made) == 2
    engine.idle = -1
    engine.embed("x", False)
    engine.embed("x", False)
    assert len(made) == 3
    assert clip_words("a b  c d", 3) == "a b  c" and clip_words("a", 3) == "a"
