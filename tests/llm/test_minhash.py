import random
import re

import pytest

from quarry.llm import common, minhash


def brute(rows, percent=85):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if not w:
            return frozenset()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    again = True
    while again:
        again = False
        for i in sets:
            for j in sets:
                if root[i] != root[j] and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    low = min(root[i], root[j])
                    old = {root[i], root[j]}
                    root = {k: low if r in old else r for k, r in root.items()}
                    again = True
    return sorted((i, len(sets[i]), root[i], root[i] == i) for i in sets)


def corpus(seed=3, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.randint(3, 150))) for _ in range(n // 4)]
    rows = []
    for i in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i * 7, " ".join(w)))
    return rows + [(5000, None), (5001, ""), (5002, " \n "), (5003, "One two"), (5004, "one TWO"), (5005, "é É"), (5006, "É é")]


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, minhash.near_duplicates(df).collect()))


def test_matches_brute_force(spark):
    rows = corpus()
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("block", [1, 5000])
def test_blocks_match_brute_force(spark, block):
    """Groups of many blocks: copies that one pass settles, and chains whose ends differ."""
    rng = random.Random(6)
    rows = corpus(5, 80)
    text = [f"v{i}" for i in range(120)]
    rows += [(2000 + i, " ".join(text[:i] + [f"new{i}"] + text[i + 1 :])) for i in range(0, 120, 9)]
    chain = [f"c{i}" for i in range(100)]
    for i in range(12):
        rows.append((3000 + i, " ".join(chain)))
        chain[rng.randrange(5 * i, 5 * i + 5)] = f"d{i}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_duplicates(df, block=block).collect())) == brute(rows)


def test_texts_under_one_doc_id_are_judged_one_by_one(spark):
    same, unique, third = "a b c d e f g", "some words that no other row has at all", "and yet another row of words under it"
    rows = [(1, same), (5, same), (5, unique), (5, third), (9, third), (9, third)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k", "2 as n_bytes")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [(1, 1, True), (5, 1, False), (5, 5, True), (5, 5, True), (9, 5, False), (9, 5, False)]
    kept = minhash.distinct_documents(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, same), (5, third), (5, unique)]


def test_empty_repeated_and_extra(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(None, "a b", 1), (4, "a b", 2), (4, "a b", 3)], "doc_id long, text string, n_shingles int")
    assert sorted(map(tuple, minhash.near_duplicates(df).collect())) == [(4, 1, 4, True), (4, 1, 4, True)]
    long = " ".join(f"x{i}" for i in range(60000))
    assert [r[2] for r in run(spark, [(1, long), (2, long + " tail"), (3, "other words here now then")])] == [1, 1, 3]


@pytest.mark.parametrize("side, rows", [(2, 1), (4, 3)])
def test_links_survive_other_shapes(spark, side, rows):
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "q r s t u v w")], "doc_id long, text string")
    assert sorted(r.component_id for r in minhash.near_duplicates(df, side=side, rows=rows).collect()) == [1, 1, 3]


def test_nothing_that_grows_is_broadcast(spark):
    """A few files of sketches explode to 256 keys a set, which Spark does not foresee."""
    plans = lambda df: df._jdf.queryExecution().executedPlan().toString()
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") in ("10485760", "10485760b", "10MB")
    sets = minhash.sketches(docs).where("n_shingles > 0").selectExpr("doc_id as rep", "a", "b")
    edges = common.stage(minhash.candidate_links(common.stage(sets)))
    assert edges.count() > 0
    for df in (minhash.candidate_links(sets), common._minimum_step(edges, True), common._minimum_step(edges, False), minhash.distinct_documents(docs)):
        assert "Join" in plans(df) and "BroadcastHashJoin" not in plans(df)


def test_only_texts_to_be_compared_are_moved(spark, monkeypatch):
    rows = [(i, f"text {i}") for i in range(3000)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) as k", "text")
    for bits in (24, 18, 15):
        got = {r.doc_id for r in minhash.texts_of(texts, texts.where("doc_id % 10 = 0"), bits).collect()}
        assert got >= set(range(0, 3000, 10)) and len(got) <= 300 + 2700 * 300 / 2**bits * 3 + 1
    assert minhash.texts_of(texts, texts.where("false")).collect() == []
    seen = []
    monkeypatch.setattr(minhash, "texts_of", lambda t, m, f=minhash.texts_of: seen.append(f(t, m)) or seen[-1])
    rows += [(4000 + i, " ".join(f"w{j}" for j in range(80 + i % 2))) for i in range(10)]
    assert sum(not r.kept for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == 9
    assert [x.count() for x in seen] == [2]
