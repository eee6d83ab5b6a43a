import re

import corpus_pipeline
import pytest
from test_minhash import brute as near_groups
from test_packing import check_rows
from test_pii import plain

from quarry.llm import common, minhash

SF = "/root/testdata/sf0.01"
INSULTS = set("idiot clown moron worthless pathetic disgusting stupid trash loser scum".split())


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(common.stage(f(spark, out[-1], SF)))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    assert all(s.dtypes == stages[0].dtypes for s in stages[1:5])
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(stages) == 6


def test_toxic_documents_go(stages):
    before, after = texts(stages[0]), texts(stages[1])
    rude = lambda t: sum(w in INSULTS for w in re.findall(r"\w+", t.lower()))
    assert sum(rude(t) >= 2 for t in after.values()) <= 0.15 * sum(rude(t) >= 2 for t in before.values())
    clean = {r.doc_id for r in stages[0].sparkSession.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    assert len(clean - set(after)) <= 0.02 * len(clean)



def test_one_of_each_group_stays(stages):
    rows = list(texts(stages[1]).items())[:150]
    want = {i for i, _, _, kept in near_groups(rows) if kept}
    spark = stages[0].sparkSession
    docs = stages[1].where(stages[1].doc_id.isin([i for i, _ in rows]))
    assert set(texts(corpus_pipeline.drop_near_duplicates(spark, docs, SF))) == want
    assert set(texts(stages[2])) < set(texts(stages[1]))


def test_benchmark_passages_go(stages):
    bench = [r.text for r in stages[0].sparkSession.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = texts(stages[2]), texts(stages[3])
    assert {d for d, t in before.items() if any(b in t for b in bench)} == set(before) - set(after)


def test_personal_data_is_replaced(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert set(before) == set(after)
    assert not any(plain(t) for t in after.values())
    clean = [d for d, t in before.items() if not plain(t)]
    assert all(before[d] == after[d] for d in clean)
    assert all(r.n_chars == len(r.text) for r in stages[4].collect())


def test_packing(stages):
    check_rows([r.asDict() for r in stages[5].collect()], list(texts(stages[4]).items()))


def test_nulls_repeats_and_nothing(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (None, "a b", None, None, 3), (None, None, None, None, None), (2, "", "en", "s", 0), (3, "x y z", "en", "s", 5), (3, "x y z", "en", "s", 5)]
    spark.createDataFrame([(0, "q r s t u v w x y z")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for data, n in ((rows, 5), ([], 0)):
        docs = spark.createDataFrame(data, schema)
        for _, f in corpus_pipeline.STAGES:
            docs = f(spark, docs, str(tmp_path))
        assert docs.count() == n


def test_near_duplicates_gather_nothing_in_the_driver(spark, monkeypatch):
    """Each table that the stage writes, and its result, is planned without a broadcast."""
    plans, write = [], common.stage
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def stage(df, *by):
        plans.append(plan(df))
        return write(df, *by)

    monkeypatch.setattr(common, "stage", stage)
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    plans.append(plan(corpus_pipeline.drop_near_duplicates(spark, docs, "/root/testdata/sf0.001")))
    assert len(plans) > 9 and sum("SortMergeJoin" in x for x in plans) > 5
    assert not any("BroadcastHashJoin" in x for x in plans)


def test_large_groups_are_compared_without_a_broadcast(spark, monkeypatch):
    """Groups of several blocks, in several classes: right, and read from what was moved once."""
    plans, write, moved = [], common.stage, []
    plan = lambda df: df._jdf.queryExecution().toString()

    def stage(df, *by):
        plans.append(plan(df))
        moved.append({"grp", "text"} <= set(df.columns))
        return write(df, *by)

    monkeypatch.setattr(common, "stage", stage)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(words[:i] + [f"new{i}"] + words[i + 1 :])) for i in range(0, 120, 5)]
    rows += [(1000 + i, " ".join(words[i:] + [f"end{j}" for j in range(i)])) for i in range(0, 60, 12)] + [(2000, "some words that no other row has")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = minhash.distinct_documents(df, block=900)
    plans.append(plan(kept))
    want = {i for i, _, _, own in near_groups(rows) if own}
    assert {r.doc_id for r in kept.collect()} == want and 3 < len(want) < len(rows)
    assert sum(moved) == 1 and not any("Broadcast" in x for x in plans)
