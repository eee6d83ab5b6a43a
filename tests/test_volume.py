"""What the registered searches move and write, the making of their index included."""

import os

import pytest

from quarry.plans import adapter, catalogue

SF = "/root/testdata/sf0.01"


def stages(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return [found.apply(i) for i in range(found.size())]


@pytest.mark.parametrize("name", ["bm25_porter_phrase", "research_merge", "bm25_inactive", "bm25_docid_zero", "bm25_porter", "hybrid_blend_stub", "bm25_and"])
def test_moves_and_writes_little_more_than_the_input(spark, monkeypatch, name):
    """When postings were shuffled, bm25_and came to 20 times the input at sf0.1."""
    monkeypatch.setattr(adapter, "_indexes", {})
    last = max((s.stageId() for s in stages(spark)), default=-1)
    assert catalogue.queries()[name](spark, SF).collect()
    own = [s for s in stages(spark) if s.stageId() > last]
    moved = sum(s.shuffleWriteBytes() + s.diskBytesSpilled() for s in own)
    size = os.path.getsize(f"{SF}/documents.parquet")
    assert own and moved < size and moved + sum(s.outputBytes() for s in own) < 5 * size


def test_titles_of_other_documents_are_not_moved(spark):
    """The best contents are joined before documents are gathered by content."""
    plan = catalogue.queries()["cosine_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "BroadcastHashJoin" not in plan.split("partial_min_by")[0]
