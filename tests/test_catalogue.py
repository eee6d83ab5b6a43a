import hashlib
import os
import random
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from quarry.operators.chunker import chunk
from quarry.plans import catalogue, chunks

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: list(v) if isinstance(v, (list, tuple)) else v
    return sorted(columns), sorted(repr([plain(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, name):
    for t in TABLES:
        duckdb.sql(f"create or replace view {t} as select * from '{SF}/{t}.parquet'")
    df = catalogue.queries()[name](spark, SF)
    sql = duckdb.sql(catalogue.oracle_sql()[name])
    assert rows(map(tuple, df.collect()), df.columns) == rows(sql.fetchall(), sql.columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_gives_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.queries()["active_collections"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(source)" in plan and "text" not in plan.split("ReadSchema")[1]
    plan = catalogue.queries()["bm25_normalized"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan or "Cross" not in plan


def test_entry_works_without_the_optional_parts(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "quarry"), tmp_path / "quarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_chunks_of_structured_texts_equal_sql():
    """Headings, fences over the limit, giant lines, blank runs and no line end at all."""
    rng = random.Random(1)
    bits = ["# Head", "## Sub", "### x", "```", "- item", "1. one", "", "---", "text " * 30, "word " * 120, "   ", "plain line here", "x" * 3900]
    docs = [(i, "\n".join(rng.choice(bits) if rng.random() < 0.6 else "word " * rng.randint(1, 60) for _ in range(rng.randint(0, 120)))) for i in range(60)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": [i for i, _ in docs], "text": [t for _, t in docs], "lang": "en", "source": "s"}))
    want = {(hashlib.sha256(t.encode()).hexdigest(), *c) for _, t in docs for c in chunk(t)}
    assert sorted(con.sql(chunks.SQL).fetchall()) == sorted(want) and len(want) > 500
