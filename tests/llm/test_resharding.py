import itertools
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.llm import queries, resharding


@pytest.mark.parametrize("seed", range(5))
def test_flow_moves_the_fewest_bytes(seed):
    rng = random.Random(seed)
    old = [rng.randint(0, 50) for _ in range(5)]
    total = sum(old)
    new = [total // 7 + (j < total % 7) for j in range(7)]
    moves = resharding.transfers(old, new)
    for i, n in enumerate(old):
        assert sum(b for a, _, b in moves if a == i) == n
    for j, n in enumerate(new):
        assert sum(b for _, c, b in moves if c == j) == n
    assert sum(b for a, c, b in moves if a != c) == sum(max(0, n - new[i]) for i, n in enumerate(old))


def test_flow_with_prices_against_enumeration():
    supply, demand, cost = [2, 3], [2, 2, 2], [[3, 1, 4], [1, 5, 2]]
    best = min(
        sum(x[i][j] * cost[i][j] for i in range(2) for j in range(3))
        for flat in itertools.product(range(4), repeat=6)
        for x in [[flat[:3], flat[3:]]]
        if [sum(r) for r in x] == supply and all(x[0][j] + x[1][j] <= demand[j] for j in range(3))
    )
    assert sum(b * cost[i][j] for i, j, b in resharding.min_cost_flow(supply, demand, cost)) == best
    with pytest.raises(ValueError):
        resharding.min_cost_flow([3], [2], [[0]])


def test_registered_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op7_min_cost_flow_sharding(spark, sf).collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(docs))
    size, slots = Counter(), {}
    for r in rows:
        data = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        size[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(size.values()) / 40
    assert set(size) == set(range(40)) and max(abs(n - mean) for n in size.values()) < 0.1 * mean


def test_nulls_repeats_and_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (1, None), (None, "é"), (2, ""), (3, "x" * 9000)], "doc_id long, text string").selectExpr("*", "7 as shard", "8 as size")
    placed, moves = resharding.reshard(df, F.lit(0), new_shards=2, old_shards=2)
    rows = placed.collect()
    assert len(rows) == 5 and Counter(r.doc_id for r in rows) == {1: 2, None: 1, 2: 1, 3: 1}
    assert resharding.rewrite(placed, moves, str(tmp_path / "out")) == [0, 1]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    placed, _ = resharding.reshard(df.where("false"), F.lit(0))
    assert placed.collect() == []


def test_placement_by_a_plain_walk(spark):
    """The documents of an old shard stand by size class and part; each goes where its middle
    byte goes, and slots count on in that order."""
    rng = random.Random(3)
    rows = [(i, "x" * rng.choice([0, 5, 40, 700, 5000]) + str(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    placed, moves = resharding.reshard(df, F.col("doc_id") % 3, new_shards=5, old_shards=3, least_part=1000)
    got = placed.withColumn("part", F.spark_partition_id()).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    took = Counter()
    for r in got:
        assert r.size == len(rows[r.doc_id][1]) + 16 and r.old_shard == r.doc_id % 3
        took[r.old_shard, r.shard] += r.size
    largest = max(len(t) for _, t in rows) + 16
    want = Counter({(a, b): n for a, b, n in moves})
    assert all(abs(took[k] - want[k]) <= 2 * largest for k in set(took) | set(want))
    for shard in range(5):
        own = sorted((r.slot, r.old_shard, -r.size) for r in got if r.shard == shard)
        assert [s for s, _, _ in own] == list(range(len(own)))
        assert [(o, (-n).bit_length()) for _, o, n in own] == sorted(((o, (-n).bit_length()) for _, o, n in own), key=lambda x: (x[0], -x[1]))
