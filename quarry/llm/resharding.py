"""Resharding by minimum-cost flow.

Old shards supply the bytes they hold, new shards demand their capacity; a byte costs
nothing where it stays and one where it moves. The flow gives block transfers between
shards. Within an old shard documents stand in order of size class, large ones first, so
that the cuts between blocks fall on small documents; a document belongs to the block
that holds its middle byte. Running positions come from sums over (shard, class, part),
of which the driver holds one number each, and from a window inside a part. Classes are
dealt to parts of about an eighth of a task's share of all bytes, so no task sees a whole
shard, and tasks are alike in size.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

OVERHEAD = 16
OLD_SHARDS = 32
NEW_SHARDS = 40
PARTS_A_TASK = 8
LEAST_PART = 64 << 10


def min_cost_flow(supply: Sequence[int], demand: Sequence[int], cost: Sequence[Sequence[int]]) -> list[tuple[int, int, int]]:
    """Transfers (from, to, amount) that carry all supply within the demand at the least
    cost: successive shortest paths with potentials. The demand must suffice."""
    if sum(supply) > sum(demand):
        raise ValueError("the new shards cannot hold the old ones")
    n, m = len(supply), len(demand)
    source, sink = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]

    def edge(a: int, b: int, room: int, price: int) -> None:
        graph[a].append([b, room, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, amount in enumerate(supply):
        edge(source, i, amount, 0)
    for j, amount in enumerate(demand):
        edge(n + j, sink, amount, 0)
    for i in range(n):
        for j in range(m):
            edge(i, n + j, min(supply[i], demand[j]), cost[i][j])
    height = [0] * len(graph)
    todo = sum(supply)
    while todo:
        far = [float("inf")] * len(graph)
        via: list[tuple[int, int] | None] = [None] * len(graph)
        far[source] = 0
        queue = [(0, source)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for k, (b, room, price, _) in enumerate(graph[a]):
                step = d + price + height[a] - height[b]
                if room and step < far[b]:
                    far[b], via[b] = step, (a, k)
                    heapq.heappush(queue, (step, b))
        for a, d in enumerate(far):
            if d < float("inf"):
                height[a] += d
        amount, b = todo, sink
        while b != source:
            a, k = via[b]
            amount, b = min(amount, graph[a][k][1]), a
        b = sink
        while b != source:
            a, k = via[b]
            graph[a][k][1] -= amount
            graph[b][graph[a][k][3]][1] += amount
            b = a
        todo -= amount
    return [(i, b - n, graph[b][back][1]) for i in range(n) for b, _, _, back in graph[i] if b < source and graph[b][back][1]]


def transfers(old_sizes: Sequence[int], capacities: Sequence[int]) -> list[tuple[int, int, int]]:
    """Block transfers (old, new, bytes) that move the fewest bytes, a shard keeping its
    number; ``(i, i, b)`` stays."""
    cost = [[int(i != j) for j in range(len(capacities))] for i in range(len(old_sizes))]
    return min_cost_flow(old_sizes, capacities, cost)


def reshard(docs: DataFrame, old_shard, new_shards: int = NEW_SHARDS, old_shards: int = OLD_SHARDS, least_part: int = LEAST_PART) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """The rows of ``docs`` (doc_id, text) with size, old_shard, shard and slot, and the
    transfers made. ``old_shard``: column with the number of the shard that holds a row.

    Shards get equal capacities. Slots of a shard run from 0 without a gap. A null text
    counts as no bytes, and every row weighs ``OVERHEAD`` more. Repeated rows are placed
    one by one; a null doc_id is kept; other columns are dropped.
    """
    spark = docs.sparkSession
    parts = common.n_partitions(spark)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD
    docs = docs.select("doc_id", "text", size.alias("size"), F.xxhash64("text").alias("tie"), old_shard.cast("int").alias("old_shard"))
    docs = docs.withColumn("class", F.floor(F.log2(F.col("size").cast("double"))).cast("int"))
    block = ["old_shard", "class", "part"]
    light = common.stage(docs.drop("text"))
    # One row for each class of a shard: at most ``old_shards`` times 64.
    each = light.groupBy("old_shard", "class").agg(F.sum("size").alias("bytes")).collect()
    share = max(least_part, sum(r["bytes"] for r in each) // (PARTS_A_TASK * parts))
    each = [(r["old_shard"], r["class"], -(-r["bytes"] // share)) for r in each]
    each = F.broadcast(spark.createDataFrame(each or [(0, 0, 1)], "old_shard int, class int, each long"))
    seeded = F.pmod(F.xxhash64("doc_id", "tie", F.lit(1)), F.col("each")).cast("int")
    light, docs = (x.join(each, ["old_shard", "class"]).withColumn("part", seeded).drop("each") for x in (light, docs))
    sums = sorted((r["old_shard"], -r["class"], r["part"], r["bytes"]) for r in light.groupBy(*block).agg(F.sum("size").alias("bytes")).collect())
    start, held = [], [0] * old_shards
    for old, c, part, amount in sums:
        start.append((old, -c, part, held[old]))
        held[old] += amount
    total = sum(held)
    capacity = [total // new_shards + (j < total % new_shards) for j in range(new_shards)]
    moves = transfers(held, capacity)
    cuts, at = [], [0] * old_shards
    for old, new, amount in sorted(moves, key=lambda t: (t[0], t[0] != t[1], t[1])):
        cuts.append((old, new, at[old], at[old] + amount))
        at[old] += amount
    first = spark.createDataFrame(start or [(0, 0, 0, 0)], "old_shard int, class int, part int, base long")
    ranges = {old: [(lo, new) for o, new, lo, _ in cuts if o == old] for old in range(old_shards)}
    choice = spark.createDataFrame([(old, [x for x, _ in r], [x for _, x in r]) for old, r in ranges.items()], "old_shard int, froms array<long>, news array<int>")
    order = Window.partitionBy(*block).orderBy(F.desc("size"), "doc_id", "tie")

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.repartition(max(parts, 1), *block)
        rows = rows.withColumn("run", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        rows = rows.join(F.broadcast(first), block).join(F.broadcast(choice), "old_shard")
        middle = F.col("base") + F.col("run") - F.expr("size - size div 2")
        own = F.greatest(F.size(F.filter("froms", lambda f: f <= middle)), F.lit(1))
        rows = rows.withColumn("shard", F.element_at("news", own)).drop("froms", "news", "base")
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*block, "shard").orderBy(F.desc("size"), "doc_id", "tie")))

    counts = placed(light).groupBy("shard", *block).agg(F.count("*").alias("n")).collect()
    slots, used = [], [0] * new_shards
    for r in sorted(counts, key=lambda r: (r["shard"], r["old_shard"], -r["class"], r["part"])):
        slots.append((r["shard"], r["old_shard"], r["class"], r["part"], used[r["shard"]]))
        used[r["shard"]] += r["n"]
    offsets = spark.createDataFrame(slots or [(0, 0, 0, 0, 0)], "shard int, old_shard int, class int, part int, offset long")
    out = placed(docs).join(F.broadcast(offsets), ["shard", *block])
    return out.select("doc_id", "text", "size", "old_shard", "shard", (F.col("offset") + F.col("rank") - 1).alias("slot")), moves


def rewrite(placed: DataFrame, moves: list[tuple[int, int, int]], path: str) -> list[int]:
    """Write the shards that gain or lose documents below ``path`` (``shard=N``), and
    return their numbers; the files of other shards stay as they are."""
    affected = sorted({x for old, new, _ in moves if old != new for x in (old, new)})
    placed.where(F.col("shard").isin(affected)).drop("old_shard").write.partitionBy("shard").parquet(path)
    return affected
