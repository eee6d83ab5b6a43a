"""Benchmark decontamination by template canonicalisation.

Numbers, names (capitalised words inside a sentence) and units after a number become
typed placeholders; windows of the resulting templates are hash-joined with those of the
benchmark items. A re-parameterised question keeps its template, so its windows meet. The
slots are then compared along each alignment (difference of the places in text and item):
if one value of the item stands for two values of the text, the alignment is dropped.
A text is contaminated by an item if consistent alignments cover ``coverage`` of the
item's windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words
from .common import U64

WINDOW = 8
COVERAGE = 0.5
#: Windows of the benchmark that may be sent to every task (8 bytes each) as a filter.
#: With more, texts send all their windows to the join.
FILTER_LIMIT = 2_000_000

UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes "
    "ms s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "ml l liter liters litre litres gallon gallons cup cups percent degrees dollars dollar euros euro cents cent "
    "mph kph kmh watts watt volts volt joules joule newtons newton hz khz mhz ghz kb mb gb tb"
).split()

_MARK = {"number": U64(0x1111111111111111), "name": U64(0x2222222222222222), "unit": U64(0x3333333333333333)}


def templates(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Canonical token hashes, the slot's kind (0: none, 1 number, 2 name, 3 unit), the
    plain hashes and each text's first token."""
    t = words.tokenize(values)
    units = np.array([words.hash_word(u) for u in UNITS], U64)
    after_number = np.zeros(len(t.hash), bool)
    after_number[1:] = t.number[:-1]
    after_number[t.at[:-1][t.at[:-1] < len(t.hash)]] = False
    kind = np.zeros(len(t.hash), np.int8)
    kind[t.capital & ~t.opens] = 2
    kind[after_number & np.isin(t.hash, units)] = 3
    kind[t.number] = 1
    canon = t.hash.copy()
    for k, name in enumerate(("number", "name", "unit"), 1):
        canon[kind == k] = _MARK[name]
    return canon, kind, t.hash, t.at


def windows(texts: DataFrame, window: int, sizes: list[int] | None = None, wanted: np.ndarray | None = None) -> DataFrame:
    """h, pos and slots of the template windows of ``texts`` (key columns and text).

    Without ``sizes`` a text shorter than ``window`` gives itself as its only window;
    with them, windows of these sizes are made. ``wanted`` keeps only these hashes.
    """
    keys = [c for c in texts.columns if c != "text"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            values = [common.utf8(t) for t in pdf["text"]]
            for lo, hi in common.batches_by_bytes(values):
                canon, kind, plain, at = templates(values[lo:hi])
                doc = np.repeat(np.arange(hi - lo), np.diff(at))
                count = np.diff(at)
                first, size, hashes = [], [], []
                for w in sizes or sorted({min(window, n) for n in count.tolist() if n}):
                    run_hash = common.window_hashes(canon, w) + U64(w)
                    start = np.arange(len(run_hash))
                    ok = doc[start] == doc[start + w - 1] if len(start) else np.zeros(0, bool)
                    if not sizes and w < window:
                        ok &= count[doc[start]] == w
                    if not sizes and w == window and len(start):
                        ok &= count[doc[start]] >= window
                    if wanted is not None:
                        near = np.minimum(np.searchsorted(wanted, run_hash), len(wanted) - 1)
                        ok &= wanted[near] == run_hash
                    start = start[ok]
                    first.append(start)
                    size.append(np.full(len(start), w))
                    hashes.append(run_hash[ok])
                if not first:
                    continue
                first, size, hashes = map(np.concatenate, (first, size, hashes))
                if not len(first):
                    continue
                slots = []
                for s, w in zip(first.tolist(), size.tolist()):
                    held = np.flatnonzero(kind[s : s + w])
                    slots.append([{"i": int(i), "kind": int(kind[s + i]), "value": int(plain[s + i].astype(np.int64))} for i in held])
                out = {k: pdf[k].iloc[lo + doc[first]].array for k in keys}
                yield pd.DataFrame({**out, "h": hashes.view(np.int64), "pos": first - at[doc[first]], "size": size, "slots": slots})

    types = ", ".join(f"`{k}` {dict(texts.dtypes)[k]}" for k in keys)
    return texts.mapInPandas(run, f"{types}, h long, pos long, size int, slots array<struct<i: int, kind: int, value: long>>")


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, filter_limit: int = FILTER_LIMIT) -> DataFrame:
    """doc_id, k (hash of the text), item_id, n_windows, n_item_windows and
    reparameterised: a row for each text and item that contaminates it.

    Null or tokenless texts and items match nothing. Items that share an item_id count as
    one with the windows of all. Repeated documents are reported once; a null doc_id is
    reported as such. Other columns are ignored.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("k"), "text").where("text is not null")
    bench = common.stage(windows(items.select("item_id", "text").where("text is not null"), window))
    sizes = [r[0] for r in bench.select("size").distinct().collect()]
    if not sizes:
        return docs.where("false").selectExpr("doc_id", "k", "cast(null as long) item_id", "0L n_windows", "0L n_item_windows", "false reparameterised")
    wanted = None
    if bench.count() <= filter_limit:
        wanted = np.unique(bench.select("h").distinct().toPandas()["h"].to_numpy(np.int64).view(U64))
    hits = windows(docs, window, sorted(sizes), wanted)
    bench = bench.select("item_id", "h", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"))
    pairs = hits.join(bench, "h").select("doc_id", "k", "item_id", "item_pos", (F.col("pos") - F.col("item_pos")).alias("line"), F.arrays_zip("slots", "item_slots").alias("slots"))
    lines = pairs.groupBy("doc_id", "k", "item_id", "line").agg(
        F.collect_set("item_pos").alias("places"),
        F.array_distinct(F.flatten(F.collect_list(F.transform("slots", lambda s: F.struct(s["item_slots"]["kind"].alias("kind"), s["item_slots"]["value"].alias("item"), s["slots"]["value"].alias("own")))))).alias("slots"),
    )
    values = F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s["item"])))
    lines = lines.where(F.size(values) == F.size("slots")).withColumn("changed", F.exists("slots", lambda s: s["item"] != s["own"]))
    found = lines.groupBy("doc_id", "k", "item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_windows"), F.max("changed").alias("reparameterised"))
    total = bench.groupBy("item_id").agg(F.countDistinct("item_pos").alias("n_item_windows"))
    found = found.join(total, "item_id").where(F.col("n_windows") >= coverage * F.col("n_item_windows"))
    return found.select("doc_id", "k", "item_id", "n_windows", "n_item_windows", "reparameterised")


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that an item contaminates."""
    bad = matches(docs, items, **options).select(F.col("doc_id").alias("_id"), F.col("k").alias("_k")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_k"]), "left_anti")
