"""Near-duplicate detection by MinHash with tensored banding.

Each distinct shingle set gets two small collections of sketches, every sketch made of
``rows`` minhashes. A table key combines one sketch of either collection, so
``side * side`` tables need only ``2 * side * rows`` minhashes. Two sets meet in some
table exactly if they agree in a sketch of both collections; sets that have no partner
in one collection are therefore left out before the keys are formed.

At the threshold of 0.85 a pair misses every table with probability
``2 * (1 - 0.85**rows)**side``, 1.5e-5 as set here; no bucket is cut off. A pair of
likeness 0.3 meets with probability 0.015, one of 0.1 with 3e-6. Sets that meet
form candidate groups, in which every pair is then settled on the full sets, so a link
is lost only if no chain of tables connects its ends.

A group of more than ``block`` bytes is dealt to blocks. First every block is settled by
itself, together with the group's leader, the set with the least doc_id: a group of true
copies is one class after this, in linear work. Only groups that are still in several
classes have their blocks compared with each other, and there only sets of different
classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U64

SIDE = 16
ROWS = 4
SHINGLE = 5
#: Size of the bitmap of the texts that are to be compared, as a power of two.
FILTER_BITS = 24
#: Bytes of text that one comparison holds, about; with another block, twice as many.
BLOCK = 2 << 20

_SEEDS = common.mix(np.arange(1, 2 * SIDE * ROWS + 1, dtype=U64) * U64(0xC2B2AE3D27D4EB4F))


def _sketch(sets: list[np.ndarray], side: int, rows: int) -> np.ndarray:
    """One row of ``2 * side`` sketches for each set; all sets have members."""
    seeds = _SEEDS if 2 * side * rows <= len(_SEEDS) else common.mix(np.arange(1, 2 * side * rows + 1, dtype=U64) * U64(0xC2B2AE3D27D4EB4F))
    members = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.zeros((2 * side, len(sets)), U64)
    for k in range(2 * side):
        for r in range(rows):
            seed = seeds[k * rows + r]
            least = np.minimum.reduceat((members ^ seed) * (seed | U64(1)), at)
            out[k] = common.mix(out[k] * U64(31) + least + U64(k))
    return out.T


def sketches(docs: DataFrame, side: int = SIDE, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, k (hash of the text), n_bytes, n_shingles, the set's 128-bit name (s1, s2)
    and its sketches ``a``, ``b``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for lo, hi, values in common.text_batches(pdf["text"].tolist()):
                sets = common.shingle_sets(values, shingle)
                size = np.array([len(s) for s in sets])
                full = np.flatnonzero(size)
                name = np.zeros((2, len(sets)), U64)
                both = np.zeros((len(sets), 2 * side), U64)
                if len(full):
                    held = [sets[i] for i in full]
                    at = np.cumsum([0] + [len(s) for s in held[:-1]])
                    members = np.concatenate(held)
                    name[0, full] = common.mix(np.add.reduceat(members * U64(0x9FB21C651E98DF25), at) + size[full].astype(U64))
                    name[1, full] = common.mix(np.add.reduceat(common.mix(members), at))
                    both[full] = _sketch(held, side, rows)
                signed = both.view(np.int64)
                yield pd.DataFrame(
                    {
                        "doc_id": pdf["doc_id"].iloc[lo:hi].to_numpy(),
                        "k": pdf["k"].iloc[lo:hi].to_numpy(),
                        "n_bytes": [len(v) for v in values],
                        "n_shingles": size,
                        "s1": name[0].view(np.int64),
                        "s2": name[1].view(np.int64),
                        "a": list(signed[:, :side]),
                        "b": list(signed[:, side:]),
                    }
                )

    keyed = docs.select("doc_id", F.xxhash64("text").alias("k"), "text").where("doc_id is not null")
    return keyed.mapInPandas(run, "doc_id long, k long, n_bytes long, n_shingles long, s1 long, s2 long, a array<long>, b array<long>")


def candidate_links(sets: DataFrame) -> DataFrame:
    """Star edges (u, v) of every table bucket over distinct sets (rep, a, b)."""
    # Spark takes an exploded table for as small as its files and would gather it in the
    # driver; all joins here are merged but that of ``texts_of``, which the pipeline leaves out.
    lone = sets.select("rep", F.posexplode(F.concat("a", "b")).alias("i", "h"))
    met = lone.groupBy("i", "h").agg(F.count("*").alias("n")).where("n > 1")
    side = sets.select(F.size("a").alias("side")).limit(1)
    side = (side.first() or [SIDE])[0]
    some = (
        lone.join(met.select("i", "h").hint("merge"), ["i", "h"], "left_semi")
        .groupBy("rep")
        .agg(F.max(F.col("i") < side).alias("in_a"), F.max(F.col("i") >= side).alias("in_b"))
        .where("in_a and in_b")
    )
    kept = common.stage(sets.join(some.select("rep").hint("merge"), "rep", "left_semi").select("rep", "a", "b"))
    keys = kept.select("rep", F.posexplode("a").alias("i", "x"), "b").select("rep", "i", "x", F.posexplode("b").alias("j", "y")).select("rep", F.xxhash64("i", "x", "j", "y").alias("key"))
    lead = keys.groupBy("key").agg(F.min("rep").alias("lead"), F.count("*").alias("n")).where("n > 1").select("key", "lead")
    return keys.join(lead.hint("merge"), "key").where("rep <> lead").select(F.col("rep").alias("u"), F.col("lead").alias("v")).distinct()


def _links(sets: list[np.ndarray], group: np.ndarray, sides: np.ndarray | None, percent: int) -> list[int]:
    """For each set, the first set of its class when sets with
    ``100 * common >= percent * union`` are linked. Sets of one ``group`` are linked
    already. With ``sides`` only sets of different sides are compared."""
    _, first, group = np.unique(group, return_index=True, return_inverse=True)
    group = first[group]
    size = np.array([len(s) for s in sets])
    ids, flat = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(len(ids), np.int32)
    for i in range(len(sets) - 1):
        others = np.arange(i + 1, len(sets))
        ok = (group[others] != group[i]) & (100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i]))
        if sides is not None:
            ok &= sides[others] != sides[i]
        others = others[ok]
        if not len(others):
            continue
        own = flat[at[i] : at[i + 1]]
        mark[own] = 1
        if 4 * len(others) >= len(sets) - i:
            shared = np.add.reduceat(mark[flat[at[i + 1] :]], at[i + 1 : -1] - at[i + 1])[others - i - 1]
        else:
            shared = np.array([mark[flat[at[j] : at[j + 1]]].sum() for j in others])
        mark[own] = 0
        for j in others[100 * shared >= percent * (size[others] + size[i] - shared)].tolist():
            a, b = sorted((group[i], group[j]))
            if a != b:
                group[group == b] = a
    return group.tolist()


def texts_of(texts: DataFrame, members: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``texts`` with doc_id and k of one of ``members``, and a few others: their
    hash is looked up in a bitmap of ``2**bits`` bits, so that the rest is not moved. Its rows
    of 4 KB (2 MB at most, for any number of members) are all that is broadcast."""
    slot = F.shiftrightunsigned(F.xxhash64("doc_id", "k"), 64 - bits)
    row, place = F.shiftright(slot, 15), slot.bitwiseAND(F.lit(32767))
    held = members.select(row.alias("_row"), place.alias("place")).repartition(common.n_partitions(members.sparkSession), "_row")
    held = held.groupBy("_row").agg(F.bitmap_construct_agg("place").alias("_bits"))
    byte = F.hex(F.substring("_bits", F.shiftright(place, 3).cast("int") + 1, F.lit(1)))
    found = F.getbit(F.conv(byte, 16, 10).cast("int"), place.bitwiseAND(F.lit(7)).cast("int")) == 1
    return texts.withColumn("_row", row).join(F.broadcast(held), "_row").where(found).select(*texts.columns)


def _settled(units: DataFrame, keys: list[str], percent: int, shingle: int) -> DataFrame:
    """Star edges (u, v) of the classes within each unit (``keys``, node, label, text and
    own: the side, where two blocks meet, else null)."""

    def settle(held: list[tuple[int, int, int | None, bytes]]) -> list[tuple[int, int]]:
        if len(held) < 2:
            return []
        sides = None if held[0][2] is None else np.array([x[2] for x in held])
        roots = _links(common.shingle_sets([x[3] for x in held], shingle), np.array([x[1] for x in held]), sides, percent)
        return [(held[i][0], held[r][0]) for i, r in enumerate(roots) if r != i]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for pdf in frames:
            out: list[tuple[int, int]] = []
            own = [None if x is None or x != x else int(x) for x in pdf["own"].tolist()]
            for unit, node, label, side, text in zip(zip(*(pdf[c].tolist() for c in keys)), pdf["node"].tolist(), pdf["label"].tolist(), own, pdf["text"].tolist()):
                if unit != key:
                    out += settle(held)
                    key, held = unit, []
                held.append((node, label, side, common.utf8(text)))
            yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")
        yield pd.DataFrame(settle(held), columns=["u", "v"], dtype="int64")

    parts = common.n_partitions(units.sparkSession)
    return units.select(*keys, "node", "label", "own", "text").repartition(parts, *keys).sortWithinPartitions(*keys, "node").mapInPandas(run, "u long, v long")


def verified_links(members: DataFrame, texts: DataFrame, percent: int, shingle: int = SHINGLE, block: int = BLOCK, bitmap: bool = True) -> DataFrame:
    """Edges (u, v) whose components are the classes that verified links form within each
    candidate group. ``members``: node, grp (its least node), doc_id, k, n_bytes;
    ``texts``: doc_id, k, text. Without ``bitmap`` all of ``texts`` are moved, once, and
    nothing is broadcast."""
    sizes = members.groupBy("grp").agg(F.ceil(F.sum("n_bytes") / block).cast("int").alias("blocks"))
    members = common.stage(members.join(sizes.hint("merge"), "grp").withColumn("own", F.pmod(F.xxhash64("node"), F.greatest("blocks", F.lit(1)).cast("long")).cast("int")))
    # A sort-merge join at every size: texts to be compared move once.
    whole = (texts_of(texts, members) if bitmap else texts).hint("merge").join(members.select("node", "grp", "blocks", "own", "doc_id", "k"), ["doc_id", "k"])
    large = members.where("blocks > 1")
    several = not large.isEmpty()
    if several:
        whole = common.stage(whole.select("node", "grp", "blocks", "own", "text"))
    alone = whole.withColumn("block", F.explode(F.when((F.col("node") == F.col("grp")) & (F.col("blocks") > 1), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))))
    links = common.stage(_settled(alone.withColumn("label", F.col("node")).withColumn("own", F.lit(None).cast("int")), ["grp", "block"], percent, shingle))
    if not several:
        return links
    near = common.stage(common.connected_components(links))
    large = large.join(near.withColumnRenamed("component", "label").hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = large.groupBy("grp").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("grp")
    large = common.stage(large.join(split.hint("merge"), "grp", "left_semi"))
    if large.isEmpty():
        return links
    across = whole.hint("merge").join(large.select("node", "label"), "node")
    across = across.withColumn("other", F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("own"))))
    across = across.withColumn("b1", F.least("own", "other")).withColumn("b2", F.greatest("own", "other"))
    return links.unionByName(_settled(across, ["grp", "b1", "b2"], percent, shingle))


def classify(docs: DataFrame, percent: int = 85, side: int = SIDE, rows: int = ROWS, shingle: int = SHINGLE, block: int = BLOCK, bitmap: bool = True) -> DataFrame:
    """:func:`near_duplicates` with k, the hash of the row's text. Without ``bitmap`` nothing
    is broadcast."""
    found = common.stage(sketches(docs, side, rows, shingle))
    full = found.where("n_shingles > 0")
    sets = full.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "k", "n_bytes")).alias("at"), F.first("a").alias("a"), F.first("b").alias("b"))
    sets = common.stage(sets.select("s1", "s2", "at.*", "a", "b"))
    # A set goes by its least doc_id; where several sets have the same, by a hash.
    shared = common.stage(sets.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("shared")))
    node, apart = F.col("doc_id"), shared.isEmpty()
    if not apart:
        sets, node = sets.join(shared.hint("merge"), "doc_id", "left"), F.when(F.col("shared"), F.xxhash64("doc_id", "s1", "s2")).otherwise(F.col("doc_id"))
    sets = common.stage(sets.select(node.alias("rep"), "s1", "s2", "doc_id", "k", "n_bytes", "a", "b"))
    groups = common.connected_components(candidate_links(sets)).select(F.col("node").alias("rep"), F.col("component").alias("grp"))
    members = sets.select("rep", "doc_id", "k", "n_bytes").join(groups.hint("merge"), "rep").withColumnRenamed("rep", "node")
    texts = docs.select("doc_id", F.xxhash64("text").alias("k"), "text").where("doc_id is not null")
    links = verified_links(members, texts, percent, shingle, block, bitmap)
    classes = common.stage(common.connected_components(links)).withColumnRenamed("node", "rep")
    named = sets.select("s1", "s2", "doc_id", "rep").join(classes.hint("merge"), "rep", "left").withColumn("least", F.col("component"))
    if not apart:
        named = common.stage(named.drop("least"))
        least = named.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
        named = named.join(least.hint("merge"), "component", "left")
    named = named.select("s1", "s2", F.coalesce("least", "doc_id").alias("component_id"))
    out = found.select("doc_id", "k", "n_shingles", "s1", "s2").join(named.hint("merge"), ["s1", "s2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "k", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def near_duplicates(docs: DataFrame, percent: int = 85, side: int = SIDE, rows: int = ROWS, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``.

    Documents are linked if ``100 * |A & B| >= percent * |A | B|`` for their sets of
    distinct ``shingle``-word shingles (A-Z lower-cased, words split at ASCII white
    space). Fewer words make one shingle; a null, empty or blank text has none and is
    linked with nothing. component_id is the smallest doc_id reachable. Rows with a null
    doc_id are not part of the result. Rows that repeat a doc_id give one row each, and
    each is judged by its own text: a shared doc_id links nothing. Other columns are
    ignored.
    """
    return classify(docs, percent, side, rows, shingle, block).drop("k")


def distinct_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class, that with the smallest doc_id.

    Rows without a doc_id stay, as do rows without words. Of rows with equal doc_id and
    text one stays; different texts under one doc_id are judged one by one. Nothing is
    broadcast: the driver may be full of what earlier stages left.
    """
    gone = classify(docs, bitmap=False, **options).where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("k").alias("_k")).distinct()
    keyed = docs.where("doc_id is not null").withColumn("_key", F.xxhash64("text"))
    rest = keyed.join(gone.hint("merge"), (F.col("doc_id") == F.col("_id")) & (F.col("_key") == F.col("_k")), "left_anti")
    columns = [c for c in docs.columns if c != "doc_id"]
    first = F.struct("text", *(c for c in columns if c != "text"))
    single = rest.groupBy("doc_id", "_key").agg(F.min(first).alias("row")).select("doc_id", *(F.col(f"row.{c}").alias(c) for c in columns))
    return single.select(*docs.columns).unionByName(docs.where("doc_id is null"))
