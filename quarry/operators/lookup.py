"""Lookups, status and upkeep of documents, vectors and notes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text


def get_document(docs: DataFrame, reference: str) -> DataFrame:
    """The active document with this docid (a leading ``#`` is dropped) or path; of
    several the first by path. Its content is not part of the result."""
    reference = reference.removeprefix("#")
    found = docs.where("active").where((F.col("docid") == reference) | (F.col("path") == reference))
    return found.orderBy("path", "id").limit(1).select("docid", "path", "title", "hash", "context")


def multi_get(docs: DataFrame, pattern: str) -> DataFrame:
    """Active documents for a comma list of path patterns (with ``*``) and references:
    ``ord`` is the place in the list, and a document comes once for each that fits."""
    out = None
    for i, part in enumerate(p for p in (x.strip() for x in pattern.split(",")) if p):
        if "*" in part:
            found = docs.where("active").where(F.col("path").rlike(text.like_pattern(part))).select("docid", "path", "title", "hash", "context")
        else:
            found = get_document(docs, part)
        found = found.select(F.lit(i).alias("ord"), "*")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.where("false").select(F.lit(0).alias("ord"), "docid", "path", "title", "hash", "context")
    return out.orderBy("ord", "path")


def unembedded(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hashes of active documents of which no chunk has a vector."""
    done = chunks.where("vec is not null").select("hash").distinct()
    return docs.where("active").select("hash").distinct().join(done, "hash", "left_anti")


def has_chunks(chunks: DataFrame, hash_: str) -> bool:
    return not chunks.where(F.col("hash") == hash_).isEmpty()


def unembedded_chunks(chunks: DataFrame, hash_: str) -> DataFrame:
    return chunks.where((F.col("hash") == hash_) & F.col("vec").isNull()).select("seq", "text").orderBy("seq")


def document_for_hash(docs: DataFrame, hash_: str) -> DataFrame:
    """Title and collection/path of an active document with this hash."""
    found = docs.where("active").where(F.col("hash") == hash_).orderBy("collection", "path").limit(1)
    return found.select("title", F.concat_ws("/", "collection", "path").alias("path"))


def stale_notes(notes: DataFrame, docs: DataFrame) -> DataFrame:
    """Notes whose docid has no active document or one with another hash."""
    now = docs.where("active").groupBy("docid").agg(F.min_by("hash", F.struct("path", "id")).alias("now"))
    joined = notes.join(now, "docid", "left")
    return joined.where(F.col("now").isNull() | (F.col("now") != F.col("hash"))).drop("now")


def attach_notes(results: DataFrame, stale: DataFrame) -> DataFrame:
    """Adds the stale note of its docid, the last one, to a result's context."""
    last = stale.groupBy("docid").agg(F.max_by("note", F.struct("ord")).alias("note")) if "ord" in stale.columns else stale.groupBy("docid").agg(F.max("note").alias("note"))
    tagged = F.concat(F.coalesce("context", F.lit("")), F.lit(" [STALE observation: "), F.col("note"), F.lit("]"))
    joined = results.join(last, "docid", "left")
    return joined.withColumn("context", F.when(F.col("note").isNotNull(), tagged).otherwise(F.col("context"))).drop("note")


def status(collections: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of counts; inactive documents are counted as well."""
    counts = collections.agg(F.count("*").alias("collections"))
    counts = counts.crossJoin(docs.agg(F.count("*").alias("documents"))).crossJoin(chunks.agg(F.count("*").alias("chunks")))
    counts = counts.crossJoin(unembedded(docs, chunks).agg(F.count("*").alias("needs_embedding")))
    return counts.withColumn("has_vector_index", (F.col("needs_embedding") == 0) & (F.col("chunks") > 0))


KEY = ("collection", "path")


def change_status(old: DataFrame, scanned: DataFrame) -> DataFrame:
    """collection, path and status of every known or scanned document: ``new``,
    ``changed``, ``unchanged`` or ``missing``."""
    old = old.select(*KEY, F.col("hash").alias("old"))
    both = old.join(scanned.select(*KEY, F.col("hash").alias("new")), list(KEY), "full_outer")
    state = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "missing").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return both.select(*KEY, state.alias("status"))


def merge(old: DataFrame, scanned: DataFrame, compat: bool = True) -> DataFrame:
    """``old`` after a scan. A changed or new file becomes active; one that is missing
    inactive. An unchanged file keeps its state, so a restored one stays inactive
    (``compat``), or becomes active."""
    columns = [c for c in old.columns if c not in KEY]
    mark = F.lit(True)
    both = old.withColumn("_old", mark).alias("o").join(scanned.withColumn("_new", mark).alias("n"), list(KEY), "full_outer")
    fresh = F.col("_new").isNotNull() & (F.col("_old").isNull() | (F.col("o.hash") != F.col("n.hash")))
    picked = [F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns if c not in ("id", "active") and c in scanned.columns]
    active = F.when(fresh, True).when(F.col("_new").isNull(), False).otherwise(F.col("o.active") if compat else F.lit(True))
    ids = [F.coalesce("o.id", F.xxhash64(*KEY)).alias("id")] if "id" in columns else []
    return both.select(*ids, *KEY, *picked, active.alias("active"))


def stale_paths(old: DataFrame, scanned: DataFrame) -> DataFrame:
    """Active documents that a scan did not meet."""
    return old.where("active").join(scanned.select(*KEY), list(KEY), "left_anti").select(*KEY)


def keep_latest(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    last = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
