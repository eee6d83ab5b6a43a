"""The engine's tables from the driver's: languages are collections, every source one
folder; the documents of one source are inactive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import index as inverted
from quarry.operators.index import Index
from quarry.sources import shared

INACTIVE = "src7"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read(spark, sf_dir, "documents")
    hash_ = text.content_hash(F.col("text"))
    return raw.select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("collection"),
        F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("path"),
        F.substring_index("text", "\n", 1).alias("title"),
        text.docid(hash_).alias("docid"),
        hash_.alias("hash"),
        (F.col("source") != INACTIVE).alias("active"),
        text.token_estimate(F.col("text")).alias("doc_len"),
        F.col("text").alias("content"),
        F.lit("").alias("context"),
    )


_indexes: dict[tuple, tuple[str, bool]] = {}


def index(spark: SparkSession, sf_dir: str, stemmed: bool = False) -> Index:
    """The index of :func:`documents`, all of them. It is built in the shared folder when
    this session first asks for it and again when the table's files change."""
    files = read(spark, sf_dir, "documents").inputFiles()
    key = (spark.sparkContext.applicationId, sf_dir, *sorted(shared.state(spark, f) for f in files))
    path, has_stems = _indexes.get(key, (None, False))
    if path is None or stemmed and not has_stems or not shared.exists(spark, f"{path}/statistics"):
        path = shared.new_folder(spark)
        inverted.build(documents(spark, sf_dir), path, stemmed)
        _indexes[key] = path, stemmed
    return inverted.load(spark, path, stemmed)


def collections(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("collection").alias("name")).distinct()


def vectors(spark: SparkSession, sf_dir: str, docs: DataFrame, several: bool = False) -> DataFrame:
    """A vector for each document with the number of one; with ``several`` a document has
    all vectors whose number leaves its own when divided by 250. Those with label 0 are
    not embedded yet."""
    raw = read(spark, sf_dir, "embeddings")
    number, seq = (F.col("vec_id") % 250, F.floor(F.col("vec_id") / 250)) if several else (F.col("vec_id"), F.lit(0))
    vec = F.when(F.col("label") != 0, F.col("embedding")) if several else F.col("embedding")
    own = raw.select(number.alias("id"), seq.cast("int").alias("seq"), vec.alias("vec"))
    return docs.select("id", "hash").join(own, "id").select("hash", "seq", F.lit(0).alias("pos"), "vec")


def vector(spark: SparkSession, sf_dir: str, number: int) -> list[float]:
    return read(spark, sf_dir, "embeddings").where(F.col("vec_id") == number).first()["embedding"]


DOCS = f"""docs as (select doc_id as id, lang as collection, source || '/' || doc_id || '.md' as path, split_part(text, chr(10), 1) as title,
  substr(sha256(text), 1, 6) as docid, sha256(text) as hash, source <> '{INACTIVE}' as active, cast(length(text) // 4 as bigint) as doc_len, text as content from documents)"""
VECTORS = "vectors as (select hash, 0 as seq, embedding as vec from docs join embeddings on vec_id = id)"
SEVERAL = "vectors as (select hash, vec_id // 250 as seq, case when label <> 0 then embedding end as vec from docs join embeddings on vec_id % 250 = id)"
