"""A training corpus in five stages, each one of the ``quarry.llm`` operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common, decontamination, minhash, packing, pii, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, fitted on the labelled ones among them, does not call
    toxic."""
    seen = toxicity.assess(docs, common.table(spark, sf_dir, "labels"))
    return seen.where(~F.col("toxic")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id.
    Rows without a doc_id stay; texts that share a doc_id are judged one by one."""
    return minhash.distinct_documents(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontamination.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind, n_chars counted anew."""
    clean = pii.redact(docs)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        clean = clean.withColumn("n_chars", F.length("text").cast(kind))
    return clean.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("best_fit_packing", pack),
]

#: The trained model, the tokeniser and the packing plan have no SQL form; tests hold the
#: result against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What the stages put into the shared folder is deleted as
    soon as the next one's input has been written."""
    docs, mark = common.table(spark, sf_dir, "documents"), common.staged()
    for _, function in STAGES:
        docs = common.stage(function(spark, docs, sf_dir))
        common.clear(spark, docs, since=mark)
    return docs
