"""Continuous indexing: files that arrive in a folder are merged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.schemas import GLOB
from quarry.sources import files
from quarry.sources.store import Store


def watch(spark: SparkSession, store: Store, root: str, collection: str, checkpoint: str, glob: str = GLOB):
    """A streaming query over new files below ``root``, by the rules of a scan. A batch
    adds and updates documents; it never deactivates any, as it does not see the whole
    folder. A batch without a file for the index changes nothing."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    arriving = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)
    store.upsert_collection(collection, root, glob)

    def merge(batch: DataFrame, _: int) -> None:
        rows = batch.persist()
        try:
            if not rows.isEmpty():
                known = store.read("documents").where(F.col("collection") == collection).join(rows.select("path"), "path", "left_anti")
                store.merge_documents(collection, rows.unionByName(known.select(*rows.columns)))
        finally:
            rows.unpersist()

    return files.indexable(arriving, root, collection, glob).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()
