"""Folders that the driver and every executor reach, by Spark's own file systems."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession) -> str:
    """The name of a new folder below ``spark.checkpoint.dir``. Only a local session
    without that setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quarry-{uuid.uuid4().hex}"


def state(spark: SparkSession, path: str) -> str:
    """Name, size and time of a file: another string once it has been replaced."""
    where, files = _at(spark, path)
    found = files.getFileStatus(where)
    return f"{path} {found.getLen()} {found.getModificationTime()}"


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _at(spark, path)
    return files.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    where, files = _at(spark, path)
    files.delete(where, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names of the data files in a folder."""
    where, files = _at(spark, path)
    names = [f.getPath().getName() for f in files.listStatus(where) if f.isFile()]
    return sorted(n for n in names if not n.startswith((".", "_")))


def read_bytes(spark: SparkSession, path: str) -> bytes:
    where, files = _at(spark, path)
    stream = files.open(where)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """Replace a file as a whole; its folder is made."""
    where, files = _at(spark, path)
    stream = files.create(where, True)
    try:
        stream.write(content)
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The content of a small file; None where there is none."""
    return read_bytes(spark, path).decode("utf-8") if exists(spark, path) else None


def write_text(spark: SparkSession, path: str, content: str) -> None:
    write_bytes(spark, path, content.encode("utf-8"))
