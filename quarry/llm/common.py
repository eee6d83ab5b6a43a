"""Shared pieces: scratch tables, byte-level text hashing and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C55
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor can reach.

    Only a local session without that setting gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quarry-{uuid.uuid4().hex}"


def stage(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs neither repeat
    the work nor depend on the executors that did it."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    _staged.append(path)
    return out


_staged: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_stage(df: DataFrame) -> None:
    """Delete what :func:`stage` wrote; nothing may read it afterwards."""
    _delete(df.sparkSession, df.staged_path)
    if df.staged_path in _staged:
        _staged.remove(df.staged_path)


def staged() -> int:
    """How many tables this process has staged and not deleted: a mark for :func:`clear`."""
    return len(_staged)


def clear(spark: SparkSession, *keep: DataFrame, since: int = 0) -> None:
    """Delete the tables staged after the mark ``since``, but for ``keep``. An operator's
    result reads staged tables until it has been written; call this afterwards."""
    kept = {getattr(df, "staged_path", None) for df in keep}
    for path in [p for p in _staged[since:] if p not in kept]:
        _delete(spark, path)
        _staged.remove(path)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


# --- hashing of texts, many at a time -------------------------------------------------

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``m**i`` and ``m**-i`` modulo 2**64 for ``i < n``."""
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        for at, base in enumerate((_MULTIPLIER, _INVERSE)):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _powers[at] = np.cumprod(steps, dtype=U64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """``p`` with ``(p[e] - p[s]) * m**-s`` the polynomial hash of ``data[s:e]``."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64))


def batches_by_bytes(values: Sequence[bytes], limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Index ranges whose bytes stay near ``limit`` (a larger value stands alone)."""
    start, held = 0, 0
    for i, v in enumerate(values):
        if held and held + len(v) > limit:
            yield start, i
            start, held = i, 0
        held += len(v) + 1
    if start < len(values):
        yield start, len(values)


def text_batches(texts: Sequence[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """Index ranges of about ``limit`` characters and their texts as UTF-8, encoded range by
    range, so that a batch of rows is not held twice."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if isinstance(t, str) else 0
        if held and held + n > limit:
            yield start, i, [utf8(x) for x in texts[start:i]]
            start, held = i, 0
        held += n + 1
    if start < len(texts):
        yield start, len(texts), [utf8(x) for x in texts[start:]]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(values: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) of all values,
    and the offsets at which each value's words begin (one more than values)."""
    data = _LOWER[np.frombuffer(b"\n".join(values) + b"\n", np.uint8)]
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    ends = ~space[:-1] & space[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc_start = np.cumsum([0] + [len(v) + 1 for v in values])
    return span_hash(prefix_hash(data), start, end), np.searchsorted(start, doc_start)


_COMBINE = mix(np.arange(1, 65, dtype=U64)) | U64(1)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    if len(words) < size:
        return np.zeros(0, U64)
    n = len(words) - size + 1
    out = np.zeros(n, U64)
    for j in range(size):
        out += words[j : j + n] * _COMBINE[j]
    return mix(out)


def shingle_sets(values: Sequence[bytes], size: int = 5) -> list[np.ndarray]:
    """The distinct shingle hashes of each value, sorted; a value with fewer than
    ``size`` words has one for its whole sequence, one without words has none."""
    out: list[np.ndarray] = []
    for lo, hi in batches_by_bytes(values):
        words, at = word_hashes(values[lo:hi])
        runs = window_hashes(words, size)
        for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
            if e - s >= size:
                out.append(np.unique(runs[s : e - size + 1]))
            elif e > s:
                short = (words[s:e] * _COMBINE[: e - s]).sum(dtype=U64) + U64(e - s)
                out.append(mix(np.array([short ^ U64(0xA5A5A5A5A5A5A5A5)], U64)))
            else:
                out.append(np.zeros(0, U64))
    return out


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


# --- connected components ------------------------------------------------------------


def _minimum_step(edges: DataFrame, upward: bool) -> DataFrame:
    """One star operation. ``edges`` has ``u > v``.

    ``upward``: every larger neighbour of a node is linked to the smallest of the node
    and its neighbours. Otherwise a node and its smaller neighbours are linked to the
    smallest of these. The joins are merged, so that no edges are gathered in the driver.
    """
    if upward:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        out = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least.hint("merge"), "u").select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the undirected ``edges`` (u, v: long),
    the component being its smallest node. Alternates star operations until nothing
    changes; each round is written to the shared folder, and only two numbers a round
    reach the driver."""
    edges = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0)), F.coalesce(F.sum(F.expr("cast(v as decimal(38,0))")), F.lit(0))).first()
        if now == seen or not now[0]:
            break
        seen, last = now, edges
        edges = stage(_minimum_step(_minimum_step(edges, True), False))
        drop_stage(last)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
