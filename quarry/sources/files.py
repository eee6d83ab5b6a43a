"""Scanning folders of text files, and the engine's small configuration files."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.schemas import GLOB, MAX_BYTES

#: Folders that are never entered.
SKIPPED = frozenset(".git .hg .svn node_modules .venv venv __pycache__ .mypy_cache .cache vendor dist build .next .nuxt target".split())
PROBE = 512


def pruned(name: str) -> bool:
    return name in SKIPPED or name.startswith(".")


def walk(root: str, glob: str = GLOB) -> Iterator[tuple[str, str]]:
    """(relative, full) paths of the files that the glob takes, in lexical order. The
    rule for folders holds for the root itself."""
    if pruned(os.path.basename(os.path.abspath(root))):
        return

    def fail(error: OSError) -> None:
        raise error

    for folder, folders, names in os.walk(root, onerror=fail):
        folders[:] = sorted(d for d in folders if not pruned(d))
        for name in sorted(names):
            full = os.path.join(folder, name)
            relative = os.path.relpath(full, root).replace(os.sep, "/")
            if text.matches_glob(relative, glob):
                yield relative, full


def is_binary(data: bytes) -> bool:
    return b"\0" in data[:PROBE]


def _rows(paths: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, full in zip(pdf["path"], pdf["full"]):
                try:
                    if os.path.getsize(full) > MAX_BYTES:
                        continue
                    with open(full, "rb") as f:
                        data = f.read()
                except OSError:
                    continue
                if not is_binary(data):
                    yield pd.DataFrame({"path": [path], "content": [data.decode("utf-8", "replace")], "hash": [_sha(data)]})

    return paths.mapInPandas(run, "path string, content string, hash string")


def _sha(data: bytes) -> str:
    import hashlib

    return hashlib.sha256(data).hexdigest()


def _described(files: DataFrame, collection: str) -> DataFrame:
    return files.select(
        F.lit(collection).alias("collection"),
        "path",
        text.title(F.col("content"), F.col("path")).alias("title"),
        text.docid(F.col("hash")).alias("docid"),
        "hash",
        text.token_estimate(F.col("content")).alias("doc_len"),
        "content",
    )


def scan(spark: SparkSession, root: str, collection: str, glob: str = GLOB) -> DataFrame:
    """The files of a local folder: collection, path, title, docid, hash, doc_len and
    content. Files over 1 MiB, unreadable ones and those with a NUL in their first 512
    bytes are passed over."""
    paths = list(walk(root, glob))
    return _described(_rows(spark.createDataFrame(paths, "path string, full string")), collection)


def indexable(arrived: DataFrame, root: str, collection: str, glob: str = GLOB) -> DataFrame:
    """The rules of :func:`scan` on rows (path, length, content) of Spark's binary files
    below ``root``, a batch or a stream."""
    below = F.expr(f"substring(path, instr(path, '{root.rstrip('/')}/') + {len(root.rstrip('/')) + 1})")
    found = arrived.where(F.col("length") <= MAX_BYTES).withColumn("path", below)
    taken = F.lit(False)
    for p in text.expand_glob(glob):
        taken = taken | (F.col("path") if "/" in p else F.element_at(F.split("path", "/"), -1)).rlike(text.glob_regex(p))
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    found = found.where(taken & ~F.exists(folders, lambda d: d.isin(*SKIPPED) | d.startswith(".")))
    plain = F.locate("\x00", F.decode(F.substring("content", 1, PROBE), "ISO-8859-1")) == 0
    return _described(found.where(plain).select("path", F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("hash")), collection)


def scan_store(spark: SparkSession, root: str, collection: str, glob: str = GLOB) -> DataFrame:
    """The same for any store Spark reads, listed and read by the executors. Spark passes
    over names that begin with a point or an underscore."""
    return indexable(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root), root, collection, glob)


def load_config(path: str) -> dict:
    """Collections (name, path, glob, context) and contexts (uri, context); a missing
    file is an empty configuration, a malformed one an error. JSON is valid YAML, which
    is read where a YAML library is installed."""
    if not os.path.exists(path):
        return {"collections": [], "contexts": []}
    with open(path, encoding="utf-8") as f:
        return parse_config(f.read(), path)


def parse_config(data: str | None, name: str = "index.yml") -> dict:
    try:
        import yaml

        found = yaml.safe_load(data or "")
    except ImportError:
        found = json.loads(data or "null")
    found = found or {}
    if not isinstance(found, dict):
        raise ValueError(f"{name}: not a configuration")
    return {"collections": found.get("collections") or [], "contexts": found.get("contexts") or []}


def config_text(config: dict) -> str:
    return json.dumps(config, indent=2, ensure_ascii=False)


def save_config(path: str, config: dict) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(config_text(config))


def load_notes(path: str) -> list[dict]:
    """Notes (docid, path, hash, note, timestamp); none where the file is missing or
    malformed."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        return found if isinstance(found, list) else []
    except (OSError, ValueError):
        return []


def save_note(path: str, note: dict) -> None:
    """Replace the first note on the same docid, or append."""
    notes = load_notes(path)
    at = next((i for i, n in enumerate(notes) if n.get("docid") == note["docid"]), len(notes))
    notes[at : at + 1] = [note]
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(notes, f, indent=2, ensure_ascii=False)
