"""The persistent index: versioned Parquet tables below one folder.

Every change writes a new version of a table and then moves the table's pointer, so a
reader or a failed job never sees half a change; the version before stays for readers
that have begun. The folder may be in any store that Spark reaches: pointers and versions
are handled through Spark's own file systems.
"""

from __future__ import annotations

import io
import os
import tarfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import schemas
from quarry.models import Engine, document_input
from quarry.operators import chunker, index, lookup, search
from quarry.operators.index import Index
from quarry.sources import files, shared

_TABLES = {"collections": schemas.COLLECTIONS, "documents": schemas.DOCUMENTS, "vectors": schemas.VECTORS + ", status string"}


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # tables

    def _pointer(self, name: str) -> str:
        return f"{self.root}/{name}.current"

    def _versions(self, name: str) -> list[str]:
        """Folders of the current version and the one before, if any."""
        return (shared.read_text(self.spark, self._pointer(name)) or "").split()

    def _move(self, name: str, version: str) -> None:
        """Point to ``version`` and delete the version before the last."""
        known = self._versions(name)
        shared.write_text(self.spark, self._pointer(name), "\n".join([version, *known[:1]]))
        for old in known[1:]:
            shared.delete(self.spark, f"{self.root}/{old}")

    def read(self, name: str) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            return self.spark.createDataFrame([], _TABLES[name])
        return self.spark.read.schema(_TABLES[name]).parquet(f"{self.root}/{versions[0]}")

    def write(self, name: str, df: DataFrame) -> None:
        version = f"{name}-{uuid.uuid4().hex}"
        columns = [c.strip().split(" ")[0] for c in _TABLES[name].split(", ")]
        df.select(*columns).write.parquet(f"{self.root}/{version}")
        self._move(name, version)

    def documents(self) -> DataFrame:
        """Documents with the description of their collection."""
        described = self.read("collections").select(F.col("name").alias("collection"), "context")
        return self.read("documents").join(described, "collection", "left")

    # upkeep

    def upsert_collection(self, name: str, path: str, glob: str = schemas.GLOB, context: str = "") -> int:
        rows = {r["name"]: r.asDict() for r in self.read("collections").collect()}
        own = rows.get(name, {"id": max((r["id"] for r in rows.values()), default=0) + 1})
        rows[name] = {"id": own["id"], "name": name, "path": path, "glob": glob, "context": context}
        order = ("id", "name", "path", "glob", "context")
        self.write("collections", self.spark.createDataFrame([tuple(r[c] for c in order) for r in rows.values()], schemas.COLLECTIONS))
        return own["id"]

    def index_collection(self, name: str, path: str, glob: str = schemas.GLOB, context: str = "", compat: bool = True) -> None:
        """Bring one collection up to date with its folder; see ``lookup.merge``."""
        self.upsert_collection(name, path, glob, context)
        self.merge_documents(name, files.scan(self.spark, path, name, glob), compat)

    def merge_documents(self, name: str, scanned: DataFrame, compat: bool = True) -> None:
        old = self.read("documents")
        own = lookup.merge(old.where(F.col("collection") == name), scanned, compat)
        columns = [c.strip().split(" ")[0] for c in schemas.DOCUMENTS.split(", ")]
        self.write("documents", old.where(F.col("collection") != name).unionByName(own.select(*columns)))

    def build_index(self) -> None:
        """The inverted index of the current documents; searches answer from it until the
        documents or collections change again."""
        version = f"index-{uuid.uuid4().hex}"
        base = [*self._versions("documents")[:1], *self._versions("collections")[:1]]
        index.build(self.documents(), f"{self.root}/{version}")
        shared.write_text(self.spark, f"{self.root}/{version}/base", "\n".join(base))
        self._move("index", version)

    def source(self) -> Index | DataFrame:
        """What searches read: the index if it is of the current documents, else these."""
        built = self._versions("index")
        if built:
            base = (shared.read_text(self.spark, f"{self.root}/{built[0]}/base") or "").split()
            if base == [*self._versions("documents")[:1], *self._versions("collections")[:1]]:
                return index.load(self.spark, f"{self.root}/{built[0]}")
        return self.documents()

    def chunk(self) -> None:
        """Chunks, without vectors, for contents that have none yet."""
        have = self.read("vectors")
        missing = self.read("documents").where("active").join(have.select("hash").distinct(), "hash", "left_anti")
        fresh = chunker.chunk_documents(missing).select("*", F.lit(None).cast("array<float>").alias("vec"), F.lit("new").alias("status"))
        self.write("vectors", have.unionByName(fresh))

    def embed(self, engine: Engine, limit: int | None = None) -> int:
        """Vectors for chunks without one, of at most ``limit`` contents. A chunk that
        fails is marked and not tried again. Returns the contents left."""
        self.chunk()
        have, docs = self.read("vectors"), self.read("documents")
        todo = have.where("status = 'new'").select("hash").distinct().orderBy("hash")
        todo = todo.limit(limit) if limit else todo
        titles = search.one_document(docs.withColumn("context", F.lit(""))).select("hash", "title")
        work = have.where("status = 'new'").join(todo, "hash", "left_semi").join(titles, "hash", "left")

        def run(frames):
            import pandas as pd

            for pdf in frames:
                out = []
                for title, body in zip(pdf["title"], pdf["text"]):
                    try:
                        out.append(([float(x) for x in engine.embed(document_input(title or "", body or ""), False)], "done"))
                    except Exception:  # a model may fail in its own ways; the chunk is marked
                        out.append((None, "failed"))
                yield pd.DataFrame({"hash": pdf["hash"], "seq": pdf["seq"], "pos": pdf["pos"], "text": pdf["text"], "vec": [v for v, _ in out], "status": [s for _, s in out]})

        done = work.mapInPandas(run, schemas.VECTORS + ", status string")
        rest = have.join(done.select("hash", "seq"), ["hash", "seq"], "left_anti") if limit is None else have.join(work.select("hash", "seq"), ["hash", "seq"], "left_anti")
        self.write("vectors", rest.unionByName(done))
        return lookup.unembedded(self.read("documents"), self.read("vectors")).count()

    def sync(self, config: dict, engine: Engine | None = None, compat: bool = True) -> list[str]:
        """Index every configured collection, build the inverted index, then embed. Returns
        what went wrong; a collection that fails does not stop the others."""
        errors = []
        for c in config["collections"]:
            try:
                self.index_collection(c["name"], c["path"], c.get("glob") or schemas.GLOB, c.get("context") or "", compat)
            except (OSError, ValueError) as e:
                errors.append(f"{c['name']}: {e}")
        if not self.read("documents").isEmpty():
            self.build_index()
        if engine is not None:
            self.embed(engine)
        return errors

    def status(self) -> dict:
        return lookup.status(self.read("collections"), self.read("documents"), self.read("vectors")).first().asDict()

    # bundles

    def export(self, config: dict, path: str) -> None:
        """A tar.gz at the local ``path`` with the current tables and the configuration,
        collection paths cut to their last part."""
        short = {**config, "collections": [{**c, "path": os.path.basename(c["path"].rstrip("/"))} for c in config["collections"]]}
        with tarfile.open(path, "w:gz") as tar:

            def add(name: str, data: bytes) -> None:
                entry = tarfile.TarInfo(name)
                entry.size = len(data)
                tar.addfile(entry, io.BytesIO(data))

            add("index.yml", files.config_text(short).encode("utf-8"))
            for name in _TABLES:
                for version in self._versions(name)[:1]:
                    add(f"{name}.current", version.encode("utf-8"))
                    for part in shared.listed(self.spark, f"{self.root}/{version}"):
                        add(f"{version}/{part}", shared.read_bytes(self.spark, f"{self.root}/{version}/{part}"))

    def restore(self, path: str) -> dict:
        """Replace this index by a bundle; other entries are passed over."""
        config, moved = None, {}
        with tarfile.open(path, "r:gz") as tar:
            for entry in tar:
                folder, _, part = entry.name.partition("/")
                if not entry.isfile() or ".." in entry.name.split("/"):
                    continue
                if entry.name == "index.yml":
                    config = tar.extractfile(entry).read().decode("utf-8")
                elif entry.name.removesuffix(".current") in _TABLES and entry.name.endswith(".current"):
                    moved[entry.name.removesuffix(".current")] = tar.extractfile(entry).read().decode("utf-8").strip()
                elif part and folder.split("-")[0] in _TABLES:
                    shared.write_bytes(self.spark, f"{self.root}/{entry.name}", tar.extractfile(entry).read())
        for name, version in moved.items():
            self._move(name, version)
        return files.parse_config(config)
