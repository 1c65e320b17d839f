"""A twin in a folder of Parquet files, with all-or-nothing writes.

A write puts its rows into new files and then publishes the next manifest,
which names the files that count: it is written aside and renamed to its own
number, which fails if another writer has taken that number. Readers see all of
a write or none of it, and a reader keeps the snapshot it has opened. Of
writers that started from the same snapshot one succeeds; the others get a
Conflict, have written nothing that counts, and may refresh and try again.
Entities and relations are kept in versions of which the latest counts.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.model import SCHEMAS, Twin

_VERSIONED = {"entities": "key", "relations": "idx"}


#: Manifests that stay behind the latest, for readers that are about to open them.
_BEHIND = 20


class Conflict(RuntimeError):
    """Another writer has committed since the snapshot was opened."""


class Store:
    """Tables under a root folder, in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.refresh()

    def refresh(self) -> None:
        """Takes up what has been committed since."""
        found = self._numbers()
        self.manifest = {"version": 0, "files": {}, "streams": {}}
        if found:
            stream = self._fs.open(self._path(f"{self.root}/manifest-{max(found)}.json"))
            try:
                self.manifest = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()

    def _numbers(self) -> list[int]:
        """Numbers of the published manifests."""
        names = [s.getPath().getName() for s in self._fs.globStatus(self._path(f"{self.root}/manifest-*.json")) or ()]
        return [int(n[9:-5]) for n in names if n[9:-5].isdigit()]

    def table(self, name: str) -> DataFrame:
        files = [f"{self.root}/{f}" for f in self.manifest["files"].get(name, [])]
        schema = SCHEMAS[name] + (", version bigint" if name in _VERSIONED else "")
        rows = self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)
        if name in _VERSIONED:
            key = _VERSIONED[name]
            rest = [c for c in rows.columns if c not in (key, "version")]
            rows = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "version").alias("_r")).select(key, "_r.*")
        elif name == "series":
            rows = rows.groupBy("sid").agg(F.min_by(F.struct("name", "entity", "signal", "ord"), "ord").alias("_r")).select("sid", "_r.*")
        return rows

    def twin(self) -> Twin:
        """The snapshot that was opened last."""
        return Twin(self.spark, **{name: self.table(name) for name in SCHEMAS})

    def commit(self, replace: bool = False, stream: tuple[str, int] | None = None, **tables: DataFrame | list) -> int:
        """Writes rows of tables and makes them count; replace: instead of what the tables had. Returns the version; raises Conflict.

        stream names a query and its epoch: an epoch that has been committed is
        not written again.
        """
        if stream is not None and self.manifest["streams"].get(stream[0], -1) >= stream[1]:
            return self.manifest["version"]
        version = self.manifest["version"] + 1
        files = {k: list(v) for k, v in self.manifest["files"].items()}
        for name, rows in tables.items():
            df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, SCHEMAS[name])
            if name in _VERSIONED:
                df = df.withColumn("version", F.lit(version).cast("bigint"))
            file = f"{name}/{version}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{file}")
            files[name] = [file] if replace else [*files.get(name, []), file]
        streams = self.manifest["streams"] | ({stream[0]: stream[1]} if stream else {})
        self._publish({"version": version, "files": files, "streams": streams})
        return version

    def _publish(self, manifest: dict) -> None:
        fresh, name = self._path(f"{self.root}/writing-{uuid.uuid4().hex}"), self._path(f"{self.root}/manifest-{manifest['version']}.json")
        out = self._fs.create(fresh)
        try:
            out.write(json.dumps(manifest).encode())
        finally:
            out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(name.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            if max(self._numbers(), default=0) >= manifest["version"]:
                raise Conflict(f"version {manifest['version']} has been committed by another writer")
            try:
                context.rename(fresh, name, self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
            except Py4JJavaError as e:
                if "FileAlreadyExistsException" not in str(e.java_exception):
                    raise
                raise Conflict(f"version {manifest['version']} has been committed by another writer") from e
        finally:
            self._fs.delete(fresh, False)
        self.manifest = manifest
        for old in self._numbers():
            if old <= manifest["version"] - _BEHIND:
                self._fs.delete(self._path(f"{self.root}/manifest-{old}.json"), False)
