"""Manifests of tables that are kept up by batches: small JSON files, one a version, committed by a rename."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Versions:
    """The manifests under folder, in any file system that Spark writes to. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def all(self) -> list[int]:
        at = self.path(f"{self.folder}/manifest")
        names = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def read(self, version: int) -> dict:
        stream = self.fs.open(self._file(version))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def last(self) -> dict | None:
        versions = self.all()
        return self.read(versions[-1]) if versions else None

    def commit(self, manifest: dict) -> None:
        """Makes manifest["version"] the last one: wholly, or not at all where another writer has taken the number."""
        final = self._file(manifest["version"])
        at = self.path(f"{self.folder}/manifest/_{uuid.uuid4().hex}")
        stream = self.fs.create(at)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if self.fs.exists(final) or not self.fs.rename(at, final):
            raise RuntimeError(f"version {manifest['version']} was committed by another writer")

    def drop(self, version: int) -> None:
        self.fs.delete(self._file(version), False)

    def _file(self, version: int):
        return self.path(f"{self.folder}/manifest/{version:08d}.json")
