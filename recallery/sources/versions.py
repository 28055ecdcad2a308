"""Versions of a stored table or set of tables: folders of files, and small numbered manifests that say which of them count.

A writer puts its files into a folder of its own and commits by adding the next manifest. A manifest appears whole or not at
all, and of two writers that want one number the second fails, so a reader sees one version of everything, whatever
dies in between. Files that no manifest names are never read.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Versions:
    """The manifests under ``path``, in any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self.files = self._path(path).getFileSystem(self.conf)

    def folder(self) -> str:
        """A new folder for a writer's files, relative to the path."""
        return f"data/{uuid.uuid4().hex}"

    def numbers(self) -> list[int]:
        where = self._path(f"{self.path}/versions")
        if not self.files.exists(where):
            return []
        names = [f.getPath().getName() for f in self.files.listStatus(where)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def latest(self) -> tuple[int, dict | None]:
        """The number of the last version and its manifest; (0, None) if there is none."""
        numbers = self.numbers()
        return (numbers[-1], self.manifest(numbers[-1])) if numbers else (0, None)

    def manifest(self, number: int) -> dict:
        opened = self.files.open(self._path(f"{self.path}/versions/{number:012d}.json"))
        try:
            return json.loads(bytes(opened.readAllBytes()).decode())
        finally:
            opened.close()

    def commit(self, after: int, manifest: dict) -> bool:
        """Make a manifest the version behind ``after``; False if another writer has added that one already."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        temporary, final = self._path(f"{self.path}/versions/.{uuid.uuid4().hex}"), self._path(f"{self.path}/versions/{after + 1:012d}.json")
        out = self.files.create(temporary, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        never = gateway.new_array(kind, 1)
        never[0] = kind.NONE  # a rename that overwrites nothing
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self.conf).rename(temporary, final, never)
            return True
        except Py4JJavaError as e:
            self.files.delete(temporary, False)
            if self.files.exists(final):
                return False
            raise e

    def delete(self, folder: str) -> None:
        self.files.delete(self._path(f"{self.path}/{folder}"), True)

    def folders(self) -> list[str]:
        """All writers' folders, committed or not."""
        where = self._path(f"{self.path}/data")
        return [f"data/{f.getPath().getName()}" for f in self.files.listStatus(where)] if self.files.exists(where) else []
