"""Versions of tables in a shared folder.

A writer puts its tables under a name of its own, counts them, and publishes them by
renaming one manifest to the next number.  The rename fails if that number exists, so of
two writers that started from the same version one wins and the other gets a
:class:`Conflict`.  A writer that is lost at any step leaves files that no manifest names:
what was published before stays readable, and the next run goes on from it.  Readers
hold the version they opened, whatever is published meanwhile.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer published the version first."""


@dataclass(frozen=True)
class Version:
    """One published state: its number, where its tables lie, their row counts and what else the writer noted."""

    spark: SparkSession
    number: int
    data: str
    counts: dict[str, int]
    schemas: dict[str, str]
    facts: dict = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(json.loads(self.schemas[name]))).parquet(f"{self.data}/{name}")


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs, fs.makeQualified(path)

    def numbers(self) -> list[int]:
        """Published versions, ascending."""
        fs, root = self._path()
        names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n.removeprefix("manifest-").removesuffix(".json")) for n in names if n.startswith("manifest-"))

    def open(self, number: int) -> Version:
        fs, path = self._path(f"manifest-{number:08d}.json")
        stream = fs.open(path)
        try:
            noted = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(self.spark, noted["version"], f"{self.root}/{noted['data']}", noted["counts"], noted["schemas"], noted["facts"])

    def newest(self) -> Version | None:
        numbers = self.numbers()
        return self.open(numbers[-1]) if numbers else None

    def publish(self, tables: dict[str, DataFrame], *, base: Version | None, facts: dict | None = None, expected: dict[str, int] | None = None, partition_by: dict[str, str] | None = None) -> Version:
        """Write the tables and publish them as the version after base (None: the first one).

        expected: row counts that the written tables must have; another count publishes nothing.
        """
        data, counts, schemas = f"data-{uuid.uuid4().hex}", {}, {name: df.schema.json() for name, df in tables.items()}
        for name, df in tables.items():
            writer = df.write.option("compression", "zstd")
            if by := (partition_by or {}).get(name):
                writer = writer.partitionBy(by)
            writer.parquet(f"{self.root}/{data}/{name}")
            counts[name] = self.spark.read.schema(df.schema).parquet(f"{self.root}/{data}/{name}").count()
        for name, n in (expected or {}).items():
            if counts[name] != n:
                raise RuntimeError(f"{name} has {counts[name]} rows, not {n}; nothing is published")
        number = 1 + (base.number if base else 0)
        self._rename({"version": number, "data": data, "counts": counts, "schemas": schemas, "facts": facts or {}}, number)
        return self.open(number)

    def _rename(self, noted: dict, number: int) -> None:
        fs, own = self._path(f"unpublished-{uuid.uuid4().hex}")
        stream = fs.create(own, False)
        try:
            stream.write(bytearray(json.dumps(noted).encode("utf-8")))
        finally:
            stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri(), self.spark._jsc.hadoopConfiguration())
        never_over = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(own, self._path(f"manifest-{number:08d}.json")[1], never_over)
        except Exception as e:
            text = str(e) if isinstance(e, PySparkException) else str(getattr(e, "java_exception", e))
            if "FileAlreadyExists" in text or number in self.numbers():
                raise Conflict(f"version {number} of {self.root} was published by another writer") from e
            raise

    def retire(self, keep: int = 2) -> None:
        """Remove all but the newest versions and their data; what lost writers left is not touched."""
        numbers = self.numbers()
        for n in numbers[:-keep]:
            old = self.open(n)
            self._path(f"manifest-{n:08d}.json")[0].delete(self._path(f"manifest-{n:08d}.json")[1], False)
            fs, path = self._path(old.data.removeprefix(f"{self.root}/"))
            fs.delete(path, True)
