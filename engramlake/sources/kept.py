"""Intermediate tables of one run of an operator, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; where it names none, one in the warehouse, which is shared as well."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir')}/_tables"
    return where.rstrip("/")


class Kept:
    """Tables that cut lineage and survive lost executors; :meth:`result` writes the last one beside them and removes the others."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str = "table") -> DataFrame:
        return self._written(df, f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}")

    def result(self, df: DataFrame, name: str = "result") -> DataFrame:
        out = self._written(df, f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return out

    def _written(self, df: DataFrame, path: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
