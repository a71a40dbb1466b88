"""What several operators need: Arrow passes, materialised tables, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of an Arrow batch on its way to a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20
_BY_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def by_bytes(spark: SparkSession) -> None:
    """Python workers get a few megabytes of whole rows at a time; one setting for all operators, which changes no result."""
    if spark.conf.get(_BY_BYTES, None) != str(BATCH_BYTES):
        spark.conf.set(_BY_BYTES, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; where it names none, one in the warehouse, which is shared as well."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir')}/_tables"
    return where.rstrip("/")


class Tables:
    """The intermediate tables of one run of an operator, in a folder of their own within the shared one.

    A table cuts lineage and survives lost executors; what was shuffled for it goes
    as soon as it is written.  :meth:`drop` removes a table that nothing reads any
    more, :meth:`result` writes the last one beside the folder and removes all others.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.places = spark, f"{shared_dir(spark)}/run-{uuid.uuid4().hex}", {}

    def stored(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        place = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        self.places.setdefault(name, []).append(place)
        return _written(df, place, partition_by)

    def drop(self, name: str) -> None:
        for place in self.places.pop(name, []):
            remove(self.spark, place)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        out = _written(df, f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}")
        remove(self.spark, self.folder)
        return out


def _written(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """The table; shuffle files of this write are removed at its end, not when the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_FREE_SHUFFLES, None)
    writer = df.write.option("compression", "zstd")
    conf.set(_FREE_SHUFFLES, "true")
    try:
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    finally:  # the session's other frames may be run again, and keep theirs
        conf.unset(_FREE_SHUFFLES) if before is None else conf.set(_FREE_SHUFFLES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def text_batches(df: DataFrame, id_col: str, text_col: str, one: Callable, schema: str, *more: str) -> DataFrame:
    """Apply one(text, *more) -> tuple to each row, in Arrow batches, next to id_col."""
    by_bytes(df.sparkSession)
    fields = T._parse_datatype_string(schema).fields
    kind = T.StructType([df.schema[id_col], *fields])
    arrow = to_arrow_schema(kind)

    def run(batches):
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[1:]]
            rows = [one(*x) for x in zip(*columns)]
            out = [pa.array(c, type=f.type) for c, f in zip(zip(*rows), list(arrow)[1:])] if rows else [pa.array([], type=f.type) for f in list(arrow)[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), *out], schema=arrow)

    return df.select(F.col(id_col), F.col(text_col), *more).mapInArrow(run, kind)


def connected_components(edges: DataFrame, tables: Tables, rounds: int = 60) -> DataFrame:
    """(node, root): root is the least node of the component; nodes without an edge do not appear.

    Each round links every node to its least neighbour's root, lets a root learn the
    least label of its members, and halves the chains.  Labels are written as a
    table each round.  Unlike a checkpoint, a table does not carry its partitioning
    on, so both sides of a join are shuffled and Spark can split a node with very
    many edges.  Compressed, labels look small enough to be sent whole through the
    driver, where they would be held unpacked, so each join is dealt.
    """
    both = edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u <> v")
    both = tables.stored(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = tables.stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("root")).withColumnRenamed("u", "node"), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("v"), F.col("root").alias("rv")).hint("merge"), "v").groupBy("u").agg(F.min("rv").alias("near"))
        stepped = labels.join(near.hint("merge"), labels.node == near.u, "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("low"))
        best = stepped.groupBy("root").agg(F.min("low").alias("best"))
        hooked = stepped.join(best.hint("merge"), "root").select("node", F.col("root").alias("old"), F.least("low", "best").alias("root"))
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = tables.stored(hooked.join(up.hint("merge"), "root", "left").select("node", "old", F.least("root", F.coalesce("up", "root")).alias("root")), "labels")
        moved = new.where("root <> old").limit(1).count()
        labels = new.select("node", "root")
        if not moved:
            return labels
    raise RuntimeError(f"components not settled after {rounds} rounds")
