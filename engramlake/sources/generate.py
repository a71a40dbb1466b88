"""Seeded example indexes for measuring: uniform unit vectors, a hot part of the vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.schema import ENTRY_TYPES


def memories(spark: SparkSession, n: int = 5000, dimension: int = 1536, presets: int = 8, active: float = 0.8, seed: int = 7) -> DataFrame:
    """Index rows: active in share `active`, four types in turn, direction uniform on the sphere."""
    i = F.col("id")
    raw = F.array(*[F.randn(seed + d) for d in range(dimension)]) if dimension <= 16 else F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda d: _normal(i, d, seed))
    rows = spark.range(n).withColumn("raw", raw)
    length = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("length", length).select(
        i.alias("memory_id"), F.concat(F.lit("preset-"), (i % presets).cast("string")).alias("preset_id"), F.lit(None).cast("string").alias("source_conversation_id"),
        F.when(_uniform(i, F.lit(-1), seed) < active, "active").otherwise("archived").alias("status"), F.element_at(F.array(*map(F.lit, ENTRY_TYPES[:4])), (i % 4 + 1).cast("int")).alias("type"),
        F.transform("raw", lambda x: (x / F.col("length")).cast("float")).alias("embedding"),
    )


def _uniform(i, d, seed: int):
    """In (0, 1), a function of its arguments alone."""
    return (F.pmod(F.xxhash64(i, d, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _normal(i, d, seed: int):
    return F.sqrt(-2 * F.log(_uniform(i, d, seed))) * F.cos(6.283185307179586 * _uniform(i, d + 100_003, seed))


def keywords(memory_rows: DataFrame, vocabulary: int = 100, hot: float = 0.1, hot_share: float = 0.8, seed: int = 7) -> DataFrame:
    """Two keywords a memory; the hot part of the vocabulary takes hot_share of them."""
    i, few = F.col("memory_id"), int(vocabulary * hot)
    pick = lambda k: F.when(_uniform(i, F.lit(200_000 + k), seed) < hot_share, F.floor(_uniform(i, F.lit(300_000 + k), seed) * few)).otherwise(few + F.floor(_uniform(i, F.lit(400_000 + k), seed) * (vocabulary - few)))
    return memory_rows.select("memory_id", F.explode(F.array_distinct(F.array(pick(0), pick(1)))).alias("k")).select("memory_id", F.concat(F.lit("word-"), F.col("k").cast("string")).alias("keyword"))
