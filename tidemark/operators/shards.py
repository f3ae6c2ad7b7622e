"""Range shards [lower, upper) of integer keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bounds(spark: SparkSession, lo: int, n: int, shards: int) -> DataFrame:
    """Equal-width shards of [lo, lo + n); the last takes the remainder."""
    width = n // shards
    last = F.col("id") == shards - 1
    return spark.range(shards).select(F.col("id").alias("shard_id"), (F.lit(lo) + F.col("id") * width).alias("lower"), F.when(last, F.lit(lo + n)).otherwise(F.lit(lo) + (F.col("id") + 1) * width).alias("upper"))


def route(key: Column, lo: int, n: int, shards: int) -> Column:
    """Shard of a key by arithmetic on the equal-width bounds; null if no shard holds it."""
    at = F.least(F.floor((key - lo) / max(n // shards, 1)), F.lit(shards - 1))
    return F.when((key >= lo) & (key < lo + n), at).cast("long")


#: Shards that a plan holds at most.
SHARDS = 4096


def route_by(df: DataFrame, key: str, shards: DataFrame) -> DataFrame:
    """``df`` with ``shard_id`` from a table of arbitrary bounds (shard_id, lower, upper) that don't overlap; keys outside all
    shards get null. The table comes to the driver, behind a check of its size, and each key finds its shard by halving."""
    rows = sorted(((r.lower, r.upper, r.shard_id) for r in shards.select("lower", "upper", "shard_id").limit(SHARDS + 1).collect()))
    if len(rows) > SHARDS:
        raise ValueError(f"more than {SHARDS} shards")
    lit = lambda x: F.lit(bytearray(x) if isinstance(x, (bytes, bytearray)) else x)
    kind = shards.schema["shard_id"].dataType

    def find(some: list[tuple]) -> Column:
        if len(some) == 1:
            lower, upper, shard = some[0]
            return F.when((F.col(key) >= lit(lower)) & (F.col(key) < lit(upper)), F.lit(shard).cast(kind))
        half = len(some) // 2
        return F.when(F.col(key) < lit(some[half][0]), find(some[:half])).otherwise(find(some[half:]))

    return df.withColumn("shard_id", find(rows) if rows else F.lit(None).cast(kind))


def round_robin(shard: Column, nodes: int) -> Column:
    """Node of a shard: even numbers in turn."""
    return F.pmod(shard, F.lit(nodes)) * 2
