"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import shared

T = TypeVar("T")
#: Rows of one Arrow batch handed to Python; bytes bound it too.
ARROW_ROWS = 256


def bounded_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the Arrow batches of later Python stages by rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


_MADE: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    _MADE.append(shared.new_folder(spark, name))
    return _MADE[-1]


def clean(spark: SparkSession) -> int:
    """Delete all intermediate tables that this process has made; call it when the results that read them are written."""
    return sum(_delete(spark, _MADE.pop()) for _ in range(len(_MADE)))


def _delete(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: While a table is written: Spark deletes the shuffle files of the job when it ends, since the table takes their place, and
#: keeps no more than this of its plan's text, in which lists of constants would fill the driver's memory.
_WHILE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxPlanStringLength": "50000"}


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later stages start from durable files."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = {k: spark.conf.get(k) for k in _WHILE}
    try:
        for k, v in _WHILE.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with columns c0, c1, ..., and their own names: no column of the caller's can clash with an operator's own."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), df.columns


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by ``cut`` that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        if "/tidemark-" in folder:
            _delete(spark, folder)


_HELD: dict = {}


def held(key: tuple, make: Callable[[], T]) -> T:
    """What a Python worker keeps between tasks. It keeps one thing: another operator's takes its place."""
    if key not in _HELD:
        _HELD.clear()
        pa.default_memory_pool().release_unused()
        _HELD[key] = make()
    return _HELD[key]


def wanted(of: DataFrame, value: str, most: int = 1 << 19) -> Column:
    """A map-side filter on the column ``value``: values in ``of`` always pass, others seldom while ``of`` is small against
    ``most`` bits, which bounds the filter (it then passes more, and the join behind it does the work)."""
    words = most // 64
    bucket = F.xxhash64(value).bitwiseAND(F.lit(most - 1))
    out = [0] * words
    for w, m in of.select(bucket.alias("k")).groupBy(F.shiftright("k", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(k & 63 as int)))").alias("m")).collect():
        out[w] = m
    found = F.from_json(F.lit(str(out)), "array<bigint>")[F.shiftright(bucket, 6).cast("int")]
    return found.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bucket.bitwiseAND(F.lit(63)).cast("int"))) != 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
