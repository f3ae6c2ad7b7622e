"""Write batches: ordered puts and deletes that commit together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import varint_length
from tidemark.operators.scan import ranked
from tidemark.sources.errors import Corruption

OPLOG = "k binary, seq bigint, kind tinyint, v binary"
MAX_SEQ = (1 << 56) - 1


class WriteBatch:
    def __init__(self) -> None:
        self.rows: list[tuple[bytes, int, bytes | None]] = []

    def put(self, key: bytes, value: bytes) -> WriteBatch:
        self.rows.append((bytes(key), 1, bytes(value)))
        return self

    def delete(self, key: bytes) -> WriteBatch:
        self.rows.append((bytes(key), 0, None))
        return self

    def clear(self) -> None:
        self.rows.clear()

    def append(self, other: WriteBatch) -> WriteBatch:
        self.rows += other.rows
        return self

    def __len__(self) -> int:
        return len(self.rows)

    def approximate_size(self) -> int:
        """A 12-byte header, and per record a tag, lengths as varints, and the bytes."""
        size = 12
        for key, _, value in self.rows:
            size += 1 + sum(varint_length(len(x)) + len(x) for x in (key, value) if x is not None)
        return size

    def iterate(self, put: Callable[[bytes, bytes], None], delete: Callable[[bytes], None]) -> None:
        for key, kind, value in self.rows:
            put(key, value) if kind else delete(key)

    def oplog(self, spark: SparkSession, base: int) -> DataFrame:
        """The batch as rows whose sequence numbers start at ``base``."""
        return spark.createDataFrame([(k, base + i, kind, v) for i, (k, kind, v) in enumerate(self.rows)], OPLOG)


def sequenced(df: DataFrame, base: int, order: str) -> DataFrame:
    """Rows of a large batch with ``seq`` from ``base`` in order of a unique column of any type that has an order."""
    return ranked(df, order, base, "seq")


BROKEN = "rows with a null key, an impossible sequence number or kind, or a put without a value"


def _bad() -> Column:
    return F.col("k").isNull() | F.col("seq").isNull() | ~F.col("seq").between(0, MAX_SEQ) | F.col("kind").isNull() | ~F.col("kind").isin(0, 1) | ((F.col("kind") == 1) & F.col("v").isNull())


def validate(oplog: DataFrame) -> DataFrame:
    """The rows, or ``Corruption`` if any breaks the rules of an operation log: reads them all."""
    if not oplog.where(_bad()).isEmpty():
        raise Corruption(BROKEN)
    return oplog


def checked(oplog: DataFrame) -> DataFrame:
    """The rows; whoever reads them fails at the first that breaks the rules, so that no pass of its own is needed."""
    sound = F.when(_bad(), F.raise_error(F.lit(BROKEN)).cast("tinyint")).otherwise(F.col("kind").cast("tinyint"))
    return oplog.withColumn("kind", sound)


def dump(oplog: DataFrame) -> DataFrame:
    """One printable line per entry, and its place in internal order."""
    line = F.format_string("%s @ %d : %s => %s", F.hex("k"), "seq", F.when(F.col("kind") == 1, "put").otherwise("del"), F.coalesce(F.hex("v"), F.lit("")))
    return oplog.select("k", "seq", "kind", line.alias("line")).orderBy("k", F.col("seq").desc(), F.col("kind").desc()).select("line")


def dump_files(files: DataFrame) -> DataFrame:
    """One printable line per live file of a manifest (``OrderedStore.files``), in order of level and number."""
    line = F.format_string("level %d : %d : %d bytes : %d entries : %s .. %s : seq %d .. %d", "level", "number", "size", "num_entries", F.hex("smallest"), F.hex("largest"), "min_seq", "max_seq")
    return files.select("level", "number", line.alias("line")).orderBy("level", "number").select("line")
