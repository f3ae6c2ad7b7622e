"""Version algebra over an operation log: rows of (key columns, seq, kind, payload), kind 1 = put, 0 = delete.

Two orders hold everywhere: the snapshot filter comes before the newest version is chosen, the tombstone filter after.
Filters on the raw key commute with both and should come first, where they reach the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _key(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def as_of(oplog: DataFrame, snapshot: int | None, seq: str = "seq") -> DataFrame:
    return oplog if snapshot is None else oplog.where(F.col(seq) <= snapshot)


def newest(oplog: DataFrame, keys: str | Sequence[str], seq: str = "seq", kind: str = "kind", ties: Sequence[Column] = ()) -> DataFrame:
    """The newest entry of each key, tombstones included: a rank filter, which Spark limits before the shuffle."""
    w = W.partitionBy(*_key(keys)).orderBy(F.col(seq).desc(), F.col(kind).desc(), *ties)
    return oplog.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def collapse_dense(oplog: DataFrame, keys: str | Sequence[str], snapshot: int | None = None, seq: str = "seq", kind: str = "kind", ties: Sequence[Column] = ()) -> DataFrame:
    """Visible rows at a snapshot where most keys have one version: rows are dealt by key as they are, and sorted once, behind
    the shuffle. ``collapse`` sorts before it too, which pays only if it merges rows."""
    key = _key(keys)
    return newest(as_of(oplog, snapshot, seq).repartition(*key), key, seq, kind, ties).where(F.col(kind) == 1)


def collapse(oplog: DataFrame, keys: str | Sequence[str], snapshot: int | None = None, seq: str = "seq", kind: str = "kind") -> DataFrame:
    """Visible rows at a snapshot by partial aggregation: one row a key and task is shuffled, however many versions there are.

    For keys with few versions ``collapse_dense`` is cheaper."""
    key = _key(keys)
    rest = [c for c in oplog.columns if c not in key]
    best = as_of(oplog, snapshot, seq).groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(seq, kind)).alias("__x"))
    return best.select(*key, "__x.*").where(F.col(kind) == 1).select(*oplog.columns)


def collapse_window(oplog: DataFrame, keys: str | Sequence[str], snapshot: int | None = None, seq: str = "seq", kind: str = "kind") -> DataFrame:
    """Visible rows at a snapshot by a window rank."""
    return newest(as_of(oplog, snapshot, seq), keys, seq, kind).where(F.col(kind) == 1)


def history(oplog: DataFrame, keys: str | Sequence[str], seq: str = "seq", kind: str = "kind") -> DataFrame:
    """All versions with ``version``: 1 for the newest of its key."""
    w = W.partitionBy(*_key(keys)).orderBy(F.col(seq).desc(), F.col(kind).desc())
    return oplog.withColumn("version", F.row_number().over(w).cast("long"))


def _newer(keys: str | Sequence[str], seq: str, kind: str) -> Column:
    return F.lag(seq).over(W.partitionBy(*_key(keys)).orderBy(F.col(seq).desc(), F.col(kind).desc()))


def retained(oplog: DataFrame, keys: str | Sequence[str], oldest: int, seq: str = "seq", kind: str = "kind") -> DataFrame:
    """Compaction: an entry goes only if a newer one of its key is visible to the oldest live snapshot."""
    return oplog.withColumn("__newer", _newer(keys, seq, kind)).where(F.col("__newer").isNull() | (F.col("__newer") > oldest)).drop("__newer")


def dropped(oplog: DataFrame, keys: str | Sequence[str], oldest: int, seq: str = "seq", kind: str = "kind") -> DataFrame:
    return oplog.withColumn("__newer", _newer(keys, seq, kind)).where(F.col("__newer") <= oldest).drop("__newer")


def _inside(key: Column, limits: Sequence[tuple]) -> Column:
    """Whether a key lies in one of the closed ranges: they are merged and sorted, and the last start not above the key is
    found among them. The ranges come from a manifest, a row a file; their list goes to the tasks with the plan."""
    merged: list[list] = []
    for a, b in sorted(limits):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    lit = lambda x: F.lit(bytearray(x) if isinstance(x, bytes) else x)

    def find(rows: list[list]) -> Column:
        if len(rows) == 1:
            return (key >= lit(rows[0][0])) & (key <= lit(rows[0][1]))
        half = len(rows) // 2
        return F.when(key < lit(rows[half][0]), find(rows[:half])).otherwise(find(rows[half:]))

    return find(merged)


#: Ranges that the plan holds at most.
RANGES = 512


def without_tombstones(compacted: DataFrame, oldest: int, deeper: Sequence[tuple] | None = None, key: str = "k", seq: str = "seq", kind: str = "kind") -> DataFrame:
    """Drop tombstones that every snapshot sees and that hide nothing. On a partial compaction ``deeper`` gives the
    ranges (smallest, largest) of deeper files, from the manifest: a tombstone inside one of them stays."""
    dead = (F.col(kind) == 0) & (F.col(seq) <= oldest)
    if not deeper:
        return compacted.where(~dead)
    # beyond the bound neighbours share a range: a few more tombstones stay, which is always right
    return compacted.where(~dead | _inside(F.col(key), thinned(deeper)))


def thinned(limits: Sequence[tuple], most: int = RANGES) -> list[tuple]:
    """At most ``most`` ranges that cover ``limits``: neighbours are joined where there are more."""
    rows = sorted(limits)
    step = -(-len(rows) // most)
    return [(rows[i][0], max(b for _, b in rows[i : i + step])) for i in range(0, len(rows), step)]


def merge_runs(runs: Sequence[DataFrame]) -> DataFrame:
    """Multiset union of sorted runs with ``run``: earlier runs win ties of key and sequence."""
    out = runs[0].withColumn("run", F.lit(0))
    for i, r in enumerate(runs[1:], 1):
        out = out.unionByName(r.withColumn("run", F.lit(i)))
    return out
