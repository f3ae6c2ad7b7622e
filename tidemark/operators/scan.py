"""Reads over a view (one visible row a key): point gets, seeks, ranges, limits. Key filters precede the collapse."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.collapse import collapse


class View:
    """The visible state of an operation log at a snapshot. Every read pushes its key filter below the collapse.

    ``settled``: further rows of which each is the only one of its key, and none newer than the snapshot; they need no
    collapse, and so no shuffle."""

    def __init__(self, oplog: DataFrame, key: str = "k", snapshot: int | None = None, seq: str = "seq", kind: str = "kind", fold: Callable = collapse, settled: DataFrame | None = None) -> None:
        self.oplog, self.key, self.snapshot, self.seq, self.kind, self.fold, self.settled = oplog, key, snapshot, seq, kind, fold, settled

    def _visible(self, narrow: Callable[[DataFrame], DataFrame]) -> DataFrame:
        folded = self.fold(narrow(self.oplog), self.key, self.snapshot, self.seq, self.kind)
        return folded if self.settled is None else folded.unionByName(narrow(self.settled).where(F.col(self.kind) == 1))

    def rows(self, where: Column | None = None) -> DataFrame:
        return self._visible(lambda rows: rows if where is None else rows.where(where))

    def get(self, key) -> DataFrame:
        return self.rows(F.col(self.key) == key)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """Visible rows of a key set (column of the same name): a semi-join before the collapse."""
        asked = keys.select(self.key).distinct()
        return self._visible(lambda rows: rows.join(asked, self.key, "left_semi").select(*rows.columns))

    def scan(self, reverse: bool = False) -> DataFrame:
        return self.rows().orderBy(F.col(self.key).desc() if reverse else F.col(self.key))

    def between(self, start=None, limit=None, inclusive: bool = False) -> DataFrame:
        """[start, limit), or [start, limit] where ``inclusive``; None is unbounded."""
        where = F.lit(True)
        if start is not None:
            where &= F.col(self.key) >= start
        if limit is not None:
            where &= (F.col(self.key) <= limit) if inclusive else (F.col(self.key) < limit)
        return self.rows(where)

    def first(self, n: int) -> DataFrame:
        return self.scan().limit(n)

    def last(self, n: int) -> DataFrame:
        return self.scan(reverse=True).limit(n)

    def seek(self, target) -> DataFrame:
        """The first visible row at or after the target."""
        return self.rows(F.col(self.key) >= target).orderBy(self.key).limit(1)

    def next(self, key) -> DataFrame:
        return self.rows(F.col(self.key) > key).orderBy(self.key).limit(1)

    def prev(self, key) -> DataFrame:
        return self.rows(F.col(self.key) < key).orderBy(F.col(self.key).desc()).limit(1)

    def seek_many(self, targets: DataFrame, target: str = "target") -> DataFrame:
        """Per target the first visible key at or after it (null if none), for keys of any type that has an order."""
        least = targets.agg(F.min(target)).first()[0]
        keys = self.rows(None if least is None else F.col(self.key) >= F.lit(least)).select(F.col(self.key).alias("key"))
        return next_keys(keys, "key", targets, target)


#: Range partitions of ``ranked`` and ``next_keys``: bounds what the driver sees, a count or key each.
PLACES = 4096
_IN_PART = (1 << 33) - 1


def _placed(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` range-partitioned and sorted, with ``__id``: its partition in the upper bits, its place there in the lower 33.

    It is kept, since a second run of the same plan may draw other bounds; lost blocks are made again from the same ones."""
    parts = min(PLACES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()).persist()


def ranked(df: DataFrame, key: str, base: int = 1, name: str = "rn", desc: bool = False) -> DataFrame:
    """``df`` with its place in order of a unique column, from ``base``: places in range partitions, shifted by the number of
    rows before each. One shuffle, and no task holds more than its range."""
    order = F.col(key).desc() if desc else F.col(key).asc()
    placed = _placed(df, order)
    part = F.shiftright("__id", 33)
    counts = {r.p: r.n for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    shifts, at = [], base
    for p in range(max(counts, default=0) + 1):
        shifts.append(at)
        at += counts.get(p, 0)
    shift = F.from_json(F.lit(str(shifts)), "array<bigint>")[part.cast("int")]
    return placed.withColumn(name, F.col("__id").bitwiseAND(F.lit(_IN_PART)) + shift).drop("__id")


def next_keys(keys: DataFrame, key: str, targets: DataFrame, target: str = "target") -> DataFrame:
    """Per target the least key at or after it (null if none): keys and targets are ranged and sorted together; in a range
    the next key is a running minimum from its end, and behind its last key comes the first key of a later range."""
    both = keys.select(F.col(key).alias("k"), F.lit(False).alias("asked")).unionByName(targets.select(F.col(target).alias("k"), F.lit(True).alias("asked")).distinct())
    placed = _placed(both, F.col("k").asc(), F.col("asked").desc())  # a target before a key that equals it
    part = F.shiftright("__id", 33)
    firsts = {r.p: r.k for r in placed.where("not asked").groupBy(part.alias("p")).agg(F.min("k").alias("k")).collect()}
    later, following = [], None
    for p in range(max([-1, *firsts]), -1, -1):
        later.append((p, following))
        following = firsts.get(p, following)
    # parts behind the last key have no key after them, those before the first all have its first
    kind = both.schema["k"].dataType
    table = F.array(*[F.lit(x).cast(kind) for _, x in reversed(later)], F.lit(None).cast(kind))
    back = W.partitionBy("__p").orderBy(F.desc("__id")).rowsBetween(W.unboundedPreceding, 0)
    seen = placed.withColumn("__p", part.cast("int")).withColumn("own", F.min(F.when(~F.col("asked"), F.col("k"))).over(back))
    return seen.where("asked").select(F.col("k").alias(target), F.coalesce("own", F.get(table, F.col("__p"))).alias("found"))


def cursor(view: View, columns: Sequence[str] = (), page: int = 1000) -> Cursor:
    return Cursor(view, list(columns), page)


class Cursor:
    """A driver-side position over a view. It keeps only the current key and one page of rows, so turning round
    needs no repair, and a view of any size can be walked."""

    def __init__(self, view: View, columns: list[str], page: int) -> None:
        self.view, self.columns, self.page, self.row, self.ahead, self.forward = view, columns, page, None, [], True

    @property
    def valid(self) -> bool:
        return self.row is not None

    @property
    def key(self):
        return self.row[self.view.key]

    def _fill(self, where: Column | None, forward: bool) -> None:
        rows = self.view.rows(where)
        k = F.col(self.view.key)
        self.ahead = rows.orderBy(k if forward else k.desc()).limit(self.page).collect()[::-1]
        self.forward = forward
        self.row = self.ahead.pop() if self.ahead else None

    def seek_to_first(self) -> None:
        self._fill(None, True)

    def seek_to_last(self) -> None:
        self._fill(None, False)

    def seek(self, target) -> None:
        self._fill(F.col(self.view.key) >= F.lit(target), True)

    def _step(self, forward: bool) -> None:
        if self.ahead and self.forward == forward:
            self.row = self.ahead.pop()
        else:
            k, at = F.col(self.view.key), F.lit(self.key)
            self._fill(k > at if forward else k < at, forward)

    def next(self) -> None:
        self._step(True)

    def prev(self) -> None:
        self._step(False)
