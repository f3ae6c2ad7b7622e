"""File-range algebra over a manifest: rows of (level, number, size, num_entries, smallest, largest)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators.scan import _placed

LEVELS = 6
#: Bytes that level 1 may hold; each deeper level ten times more.
LEVEL_BYTES = 256 << 20


def overlaps(lo, hi) -> Column:
    """Files whose closed range meets [lo, hi]; None is unbounded."""
    out = F.lit(True)
    if hi is not None:
        out &= F.col("smallest") <= hi
    if lo is not None:
        out &= F.col("largest") >= lo
    return out


def find_file(files: DataFrame, key) -> DataFrame:
    """The first file, in order of its range, whose largest key is not below ``key``; no row if none."""
    return files.where(F.col("largest") >= key).orderBy("largest", "number").limit(1)


def bounds(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.min("smallest").alias("smallest"), F.max("largest").alias("largest"))


def islands(files: DataFrame) -> DataFrame:
    """``files`` with ``island``: the number, from 0, of the run of overlapping files that a file of its level belongs to.

    It is the fixpoint of widening a range by all files that it touches."""
    by = W.partitionBy("level").orderBy("smallest", "largest", "number")
    before = F.max("largest").over(by.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("smallest") > before), 1).otherwise(0)
    marked = files.withColumn("__fresh", fresh)
    return marked.withColumn("island", (F.sum("__fresh").over(by.rowsBetween(W.unboundedPreceding, 0)) - 1).cast("long")).drop("__fresh")


def overlap_closure(files: DataFrame, level: int, lo, hi) -> DataFrame:
    """All files of a level that overlap [lo, hi], widened to a fixpoint."""
    marked = islands(files.where(F.col("level") == level))
    hit = marked.where(overlaps(lo, hi)).select("island").distinct()
    return marked.join(hit, "island", "left_semi").drop("island")


def levels(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count(F.lit(1)).alias("files"), F.sum("size").cast("long").alias("bytes"))


def scores(files: DataFrame, level_bytes: int = LEVEL_BYTES) -> DataFrame:
    """Compaction score: files at level 0, bytes against the level's limit below."""
    limit = F.lit(float(level_bytes)) * F.pow(F.lit(10.0), F.col("level") - 1)
    return levels(files).select("level", F.when(F.col("level") == 0, F.col("files").cast("double")).otherwise(F.col("bytes") / limit).alias("score"))


def next_level_overlap(files: DataFrame) -> DataFrame:
    """Per file of levels 1 and deeper, the bytes of the next level that its range overlaps."""
    low = files.where(F.col("level").between(1, LEVELS - 2)).alias("a")
    on = (F.col("b.level") == F.col("a.level") + 1) & (F.col("b.smallest") <= F.col("a.largest")) & (F.col("b.largest") >= F.col("a.smallest"))
    return low.join(files.alias("b"), on, "left").groupBy("a.level", "a.number").agg(F.coalesce(F.sum("b.size"), F.lit(0)).cast("long").alias("bytes"))


def max_next_level_overlap(files: DataFrame) -> DataFrame:
    """One row: the most bytes of the next level that a file of levels 1 and deeper overlaps (0 without files)."""
    return next_level_overlap(files).agg(F.coalesce(F.max("bytes"), F.lit(0)).cast("long").alias("bytes"))


#: Ranges that may be broadcast; more are cut into cells that keys and ranges share.
RANGES = 10_000


def approximate_sizes(entries: DataFrame, ranges: DataFrame, key: str = "k", size: str = "bytes") -> DataFrame:
    """Exact bytes of entries in each range [start, limit) (columns range_id, start, limit); 0 for empty ranges.

    Entries are summed per key first. Up to ``RANGES`` ranges are broadcast; with more, the bytes below every key and every
    bound are running sums over range partitions, and a range's size is the difference of two, so that no join grows."""
    if ranges.limit(RANGES + 1).count() <= RANGES:
        on = (F.col(key) >= F.col("start")) & (F.col(key) < F.col("limit"))
        found = entries.join(F.broadcast(ranges), on).groupBy("range_id").agg(F.sum(size).cast("long").alias("bytes"))
    else:
        found = _by_prefix_sums(entries, ranges, key, size)
    return ranges.select("range_id").join(found, "range_id", "left").select("range_id", F.coalesce("bytes", F.lit(0).cast("long")).alias("bytes"))


def _by_prefix_sums(entries: DataFrame, ranges: DataFrame, key: str, size: str) -> DataFrame:
    sums = entries.groupBy(F.col(key).alias("k")).agg(F.sum(size).alias("n"))
    edges = ranges.where("start < limit")
    marks = edges.select(F.col("start").alias("k"), "range_id", F.lit(-1).alias("sign")).union(edges.select("limit", "range_id", F.lit(1)))
    both = marks.withColumn("n", F.lit(0).cast("long")).unionByName(sums.select("k", "n"), allowMissingColumns=True)
    placed = _placed(both, F.col("k").asc(), F.col("sign").asc_nulls_last())  # a bound before a key that equals it
    part = F.shiftright("__id", 33).cast("int")
    totals = {r.p: r.n for r in placed.groupBy(part.alias("p")).agg(F.sum("n").alias("n")).collect()}
    before, at = [], 0
    for p in range(max(totals, default=0) + 1):
        before.append(at)
        at += totals.get(p, 0)
    run = F.sum("n").over(W.partitionBy("p").orderBy("__id").rowsBetween(W.unboundedPreceding, 0))
    below = placed.withColumn("p", part).withColumn("below", run + F.from_json(F.lit(str(before)), "array<bigint>")[F.col("p")])
    return below.where("sign is not null").groupBy("range_id").agg(F.sum(F.col("sign") * F.col("below")).cast("long").alias("bytes"))


def trivial_moves(files: DataFrame, level: int, grandparents: int = 10) -> DataFrame:
    """Files of a level that overlap none of the next, and at most ``grandparents`` of the one below it: they may move down by
    a change of the manifest alone."""
    touch = lambda x, y: (F.col(f"{y}.smallest") <= F.col(f"{x}.largest")) & (F.col(f"{y}.largest") >= F.col(f"{x}.smallest"))
    at = lambda n, name: files.where(F.col("level") == n).alias(name)
    free = at(level, "a").join(at(level + 1, "b"), touch("a", "b"), "left_anti").alias("a")
    many = free.join(at(level + 2, "c"), touch("a", "c")).groupBy("a.number").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > grandparents)
    return free.join(many, "number", "left_anti")


def joint_bounds(a: DataFrame, b: DataFrame) -> DataFrame:
    """Least and largest key of two sets of files."""
    return a.select("smallest", "largest").union(b.select("smallest", "largest")).agg(F.min("smallest").alias("smallest"), F.max("largest").alias("largest"))
