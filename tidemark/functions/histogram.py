"""Histograms with fixed bucket limits: built map-side, merged by addition, read by linear interpolation.

A histogram is a table of at most ``len(LIMITS)`` rows a group: bucket, n, lo, hi (least and greatest value), total, squares.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.search import rank_of

#: Upper limits of the buckets: 1 to 9, then in each decade from 10 to 10^9 these sixteen steps, and one for all the rest.
STEPS = [10, 12, 14, 16, 18, 20, 25, 30, 35, 40, 45, 50, 60, 70, 80, 90]
LIMITS = [float(x) for x in range(1, 10)] + [float(x * 10**d) for d in range(9) for x in STEPS] + [1e200]
PARTS = ["n", "lo", "hi", "total", "squares"]


def bucket(value: Column) -> Column:
    """Number of the bucket, from 0, that holds a value; values below 0 are in the first."""
    return rank_of(value.cast("double"), LIMITS[:-1])


def histogram(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Null values are left out."""
    v = F.col(value).cast("double")
    own = df.where(v.isNotNull()).withColumn("bucket", bucket(F.col(value)))
    return own.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"))


def merge(parts: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(*by, "bucket").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))


def summary(hist: DataFrame, by: Sequence[str] = (), percentiles: Sequence[float] = (50.0, 99.0)) -> DataFrame:
    """One row a group: n, mean, stddev, lo, hi and p<percentile>: the point of the bucket in which the percentile falls, in
    proportion to its place among the bucket's values, and within lo and hi."""
    group = W.partitionBy(*(by or [F.lit(0)]))
    limits = F.array(*[F.lit(x) for x in [0.0, *LIMITS]])
    rows = hist.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "all": F.sum("n").over(group), "least": F.min("lo").over(group), "most": F.max("hi").over(group)})
    left, right = limits[F.col("bucket")], limits[F.col("bucket") + 1]

    def point(p: float) -> Column:
        at = F.col("all") * (p / 100)
        value = left + (right - left) * ((at - (F.col("upto") - F.col("n"))) / F.col("n"))
        clamped = F.least(F.greatest(value, F.col("least")), F.col("most"))
        # the first bucket whose running count reaches the place
        return F.min_by(clamped, F.when(F.col("upto") >= at, F.col("bucket"))).alias(f"p{p:g}")

    n, total, squares = F.sum("n"), F.sum("total"), F.sum("squares")
    spread = F.sqrt(F.greatest((squares * n - total * total) / (n * n), F.lit(0.0)))
    return rows.groupBy(*by).agg(n.alias("n"), (total / n).alias("mean"), spread.alias("stddev"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[point(p) for p in percentiles])
