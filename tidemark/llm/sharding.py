"""Sharding by a uniform shuffle with exact shard sizes (law ``rows``: counts at most one apart).

Parts are the partitions in which the rows already lie, or, where the result must not depend on these (``stable``), parts
made by a hash. How many rows of each part go to each shard is drawn exactly, part by part, from the multivariate
hypergeometric law, given what the shards still have room for: the communication matrix of a uniform permutation. Each part
is permuted (ranked by a hash) and cut by its row of the matrix; rows go to their shards; there they are permuted again.
The second permutation is ranked in sub-blocks of the hash's range, whose sizes give the offsets, so that no task ever holds
a whole shard. The matrix (parts x shards) is the only thing the driver sees besides the blocks' counts.

Existing partitions are sorted where they are and written once; then each row moves once, to its shard's block. Parts by a
hash move all rows twice.

Defined results: the shards' sizes are those of n rows dealt as evenly as can be, lower shards first; with ``stable`` the
result is the same for the same rows, ids and seed however they are partitioned, else for the same partitions; rows that
repeat fully are interchangeable (with ``stable`` they share a part); null ids and null texts are ordinary values; an empty
table gives none. All columns are carried; ``shard`` and ``slot`` of the input are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import cut, numbered

#: Rows of a part or block aimed at; their number is bounded by ``PARTS``.
PART_ROWS, PARTS = 1000, 1 << 15


def matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """(part, shard) -> rows; margins are the parts' counts and the shards' exact sizes."""
    rng = np.random.default_rng(seed)
    n = sum(counts)
    room = np.array([n // shards + (s < n % shards) for s in range(shards)], np.int64)
    out = np.zeros((len(counts), shards), np.int64)
    for p, c in enumerate(counts):
        left = c
        total = int(room.sum())
        # one hypergeometric draw a shard: numpy's multivariate form bounds the total, this one does not
        for s in range(shards):
            total -= int(room[s])
            out[p, s] = got = _draw(rng, int(room[s]), total, left)
            left -= got
        room -= out[p]
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    if sample == 0 or good == 0:
        return 0
    if bad == 0:
        return sample
    if max(good, bad) < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, sample))
    # beyond numpy's range: halves of an exact split
    half = good // 2, bad // 2
    top = _draw(rng, sum(half), good + bad - sum(half), sample)
    return _draw(rng, half[0], half[1], top) + _draw(rng, good - half[0], bad - half[1], sample - top)


def _literal(df: DataFrame, values: dict[int, list[int]], key: str, name: str) -> DataFrame:
    """``df`` with the array that belongs to its ``key``; the table is bounded by ``PARTS``, so it may be broadcast."""
    spark = df.sparkSession
    small = spark.createDataFrame([(int(k), [int(x) for x in v]) for k, v in values.items()] or [(-1, [0])], f"{key} long, {name} array<long>")
    return df.join(F.broadcast(small), key)


def shuffle(df: DataFrame, shards: int = 8, seed: int = 3, id_col: str = "doc_id", stable: bool = True) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard)."""
    plain, names = numbered(df)
    kept = [(f"c{i}", c) for i, c in enumerate(names) if c not in ("shard", "slot")]
    every, id_ = [F.col(c) for c, _ in kept], F.col(f"c{names.index(id_col)}")
    # where partitions stay as they are a row's number tells apart even such as repeat fully
    tie = F.xxhash64(*every, F.lit(seed)) if stable else F.monotonically_increasing_id()
    key = [id_] if stable else [id_, F.col("tie")]
    keyed = plain.select(*every, tie.alias("tie")).withColumns({"u": F.xxhash64(*key, F.lit(seed)), "v": F.xxhash64(*key, F.lit(seed + 1))})
    dealt = _by_hash(keyed, shards, seed) if stable else _in_place(keyed, shards, seed)
    out = _second(dealt, shards)
    return out.select(*[F.col(c).alias(n) for c, n in kept], "shard", "slot")


def _cuts(counts: dict[int, int], shards: int, seed: int) -> dict[int, list[int]]:
    """Per part the ranks up to which its rows go to shard 0, 1, ..."""
    order = sorted(counts)
    drawn = np.cumsum(matrix([counts[p] for p in order], shards, seed), axis=1)
    return {p: drawn[i].tolist() for i, p in enumerate(order)}


def _shard(ranked: DataFrame, cuts: dict[int, list[int]]) -> DataFrame:
    """Rows with ``part`` and ``r``, their rank in it from 1, with ``shard`` instead."""
    shard = F.size(F.filter("cuts", lambda c: c < F.col("r"))).cast("int")
    return _literal(ranked, cuts, "part", "cuts").withColumn("shard", shard).drop("cuts", "part", "r", "u")


def _by_hash(keyed: DataFrame, shards: int, seed: int) -> DataFrame:
    parts = min(PARTS, max(1, -(-keyed.count() // PART_ROWS)))
    parted = keyed.withColumn("part", F.pmod(F.xxhash64("tie", F.lit(seed + 2)), F.lit(parts)))
    counts = {r.part: r.n for r in parted.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    return _shard(parted.withColumn("r", F.row_number().over(W.partitionBy("part").orderBy("u", "tie"))), _cuts(counts, shards, seed))


def _in_place(keyed: DataFrame, shards: int, seed: int) -> DataFrame:
    """Each partition is sorted by the hash where it is; a row's number then holds its partition and its rank there. The
    table that is written fixes both."""
    rows = keyed.coalesce(PARTS) if keyed.rdd.getNumPartitions() > PARTS else keyed
    at = cut(rows.sortWithinPartitions("u", "tie").withColumn("at", F.monotonically_increasing_id()), "parts")
    ranked = at.withColumn("part", F.shiftright("at", 33)).withColumn("r", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("at")
    counts = {r.part: r.n for r in ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    return _shard(ranked, _cuts(counts, shards, seed))


def _second(dealt: DataFrame, shards: int) -> DataFrame:
    """Rows with ``shard``, ``v`` and ``tie``, with ``slot`` instead of the latter: a second permutation, in blocks of each
    shard that are ranges of v, so that blocks follow its order. The blocks follow the number of rows, which bounds each."""
    total = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()
    blocks = max(1, min(PARTS // shards, -(-sum(r.n for r in total) // (PART_ROWS * shards))))
    block = F.floor(F.shiftrightunsigned("v", 24).cast("double") / float(1 << 40) * blocks).cast("int")
    celled = dealt.withColumn("cell", (F.col("shard") * blocks + block).cast("long"))
    sizes = {r.cell: r.n for r in celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets: dict[int, list[int]] = {}
    for s in range(shards):
        start = 0
        for c in range(s * blocks, (s + 1) * blocks):
            offsets[c] = [start]
            start += sizes.get(c, 0)
    w = W.partitionBy("cell").orderBy("v", "tie")
    placed = _literal(celled.withColumn("q", F.row_number().over(w)), offsets, "cell", "from")
    return placed.withColumn("slot", F.col("from")[0] + F.col("q") - 1)


def digests(sharded: DataFrame) -> DataFrame:
    return sharded.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
