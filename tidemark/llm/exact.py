"""Exact dedup with DataFrame functions only.

Texts, normalised by lower-casing A to Z, are grouped by a 128-bit content hash *and* by their bytes: Spark's hash
aggregation compares the bytes of the group key, so texts that collide in the hash stay apart. Copies are merged
map-side before the shuffle, so a text that a third of all rows share sends one row a task. Each row then finds its
group by the content hash and the SHA-256 of its text, in a join of narrow rows that adaptive execution can split.

Defined results: null counts as empty, and empty texts are equal; the row with the largest doc_id stays; rows without a
doc_id stay only if their whole group has none; rows that repeat doc_id and text are one document, so all carry
``kept`` alike and count in ``group_size``. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case and nothing else changed; the fast built-in is exact where every character is one byte."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def md5_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = md5_key) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    norm = df.select(F.col(id_col).cast("long").alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("norm"))
    keyed = norm.select("doc_id", content_hash(F.col("norm")).alias("h"), "norm")
    sizes = keyed.groupBy("h", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    sizes = sizes.select("h", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    rows = keyed.select("doc_id", "h", F.unhex(F.sha2("norm", 256)).alias("sha"))
    return rows.join(sizes, ["h", "sha"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


ORACLE = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
