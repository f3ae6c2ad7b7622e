"""N-gram Jaccard join: MinHash banding, then verification on full n-gram sets.

A text's words are its lower-cased runs of letters, digits and underscores; its set holds the 64-bit hashes of all runs
of ``N`` words (of fewer words: the one run of all). Band and row counts follow from the target recall at the threshold
(``bands_for``). Texts with equal sets are one *set*, merged map-side before anything is shuffled on bands.

Within a band's bucket no list of all pairs is made. Buckets with the same leader (their least set) are one group, so sets
that share a bucket share a group. A group is cut into blocks of at most about ``BLOCK`` members or ``GRAMS`` n-grams, and
each pair of blocks is compared in one task, which counts shared n-grams by a matrix product. A pair that meets in several
groups is counted in the one with the least leader only. A task returns each set's number of links and such links as join
its components: rows in the order of its members, not of its pairs.

Result: per row doc_id, class_id (least doc_id of the class), set_size (rows with an equal set) and n_links: the number of
other rows whose set reaches the threshold with its own, equal ones included, as far as the sets share a band (recall 0.998
at the threshold, more above it).

Defined results: null texts, texts without words and rows without a doc_id are a class of their own each, without links;
repeated rows are copies; rows that share an id but not a text are documents of their own, told apart by their texts'
hashes. Extra columns are not read, and ``keep_one`` carries them along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, held, numbered, remove, wanted
from tidemark.llm.components import components

N, THRESHOLD, RECALL, HASHES = 5, 0.8, 0.998, 128
#: Members of a leader, and their n-grams, that one side of a comparison holds.
BLOCK, GRAMS = 768, 1_000_000
_WORD = re.compile(r"\w+")


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, whose recall at the threshold reaches the target."""
    found = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = hashes // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            found = (bands, rows)
    return found


class Words(dict):
    """64-bit hashes of words; emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """The sorted distinct hashes of the text's n-grams."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(held(("words",), Words).__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    size = len(h) - n + 1
    out = np.full(size, 0x9E3779B97F4A7C15 * n & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(n):
        out = (out ^ h[i : i + size]) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def _seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240501)
    return r.integers(1, 1 << 32, count, np.uint64) | np.uint64(1), r.integers(0, 1 << 63, count, np.uint64)


def signature(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per band over its rows' minima. Minima are of (a x + b) mod 2^64, compared by the upper 32 bits."""
    a, b = _seeds(bands * rows)
    low = np.empty(bands * rows, np.uint64)
    for first in range(0, len(grams), 4096):
        x = grams[first : first + 4096]
        part = (((x[:, None] >> np.uint64(1)) * (a | (a << np.uint64(32))) + b) >> np.uint64(32)).min(axis=0)
        low = part if first == 0 else np.minimum(low, part)
    mixed = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for row in low.reshape(bands, rows).T:
        mixed = (mixed ^ row) * np.uint64(0xC4CEB9FE1A85EC53)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def signatures(df: DataFrame, bands: int, rows: int, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), key (128-bit hash of the set; null without words), size and bands of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, flat, ends = [], [], [], [0]
            for text in batch.column(1).to_pylist():
                grams = shingles(text, n)
                sizes.append(len(grams))
                keys.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                if len(grams):
                    flat.append(signature(grams, bands, rows).view(np.int64))
                ends.append(ends[-1] + (bands if len(grams) else 0))
            values = np.concatenate(flat) if flat else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], ["doc_id", "th", "key", "size", "bands"])

    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th")).mapInArrow(run, "doc_id long, th long, key binary, size long, bands array<long>")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """(place, place) -> number of values that two sets have in common."""
    n = len(sets)
    values, where = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    often = np.bincount(where, minlength=len(values)) > 1
    column = np.cumsum(often) - 1
    keep = often[where]
    owner, column = owner[keep], column[where[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out, columns = np.zeros((n, n), np.float32), int(often.sum())
    width = min(columns, max(64, (1 << 22) // max(n, 1)))
    for first in range(0, columns, width or 1):
        lo, hi = np.searchsorted(column, (first, first + width))
        grid = np.zeros((n, width), np.float32)
        grid[owner[lo:hi], column[lo:hi] - first] = 1
        out += grid @ grid.T
    return out


def links_between(sets: list[np.ndarray], leads: list[np.ndarray], lead: int, threshold: float, sides: list[int] | None = None) -> np.ndarray:
    """(place, place) -> whether two sets reach the threshold, above the diagonal, without pairs that meet in a group of a
    lesser leader; ``sides``: only across sides."""
    sizes = np.array([len(s) for s in sets], np.int64)
    both = shared(sets)
    hit = np.triu(both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-6, 1)
    if sides is not None:
        hit &= np.array(sides)[:, None] != np.array(sides)[None, :]
    before = [x[x < lead] for x in leads]
    if hit.any() and any(len(x) for x in before):
        hit &= shared(before) == 0
    return hit


def spanning(hit: np.ndarray) -> list[tuple[int, int]]:
    """Of the pairs in ``hit`` such as join its components."""
    top = list(range(len(hit)))

    def find(k: int) -> int:
        while top[k] != k:
            top[k] = top[top[k]]
            k = top[k]
        return k

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(hit))):
        a, b = find(i), find(j)
        if a != b:
            top[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def compare(pool: DataFrame, df: DataFrame, n: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(a, b, links): links that join sets (links is null), and with a = b a set's number of linked rows in a task;
    pool: lead, id, leads (all leaders of the id), size, rows.

    Groups of one block share tasks of about that many members; others are cut into blocks, and each pair of blocks is a
    task of its own."""
    sizes = pool.groupBy("lead").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / GRAMS)).alias("blocks"))
    all_ = pool.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("grams")).first()
    bins = max(1, all_.n // BLOCK, all_.grams // GRAMS)
    texts = _texts(df, pool.select("id", "doc_id", "th").distinct(), id_col, text_col)
    dealt = pool.join(sizes, "lead").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    tasks = dealt.select("lead", "id", "leads", "rows", "block", "blocks", other).select(
        "lead", "id", "leads", "rows", "block",
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("lead"), F.lit(bins))).otherwise(F.col("lead")).alias("k"),
        F.when(F.col("blocks") == 1, -1).otherwise(F.least("block", "other")).alias("x"), F.greatest("block", "other").alias("y"),
    )

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x, y = key[1].as_py(), key[2].as_py()
        by: dict[int, list] = {}
        for lead, *row in zip(*(table.column(c).to_pylist() for c in ("lead", "id", "leads", "rows", "block", "text"))):
            by.setdefault(lead, []).append(row)
        a, b, links = [], [], []
        for lead, members in by.items():
            members.sort(key=lambda r: r[0])
            ids, leads, rows, block, text = zip(*members)
            hit = links_between([shingles(t, n) for t in text], [np.array(v, np.int64) for v in leads], lead, threshold, list(block) if x >= 0 and x != y else None)
            for i, j in spanning(hit):
                a.append(ids[i])
                b.append(ids[j])
                links.append(None)
            degree = (hit | hit.T) @ np.array(rows, np.int64)
            for i in np.nonzero(degree)[0].tolist():
                a.append(ids[i])
                b.append(ids[i])
                links.append(int(degree[i]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array(links, pa.int64())})

    return tasks.join(texts, "id").groupBy("k", "x", "y").applyInArrow(run, "a long, b long, links long")


def _texts(df: DataFrame, sets: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and text of the documents in ``sets`` (id, doc_id, th); a map-side filter keeps most other texts out of the shuffle,
    and rows that repeat fully are merged before it."""
    text = F.col(text_col).cast("string")
    own = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    return own.where(wanted(sets, "th")).dropDuplicates(["doc_id", "th"]).join(sets, ["doc_id", "th"]).select("id", "text")


def _classes(df: DataFrame, n: int, threshold: float, recall: float, hashes: int, id_col: str, text_col: str) -> DataFrame:
    """One row per row of ``df``: doc_id, th, class_id, class_th (the class's least doc_id, and its text's hash), set_size, n_links."""
    spark = df.sparkSession
    bands, rows = bands_for(threshold, recall, hashes)
    signed = cut(signatures(df, bands, rows, n, id_col, text_col), "signatures")
    known = signed.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
    first = known.groupBy("key").agg(F.min(F.struct("doc_id", "th", "size", "bands")).alias("x"), F.count(F.lit(1)).alias("rows"))
    sets = cut(first.select(F.monotonically_increasing_id().alias("id"), "key", "x.*", "rows"), "sets")
    members = sets.select("id", F.explode("bands").alias("band"))
    lead = members.groupBy("band").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("c")).where("c > 1").select("band", "lead")
    led = members.join(lead, "band").groupBy("id").agg(F.sort_array(F.collect_set("lead")).alias("leads"))
    pool = cut(led.join(sets.select("id", "doc_id", "th", "size", "rows"), "id").select(F.explode("leads").alias("lead"), "id", "doc_id", "th", "leads", "size", "rows"), "pool")
    found = cut(compare(pool, df, n, threshold, id_col, text_col), "links")
    roots = components(found.where("a <> b").select("a", "b"))
    degree = found.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    label = sets.select("key", "id", "rows", F.struct("doc_id", "th").alias("at")).join(roots.withColumnRenamed("node", "id"), "id", "left").join(degree, "id", "left")
    top = label.where("root is not null").groupBy("root").agg(F.min("at").alias("top"))
    label = label.join(top, "root", "left").select("key", F.coalesce("top", "at").alias("top"), F.col("rows").alias("set_size"), (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    remove(spark, pool)
    # rows without words or id have no set; a key of their own spreads them over the join
    own = F.when(F.col("doc_id").isNotNull() & F.col("key").isNotNull(), F.col("key")).otherwise(F.unhex(F.md5(F.concat_ws(":", "doc_id", "th"))))
    out = signed.select("doc_id", "th", own.alias("key")).join(label, "key", "left")
    return out.select(
        "doc_id", "th", F.coalesce(F.col("top.doc_id"), F.col("doc_id")).alias("class_id"), F.coalesce(F.col("top.th"), F.col("th")).alias("class_th"),
        F.coalesce("set_size", F.lit(1)).cast("long").alias("set_size"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def classes(df: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, class_id, set_size, n_links."""
    return _classes(df, n, threshold, recall, hashes, id_col, text_col).select("doc_id", "class_id", "set_size", "n_links")


def keep_one(df: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stand for their class: those with its least doc_id and, of these, the text whose hash is least
    (repeats of that row stay with it). Rows without words or without a doc_id stay."""
    plain, names = numbered(df)
    found = _classes(df, n, threshold, recall, hashes, id_col, text_col)
    gone = found.where((F.col("class_id") != F.col("doc_id")) | (F.col("class_th") != F.col("th"))).select("doc_id", "th").distinct()
    id_, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    left = plain.join(gone, (F.col(id_).cast("long") == F.col("doc_id")) & (F.xxhash64(F.col(text).cast("string")) == F.col("th")), "left_anti")
    return left.toDF(*names)


def brute(texts: dict[int, str | None], n: int = N, threshold: float = THRESHOLD) -> dict[int, int]:
    """Class of each id by comparing all pairs, for tests."""
    sets = {k: shingles(v, n) for k, v in texts.items()}
    root = {k: k for k in texts}

    def top(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for i, p in enumerate(ids):
        for q in ids[:i]:
            if jaccard(sets[p], sets[q]) >= threshold - 1e-9:
                a, b = sorted((top(p), top(q)))
                root[b] = a
    return {k: top(k) for k in ids}
