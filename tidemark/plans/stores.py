"""Queries that go through the durable store: they write a store into the shared folder, from the events table, and read it
back. Keys are eight big-endian bytes of user_id, padded; sequence numbers are event_id + 1; errors are tombstones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import be64_key
from tidemark.operators.scan import next_keys
from tidemark.sources.batch import WriteBatch, dump, dump_files
from tidemark.sources.shared import new_folder
from tidemark.sources.store import OrderedStore, ShardedStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def number(key: str | Column) -> Column:
    """user_id of a key."""
    return F.conv(F.substring(F.hex(key), 1, 16), 16, 10).cast("long")


def key_of(n: int) -> bytes:
    return n.to_bytes(8, "big") + b"0" * 12


def log(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    dead = F.col("event_type") == "error"
    return e.select(be64_key(F.col("user_id")).alias("k"), (F.col("event_id") + 1).alias("seq"), F.when(dead, 0).otherwise(1).cast("tinyint").alias("kind"), F.when(~dead, F.encode("event_type", "UTF-8")).alias("v"))


def half(spark: SparkSession, d: str) -> int:
    """The sequence number in the middle of the log."""
    return log(spark, d).agg(F.max("seq")).first()[0] // 2


def fresh(spark: SparkSession, name: str) -> OrderedStore:
    return OrderedStore.open(spark, new_folder(spark, f"store-{name}"))


def plain(rows: DataFrame) -> DataFrame:
    return rows.select(number("k").alias("k"), F.decode("v", "UTF-8").alias("v"))


E = "e AS (SELECT user_id AS k, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS kind, event_type AS v FROM events), m AS (SELECT max(seq) // 2 AS h FROM e)"


def vis(of: str = "e", where: str = "", name: str = "vis") -> str:
    return f"{name} AS (SELECT k, seq, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM {of} {where}) WHERE rn = 1 AND kind = 1)"


@query(f"WITH {E}, {vis()} SELECT k, v FROM vis")
def store_ingest_scan(s, d):
    store = fresh(s, "scan")
    store.ingest(log(s, d), "events-0")
    store.ingest(log(s, d), "events-0")  # a replay
    return plain(store.scan())


_BATCH = "w AS (SELECT i AS k, h.n + 1 + i AS seq, (i % 3 > 0)::INT AS kind, 'new' || i AS v FROM range(0, 30) t(i), (SELECT max(seq) AS n FROM e) h), x AS (SELECT k, seq, kind, v FROM e UNION ALL SELECT * FROM w)"


@query(f"WITH {E}, {_BATCH}, {vis('x')} SELECT k, v FROM vis")
def store_write_batch(s, d):
    """A bulk load, then one batch of puts and deletes over it."""
    store = fresh(s, "batch")
    store.ingest(log(s, d))
    batch = WriteBatch()
    for i in range(30):
        batch.put(key_of(i), f"new{i}".encode()) if i % 3 else batch.delete(key_of(i))
    store.write(batch)
    return plain(store.scan())


@query(f"WITH {E}, {vis(where='WHERE seq <= (SELECT h FROM m)')} SELECT k, seq, v, (SELECT count(*)::BIGINT FROM e WHERE seq > (SELECT h FROM m)) AS later_writes FROM vis")
def store_snapshot_while_writing(s, d):
    """A pinned state is read after later writes, a compaction and a new handle."""
    e, h = log(s, d), half(s, d)
    store = fresh(s, "snapshot")
    store.ingest(e.where(F.col("seq") <= h))
    name = store.snapshot()
    store.ingest(e.where(F.col("seq") > h))
    store.compact()
    again = OrderedStore.open(s, store.path, create_if_missing=False)
    rows = again.view(again.seq_of(name)).rows()
    later = again.state.last_seq - again.seq_of(name)
    return rows.select(number("k").alias("k"), "seq", F.decode("v", "UTF-8").alias("v"), F.lit(later).cast("long").alias("later_writes"))


_GC = "n AS (SELECT *, lag(seq) OVER (PARTITION BY k ORDER BY seq DESC) AS newer FROM e)"


@query(f"WITH {E}, {_GC}, h AS (SELECT h FROM m) SELECT k, seq, kind::INT AS kind FROM n, h WHERE (newer IS NULL OR newer > h) AND NOT (kind = 0 AND seq <= h)")
def store_compact(s, d):
    """What a full compaction leaves under one snapshot."""
    e, h = log(s, d), half(s, d)
    store = fresh(s, "compact")
    store.ingest(e.where(F.col("seq") <= h))
    store.snapshot()
    store.ingest(e.where(F.col("seq") > h))
    store.compact()
    return store.oplog().select(number("k").alias("k"), "seq", F.col("kind").cast("int").alias("kind"))


@query(f"WITH {E}, {vis()} SELECT k, v FROM vis")
def store_compaction_policy(s, d):
    """Four loads, then steps of the policy until nothing is due, with a small limit a level; the view is the same."""
    e, h = log(s, d), half(s, d)
    store = fresh(s, "policy")
    for i in range(4):
        store.ingest(e.where(F.col("seq").between(i * h // 2 + 1, (i + 1) * h // 2 if i < 3 else 1 << 40)))
    for _ in range(12):
        if store.compact_once(level_bytes=1 << 13) is None:
            break
    return plain(store.scan())


@query(f"WITH {E}, {vis()}, t AS (SELECT i * 3 AS k FROM range(0, 500) r(i)) SELECT k, v FROM vis JOIN t USING (k)")
def store_multi_get(s, d):
    store = fresh(s, "get")
    store.ingest(log(s, d))
    return plain(store.view().multi_get(s.range(500).select(be64_key(F.col("id") * 3).alias("k"))))


@query(f"WITH {E}, {vis()}, t AS (SELECT (i * 7919) % 2000 AS target FROM range(0, 300) r(i)) SELECT DISTINCT target, (SELECT min(k) FROM vis WHERE k >= target) AS found FROM t")
def store_seek_many(s, d):
    """Seeks over binary keys."""
    store = fresh(s, "seek")
    store.ingest(log(s, d))
    targets = s.range(300).select(be64_key(F.pmod(F.col("id") * 7919, F.lit(2000))).alias("target"))
    return next_keys(store.view().rows().select("k"), "k", targets).select(number("target").alias("target"), number("found").alias("found"))


@query(f"WITH {E} SELECT lpad(hex(k), 16, '0') || repeat('30', 12) || ' @ ' || seq || ' : ' || CASE kind WHEN 1 THEN 'put' ELSE 'del' END || ' => ' || CASE kind WHEN 1 THEN hex(encode(v)) ELSE '' END AS line FROM e")
def store_dump(s, d):
    store = fresh(s, "dump")
    store.ingest(log(s, d))
    return dump(store.oplog())


@query(f"WITH {E} SELECT count(*)::BIGINT AS entries, max(seq) AS last_seq, min(seq) AS first_seq, lpad(hex(min(k)), 16, '0') AS smallest, lpad(hex(max(k)), 16, '0') AS largest, true AS named FROM e")
def store_properties(s, d):
    """The manifest against the rows."""
    store = fresh(s, "properties")
    store.ingest(log(s, d))
    n = store.files().count()
    named = store.property("num-files-at-level0") == str(n) and len((store.property("sstables") or "").splitlines()) == n == dump_files(store.files()).count() and store.property("nothing") is None
    short = lambda c: F.substring(F.hex(c), 1, 16)
    return store.files().agg(F.sum("num_entries").alias("entries"), F.max("max_seq").alias("last_seq"), F.min("min_seq").alias("first_seq"), short(F.min("smallest")).alias("smallest"), short(F.max("largest")).alias("largest")).withColumn("named", F.lit(named))


@query("WITH b AS (SELECT i AS range_id FROM range(0, 6) t(i)) SELECT range_id, true AS near FROM b")
def store_approximate_sizes(s, d):
    """Sizes from the manifest and the keys of cut files, beside each range's share of the rows: within a tenth of all."""
    store, e = fresh(s, "sizes"), log(s, d)
    store.ingest(e)
    top = e.select(number(F.max("k")).alias("m")).first().m + 1
    edges = [top * i // 5 for i in range(6)]
    ranges = [(key_of(a), key_of(b)) for a, b in zip(edges, edges[1:])] + [(b"", b"\xff")]
    rows = [store.view(lo=a, hi=b).oplog.where((F.col("k") >= F.lit(bytearray(a))) & (F.col("k") < F.lit(bytearray(b)))).count() for a, b in ranges]
    got, size = store.approximate_sizes(ranges), sum(f["size"] for f in store.state.files)
    near = [abs(x / size - n / rows[-1]) < 0.1 for x, n in zip(got, rows)]
    return s.createDataFrame(list(enumerate(near)), "range_id long, near boolean")


@query(f"WITH {E}, {vis()} SELECT k, v FROM vis")
def store_stream_ingest(s, d):
    """The log as a stream of micro-batches, each committed once."""
    from tidemark.streaming.ingest import ingest

    store, source = fresh(s, "stream"), new_folder(s, "stream-in")
    log(s, d).repartition(3, "seq").write.parquet(source)
    stream = s.readStream.schema(log(s, d).schema).option("maxFilesPerTrigger", 1).parquet(source)
    ingest(stream, store, new_folder(s, "stream-checkpoint")).awaitTermination()
    return plain(store.scan())


# ---- shards


def sharded(s: SparkSession, d: str, name: str, shards: int = 4) -> ShardedStore:
    top = s.read.parquet(f"{d}/events.parquet").agg(F.max("user_id")).first()[0] + 1
    edges = [key_of(top * i // shards) for i in range(shards)] + [b"\xff"]
    store = ShardedStore.create(s, new_folder(s, f"store-{name}"), list(zip(edges, edges[1:])))
    store.ingest(log(s, d))
    return store


_SHARD = "s AS (SELECT max(k) + 1 AS top FROM e), g AS (SELECT i AS shard, top * i // 4 AS lower, CASE WHEN i = 3 THEN top + 1000000 ELSE top * (i + 1) // 4 END AS upper FROM s, range(0, 4) t(i))"


@query(f"WITH {E}, {_BATCH}, {_SHARD}, {vis('x')} SELECT k, v, shard FROM vis JOIN g ON k >= lower AND k < upper")
def shard_store_batch(s, d):
    """A bulk load and a batch over all shards, each row in its own; one scan a shard, after one of them was compacted."""
    store = sharded(s, d, "shard-batch")
    batch = WriteBatch()
    for i in range(30):
        batch.put(key_of(i), f"new{i}".encode()) if i % 3 else batch.delete(key_of(i))
    store.write(batch)
    store.compact_shard(1)
    parts = [plain(store.scan_shard(i)).withColumn("shard", F.lit(i).cast("long")) for i in range(4)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(f"WITH {E}, {_SHARD} SELECT shard, count(*)::BIGINT AS entries, true AS own FROM e JOIN g ON k >= lower AND k < upper GROUP BY shard")
def shard_store_files(s, d):
    """Entries of each shard by the manifest; no file crosses a shard's bounds."""
    store, rows = sharded(s, d, "shard-files"), []
    for i, size in enumerate(store.shard_sizes()):
        own, (lower, upper) = store._of(i), store.bounds(i)
        rows.append((i, sum(f["num_entries"] for f in own), size > 0 and all(lower.hex().upper() <= f["smallest"] and f["largest"] < upper.hex().upper() for f in own)))
    return s.createDataFrame(rows, "shard long, entries long, own boolean")


@query(f"WITH {E}, {_SHARD}, {vis(where='WHERE seq <= (SELECT h FROM m)')}, t AS (SELECT i * 7 AS k FROM range(0, 300) r(i)) SELECT k, v FROM vis JOIN t USING (k) JOIN g ON k >= lower AND k < upper WHERE shard = 2")
def shard_store_snapshot_get(s, d):
    """Batched gets in one shard at a snapshot: its own files only."""
    store = sharded(s, d, "shard-get")
    keys = s.range(300).select(be64_key(F.col("id") * 7).alias("k"))
    return plain(store.shard_view(2, half(s, d)).multi_get(keys))
