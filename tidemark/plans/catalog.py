"""Queries over the test tables, each with the SQL that states the same result.

Operation logs: E (events: key user_id, sequence event_id, errors are tombstones), L (lineitem: key (order, line), versions
ranked by all other columns), O (orders: a clean base run). Runs of E stand for files: file = event_id div 1000.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import generate, histogram
from tidemark.functions.keys import be64_key, bracketed_number, crc32c_of, crc_masked, dec_key, dec_prefix_range, escaped, fixed, hash32, prefixed, varint
from tidemark.operators import compaction, ranges, shards
from tidemark.operators.collapse import as_of, collapse, collapse_dense, collapse_window, dropped, history, merge_runs, newest, retained, without_tombstones
from tidemark.operators.scan import View, ranked
from tidemark.plans import stores

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Snapshots as parts of the log's last sequence number, in SQL; ``at`` gives the same numbers.
SNAP, OLD, FIRST, THIRD = (f"(SELECT max(event_id) * {n} // 20 FROM events)" for n in (10, 12, 5, 15))


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def events(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("user_id").alias("k"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", 0).otherwise(1).cast("tinyint").alias("kind"), "event_type", "value")


def orders(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").alias("seq"), F.lit(1).cast("tinyint").alias("kind"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))


def view(spark: SparkSession, d: str, snapshot: int | None = None) -> View:
    return View(events(spark, d), "k", snapshot)


def at(spark: SparkSession, d: str, twentieths: int) -> int:
    """A snapshot that many twentieths into the log."""
    return spark.read.parquet(f"{d}/events.parquet").agg(F.max("event_id")).first()[0] * twentieths // 20


def out(df: DataFrame) -> DataFrame:
    return df.select("k", "seq", "event_type", "value")


E = "e AS (SELECT user_id AS k, event_id AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS kind, event_type, value FROM events)"


def vis(where: str = "", name: str = "v") -> str:
    return f"{E}, {name} AS (SELECT k, seq, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM e {where}) WHERE rn = 1 AND kind = 1)"


# ---- A: point reads


@query(f"WITH {vis()} SELECT * FROM v WHERE k = 42")
def get_latest(s, d):
    return out(view(s, d).get(42))


@query(f"WITH {vis(f'WHERE seq <= {SNAP}')} SELECT * FROM v WHERE k = 17")
def get_as_of(s, d):
    return out(view(s, d, at(s, d, 10)).get(17))


@query(f"WITH {vis()} SELECT count(*)::BIGINT AS found FROM v WHERE k = -1")
def get_missing(s, d):
    return view(s, d).get(-1).agg(F.count(F.lit(1)).alias("found"))


@query(f"WITH {E} SELECT k, max(seq) AS deleted_at FROM e GROUP BY k HAVING arg_max(kind, seq) = 0")
def get_deleted(s, d):
    rows = newest(events(s, d), "k")
    return rows.where("kind = 0").select("k", F.col("seq").alias("deleted_at"))


@query(f"WITH {vis()} SELECT * FROM v WHERE k IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def multi_get(s, d):
    keys = s.read.parquet(f"{d}/customer.parquet").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    return out(view(s, d).multi_get(keys))


@query("WITH n AS (SELECT count(*) AS n FROM orders), p AS (SELECT (i * 7919) % greatest(n // 100, 1) AS k FROM n, range(0, 1000) t(i)) SELECT count(*)::BIGINT AS lookups, count(o_orderkey)::BIGINT AS found FROM p LEFT JOIN orders ON k = o_orderkey")
def read_hot(s, d):
    o = View(orders(s, d), "k")
    n = max(o.oplog.count() // 100, 1)
    probes = s.range(1000).select(F.pmod(F.col("id") * 7919, F.lit(n)).alias("k"))
    hits = o.multi_get(probes).select("k", F.lit(1).alias("hit"))
    return probes.join(hits, "k", "left").agg(F.count(F.lit(1)).alias("lookups"), F.count("hit").alias("found"))


@query("SELECT 1000::BIGINT AS lookups, count(o_orderkey)::BIGINT AS found FROM range(0, 1000) t(i) JOIN orders ON lpad(CAST(o_orderkey AS VARCHAR), 20, '0') = substr(lpad(CAST(i AS VARCHAR), 20, '0'), 1, 19)")
def read_missing(s, d):
    """Keys without their last character."""
    probes = s.range(1000).select(F.substring(dec_key(F.col("id")), 1, 19).alias("k"))
    hits = View(orders(s, d).withColumn("k", dec_key(F.col("k"))), "k").multi_get(probes)
    return hits.agg(F.lit(1000).cast("long").alias("lookups"), F.count(F.lit(1)).alias("found"))


@query("WITH n AS (SELECT count(*) AS n FROM orders), p AS (SELECT (i * 104729) % n AS k FROM n, range(0, 2000) t(i)) SELECT k, count(*)::BIGINT AS reads, any_value(o_totalprice) AS price FROM p JOIN orders ON k = o_orderkey GROUP BY k")
def read_random(s, d):
    o = orders(s, d)
    n = o.count()
    probes = s.range(2000).select(F.pmod(F.col("id") * 104729, F.lit(n)).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("reads"))
    return View(o, "k").multi_get(probes).join(probes, "k").select("k", "reads", "price")


# ---- B: scans


@query(f"WITH {vis()} SELECT *, row_number() OVER (ORDER BY k) AS rn FROM v")
def scan_all(s, d):
    return ranked(out(view(s, d).rows()), "k")


@query(f"WITH {vis()} SELECT *, row_number() OVER (ORDER BY k DESC) AS rn FROM v")
def scan_reverse(s, d):
    return ranked(out(view(s, d).rows()), "k", desc=True)


@query(f"WITH {vis()} SELECT * FROM v WHERE k >= 20 AND k < 60")
def scan_range_half_open(s, d):
    return out(view(s, d).between(20, 60))


@query(f"WITH {vis()} SELECT * FROM v WHERE k BETWEEN 20 AND 60")
def scan_range_inclusive(s, d):
    return out(view(s, d).between(20, 60, inclusive=True))


@query("SELECT lpad(CAST(o_orderkey AS VARCHAR), 20, '0') AS k, o_totalprice AS price FROM orders WHERE lpad(CAST(o_orderkey AS VARCHAR), 20, '0') LIKE '000000000000000001%'")
def scan_prefix(s, d):
    """A prefix of decimal keys is a range of numbers, which the scan can use."""
    lo, hi = dec_prefix_range("000000000000000001")
    return View(orders(s, d), "k").between(lo, hi).select(dec_key(F.col("k")).alias("k"), "price")


@query(f"WITH {vis()} SELECT * FROM v ORDER BY k LIMIT 10")
def scan_first_n(s, d):
    return out(view(s, d).first(10))


@query(f"WITH {vis()} SELECT * FROM v ORDER BY k DESC LIMIT 10")
def scan_last_n(s, d):
    return out(view(s, d).last(10))


@query(f"WITH {vis(f'WHERE seq <= {SNAP}')} SELECT count(*)::BIGINT AS live FROM v")
def count_live(s, d):
    return view(s, d, at(s, d, 10)).rows().agg(F.count(F.lit(1)).alias("live"))


# ---- C: seeks


@query(f"WITH {vis()} SELECT * FROM v WHERE k >= 77 ORDER BY k LIMIT 1")
def seek_lower_bound(s, d):
    return out(view(s, d).seek(77))


_SEEKS = "SELECT t.target, min(v.k) AS found FROM t LEFT JOIN v ON v.k >= t.target GROUP BY t.target"


@query(f"WITH {vis()}, t AS (SELECT DISTINCT (i * 7919) % 200 AS target FROM range(0, 150) r(i)) {_SEEKS}")
def seek_random(s, d):
    return view(s, d).seek_many(s.range(150).select(F.pmod(F.col("id") * 7919, F.lit(200)).alias("target")).distinct())


@query(f"WITH {vis()}, t AS (SELECT i AS target FROM range(0, 150) r(i)) {_SEEKS}")
def seek_ordered(s, d):
    return view(s, d).seek_many(s.range(150).select(F.col("id").alias("target")))


@query(f"WITH {vis()} SELECT * FROM v WHERE k > 42 ORDER BY k LIMIT 1")
def next_key(s, d):
    return out(view(s, d).next(42))


@query(f"WITH {vis()} SELECT * FROM v WHERE k < 42 ORDER BY k DESC LIMIT 1")
def prev_key(s, d):
    return out(view(s, d).prev(42))


@query(f"WITH {vis()}, dead AS (SELECT k FROM e GROUP BY k HAVING arg_max(kind, seq) = 0), t AS (SELECT k AS target FROM dead) {_SEEKS}")
def seek_skips_tombstone(s, d):
    dead = newest(events(s, d), "k").where("kind = 0").select(F.col("k").alias("target"))
    return view(s, d).seek_many(dead)


# ---- D: versions


@query(f"WITH {E} SELECT k, seq, kind::INT AS kind, event_type, value, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS version FROM e")
def history_all(s, d):
    return history(events(s, d), "k").withColumn("kind", F.col("kind").cast("int"))


@query(f"WITH {vis(f'WHERE seq <= {SNAP}')} SELECT * FROM v")
def collapse_by_window(s, d):
    return out(collapse_window(events(s, d), "k", at(s, d, 10)))


@query(f"WITH {vis(f'WHERE seq <= {SNAP}')} SELECT * FROM v")
def collapse_by_maxby(s, d):
    return out(collapse(events(s, d), "k", at(s, d, 10)))


_L = "ORDER BY l_shipdate DESC, l_extendedprice DESC, l_quantity DESC, l_partkey DESC, l_suppkey DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, versions FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS versions, row_number() OVER (PARTITION BY l_orderkey, l_linenumber {_L}) AS rn FROM lineitem) WHERE rn = 1")
def overwrite_latest(s, d):
    li = s.read.parquet(f"{d}/lineitem.parquet")
    order = ["l_shipdate", "l_extendedprice", "l_quantity", "l_partkey", "l_suppkey", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    w = W.partitionBy("l_orderkey", "l_linenumber")
    # most keys have one version, so rows go to their key as they are and are sorted once
    rows = li.select("l_orderkey", "l_linenumber", *order).repartition("l_orderkey", "l_linenumber")
    rows = rows.withColumn("versions", F.count(F.lit(1)).over(w)).withColumn("rn", F.row_number().over(w.orderBy(*[F.desc(c) for c in order])))
    return rows.where("rn = 1").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "versions")


@query(f"WITH {E} SELECT k, seq, kind::INT AS kind, (seq // 1000)::INT AS run, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rank_in_key FROM e")
def merge_of_runs(s, d):
    """All runs of 1000 entries, tagged in one pass, in order of key, newest first; earlier runs win ties."""
    tagged = events(s, d).withColumn("run", F.floor(F.col("seq") / 1000).cast("int"))
    rank = F.row_number().over(W.partitionBy("k").orderBy(F.col("seq").desc(), F.col("kind").desc(), "run"))
    return tagged.select("k", "seq", F.col("kind").cast("int").alias("kind"), "run", rank.cast("long").alias("rank_in_key"))


@query("SELECT o_orderkey AS k, 1 AS run FROM orders UNION ALL SELECT c_custkey, 0 FROM customer")
def merge_two_runs(s, d):
    a = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k"))
    return merge_runs([a, orders(s, d).select("k")])


@query(f"WITH {vis('WHERE seq <= ' + FIRST, 'a')}, {vis('WHERE seq <= ' + THIRD, 'b')[len(E) + 2:]} SELECT coalesce(a.k, b.k) AS k, a.seq AS old_seq, b.seq AS new_seq FROM a FULL JOIN b ON a.k = b.k WHERE a.seq IS DISTINCT FROM b.seq")
def snapshot_diff(s, d):
    e = events(s, d)
    a = collapse(e, "k", at(s, d, 5)).select("k", F.col("seq").alias("old_seq"))
    b = collapse(e, "k", at(s, d, 15)).select("k", F.col("seq").alias("new_seq"))
    return a.join(b, "k", "full").where(~F.col("old_seq").eqNullSafe(F.col("new_seq")))


@query(f"WITH {vis('WHERE seq <= ' + FIRST, 'a')}, {vis('WHERE seq <= ' + THIRD, 'b')[len(E) + 2:]}, {vis('', 'c')[len(E) + 2:]} SELECT 1::BIGINT AS snapshot, * FROM a UNION ALL SELECT 2::BIGINT, * FROM b UNION ALL SELECT 3::BIGINT, * FROM c")
def snapshot_views(s, d):
    e = events(s, d)
    views = [out(collapse(e, "k", n)).withColumn("snapshot", F.lit(i).cast("long")) for i, n in enumerate((at(s, d, 5), at(s, d, 15), None), 1)]
    return views[0].unionByName(views[1]).unionByName(views[2])


@query("WITH b AS (SELECT event_id % 50 AS k, event_id AS seq, CASE WHEN event_id % 7 = 3 THEN 0 ELSE 1 END AS kind FROM events) SELECT k, max(seq) + 100 AS seq FROM b GROUP BY k HAVING arg_max(kind, seq) = 1")
def batch_order(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    batch = e.select((F.col("event_id") % 50).alias("k"), (F.col("event_id") + 100).alias("seq"), F.when(F.col("event_id") % 7 == 3, 0).otherwise(1).alias("kind"))
    return collapse(batch, "k").select("k", "seq")


_GC = f"WITH {E}, n AS (SELECT *, lag(seq) OVER (PARTITION BY k ORDER BY seq DESC) AS newer FROM e)"


@query(f"{_GC} SELECT k, seq, kind::INT AS kind FROM n WHERE newer IS NULL OR newer > {OLD}")
def gc_retained(s, d):
    old = at(s, d, 12)
    return retained(events(s, d), "k", old).select("k", "seq", F.col("kind").cast("int").alias("kind"))


@query(f"{_GC} SELECT k, count(*)::BIGINT AS versions, max(seq) AS newest FROM n WHERE newer <= {OLD} GROUP BY k")
def gc_dropped(s, d):
    old = at(s, d, 12)
    return dropped(events(s, d), "k", old).groupBy("k").agg(F.count(F.lit(1)).alias("versions"), F.max("seq").alias("newest"))


@query(f"{_GC} SELECT k, seq, kind::INT AS kind FROM n WHERE (newer IS NULL OR newer > {OLD}) AND NOT (kind = 0 AND seq <= {OLD})")
def tombstone_elimination(s, d):
    old = at(s, d, 12)
    return without_tombstones(retained(events(s, d), "k", old), old).select("k", "seq", F.col("kind").cast("int").alias("kind"))


@query(f"{_GC} SELECT k, seq, kind::INT AS kind FROM n WHERE (newer IS NULL OR newer > {OLD}) AND NOT (kind = 0 AND seq <= {OLD} AND NOT (k BETWEEN 0 AND 40 OR k BETWEEN 90 AND 110))")
def tombstone_partial(s, d):
    old = at(s, d, 12)
    return without_tombstones(retained(events(s, d), "k", old), old, [(0, 40), (90, 110)]).select("k", "seq", F.col("kind").cast("int").alias("kind"))


@query(f"WITH {E} SELECT (seq // 1000)::BIGINT AS run, k, max(seq) AS seq, arg_max(kind, seq)::INT AS kind FROM e GROUP BY ALL")
def flush_newest(s, d):
    e = events(s, d).withColumn("run", F.floor(F.col("seq") / 1000))
    return newest(e, ["run", "k"]).select("run", "k", "seq", F.col("kind").cast("int").alias("kind"))


@query(f"WITH {vis(f'WHERE seq <= {OLD}')} SELECT * FROM v")
def compaction_keeps_views(s, d):
    old = at(s, d, 12)
    compacted = without_tombstones(retained(events(s, d), "k", old), old)
    return out(collapse(as_of(compacted, old), "k"))


# ---- E: layout


def files(s: SparkSession, d: str) -> DataFrame:
    """All of E as files: 40 runs of sequence numbers, each cut into five ranges of the key domain. The lowest range's files
    are at level 0, the highest one's at levels 0 and 2 in turn, all others in turn at levels 0, 1 and 2."""
    n = s.read.parquet(f"{d}/events.parquet").agg(F.count(F.lit(1)).alias("n"), (F.max("user_id") + 1).alias("u")).first()
    run, part = F.floor(F.col("seq") * 40 / n.n), F.floor(F.col("k") * 5 / n.u)
    grouped = events(s, d).groupBy((run * 5 + part).alias("number")).agg(F.min("k").alias("smallest"), F.max("k").alias("largest"), F.count(F.lit(1)).alias("num_entries"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))
    own = F.col("number") % 5
    level = F.when(own == 0, 0).when(own == 4, F.floor(F.col("number") / 5) % 2 * 2).otherwise(F.col("number") % 3)
    return grouped.select(level.cast("int").alias("level"), "number", (F.col("num_entries") * 100).alias("size"), "num_entries", "smallest", "largest", "min_seq", "max_seq")


FILES = f"""{E}, c AS (SELECT count(*) AS n, max(user_id) + 1 AS u FROM events),
h AS (SELECT e.*, (seq * 40 // n) * 5 + k * 5 // u AS number FROM e, c),
f AS (SELECT CASE number % 5 WHEN 0 THEN 0 WHEN 4 THEN number // 5 % 2 * 2 ELSE number % 3 END::INT AS level, number::BIGINT AS number, count(*) * 100 AS size, count(*) AS num_entries, min(k) AS smallest, max(k) AS largest, min(seq) AS min_seq, max(seq) AS max_seq
FROM h GROUP BY ALL)"""


@query(f"WITH {FILES} SELECT level, number, size::BIGINT AS size, num_entries::BIGINT AS num_entries, smallest, largest, min_seq, max_seq FROM f")
def file_bounds(s, d):
    return files(s, d)


@query(f"WITH {FILES} SELECT number, smallest, largest FROM f WHERE level = 1 AND largest >= 55 ORDER BY largest, number LIMIT 1")
def find_file(s, d):
    return ranges.find_file(files(s, d).where("level = 1"), 55).select("number", "smallest", "largest")


@query(f"WITH {FILES} SELECT level, number FROM f WHERE smallest <= 50 AND largest >= 45")
def range_overlap(s, d):
    return files(s, d).where(ranges.overlaps(45, 50)).select("level", "number")


@query(f"""WITH RECURSIVE {FILES}, g AS (SELECT * FROM f WHERE level = 0),
r(lo, hi, i) AS (SELECT 10::BIGINT, 14::BIGINT, 0 UNION ALL SELECT * FROM (SELECT (SELECT min(least(g.smallest, r.lo)) FROM g WHERE g.smallest <= r.hi AND g.largest >= r.lo), (SELECT max(greatest(g.largest, r.hi)) FROM g WHERE g.smallest <= r.hi AND g.largest >= r.lo), i + 1 FROM r WHERE i < 30) WHERE 1 = 1)
SELECT number, smallest, largest FROM g WHERE smallest <= (SELECT max(hi) FROM r) AND largest >= (SELECT min(lo) FROM r)""")
def overlap_closure(s, d):
    return ranges.overlap_closure(files(s, d), 0, 10, 14).select("number", "smallest", "largest")


@query(f"WITH {E}, r AS (SELECT i AS range_id, i * 20 AS lo, i * 20 + 20 AS hi FROM range(0, 10) t(i)) SELECT range_id, coalesce(sum(length(event_type) + 8), 0)::BIGINT AS bytes FROM r LEFT JOIN e ON k >= lo AND k < hi GROUP BY range_id")
def approximate_sizes(s, d):
    asked = s.range(10).select(F.col("id").alias("range_id"), (F.col("id") * 20).alias("start"), (F.col("id") * 20 + 20).alias("limit"))
    return ranges.approximate_sizes(events(s, d).select("k", (F.length("event_type") + 8).alias("bytes")), asked)


@query(f"WITH {E}, r AS (SELECT i AS range_id, i // 3 AS lo, i // 3 + 1 + i % 40 AS hi FROM range(0, 300) t(i)) SELECT range_id, coalesce(sum(length(event_type) + 8), 0)::BIGINT AS bytes FROM r LEFT JOIN e ON k >= lo AND k < hi GROUP BY range_id")
def range_sizes_by_prefix_sums(s, d):
    """Overlapping ranges by differences of running sums, as for more ranges than may be broadcast."""
    i = F.col("id")
    asked = s.range(300).select(i.alias("range_id"), F.floor(i / 3).alias("start"), (F.floor(i / 3) + 1 + i % 40).alias("limit"))
    sums = ranges._by_prefix_sums(events(s, d).select("k", (F.length("event_type") + 8).alias("bytes")), asked, "k", "bytes")
    return asked.select("range_id").join(sums, "range_id", "left").select("range_id", F.coalesce("bytes", F.lit(0).cast("long")).alias("bytes"))


@query(f"WITH {FILES} SELECT level, count(*)::BIGINT AS files, sum(size)::BIGINT AS bytes FROM f GROUP BY level")
def level_summary(s, d):
    return ranges.levels(files(s, d))


@query(f"WITH {FILES} SELECT level, round(CASE WHEN level = 0 THEN count(*) ELSE sum(size) / (10000 * 10 ** (level - 1)) END, 6)::DOUBLE AS score FROM f GROUP BY level")
def level_score(s, d):
    return ranges.scores(files(s, d), 10_000).select("level", F.round("score", 6).alias("score"))


@query(f"WITH {FILES} SELECT a.level, a.number, coalesce(sum(b.size), 0)::BIGINT AS bytes FROM f a LEFT JOIN f b ON b.level = a.level + 1 AND b.smallest <= a.largest AND b.largest >= a.smallest WHERE a.level BETWEEN 1 AND 4 GROUP BY a.level, a.number")
def next_level_overlap(s, d):
    return ranges.next_level_overlap(files(s, d))


@query(f"WITH {FILES} SELECT number FROM f a WHERE level = 0 AND NOT EXISTS (SELECT 1 FROM f b WHERE b.level = 1 AND b.smallest <= a.largest AND b.largest >= a.smallest) AND (SELECT count(*) FROM f c WHERE c.level = 2 AND c.smallest <= a.largest AND c.largest >= a.smallest) <= 10")
def trivial_move(s, d):
    return ranges.trivial_moves(files(s, d), 0).select("number")


@query(f"WITH {FILES}, o AS (SELECT a.number, sum(b.size) AS n FROM f a JOIN f b ON b.level = a.level + 1 AND b.smallest <= a.largest AND b.largest >= a.smallest WHERE a.level BETWEEN 1 AND 4 GROUP BY a.number) SELECT coalesce(max(n), 0)::BIGINT AS bytes FROM o")
def max_next_level_overlap(s, d):
    return ranges.max_next_level_overlap(files(s, d))


@query(f"WITH {FILES} SELECT min(smallest) AS smallest, max(largest) AS largest FROM f WHERE level IN (0, 2) AND number % 5 IN (1, 4)")
def joint_bounds(s, d):
    f = files(s, d).where("number % 5 IN (1, 4)")
    return ranges.joint_bounds(f.where("level = 0"), f.where("level = 2"))


@query(f"WITH {FILES} SELECT number FROM f WHERE level = 1 AND (number = (SELECT min(number) FROM f WHERE level = 1) OR smallest = (SELECT largest FROM f WHERE level = 1 ORDER BY number LIMIT 1))")
def boundary_files(s, d):
    """The first file of level 1 and those that begin with its last key: rows of a manifest, handled on the driver."""
    rows = [r.asDict() for r in files(s, d).where("level = 1").collect()]
    first = min(rows, key=lambda r: r["number"])
    more = [r for r in rows if r["smallest"] == first["largest"]]
    got = compaction.boundary_files([first, *more], [first])
    return s.createDataFrame([(r["number"],) for r in got], "number long")


@query(f"WITH {FILES} SELECT level, min(smallest) AS smallest, max(largest) AS largest FROM f GROUP BY level")
def level_bounds(s, d):
    return ranges.bounds(files(s, d))


# ---- F: shards


@query("SELECT i AS shard_id, i * (n // 8) AS lower, CASE WHEN i = 7 THEN n ELSE (i + 1) * (n // 8) END AS upper FROM (SELECT count(*) AS n FROM orders), range(0, 8) t(i)")
def shard_bounds(s, d):
    return shards.bounds(s, 0, orders(s, d).count(), 8)


@query("SELECT o_orderkey AS k, least(o_orderkey // (n // 8), 7)::BIGINT AS shard_id FROM orders, (SELECT count(*) AS n FROM orders)")
def shard_route(s, d):
    o = orders(s, d)
    return o.select("k", shards.route(F.col("k"), 0, o.count(), 8).alias("shard_id"))


@query("SELECT CASE WHEN o_orderkey < 1000 THEN 0 WHEN o_orderkey < 5000 THEN 1 END::BIGINT AS shard_id, count(*)::BIGINT AS rows, sum(CAST(o_totalprice * 100 AS BIGINT))::BIGINT AS cents FROM orders GROUP BY 1")
def shard_balance(s, d):
    table = s.createDataFrame([(0, 0, 1000), (1, 1000, 5000)], "shard_id long, lower long, upper long")
    return shards.route_by(orders(s, d), "k", table).groupBy("shard_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.round(F.col("price") * 100).cast("long")).alias("cents"))


@query("SELECT i AS shard_id, 2 * (i % 4) AS node FROM range(0, 16) t(i)")
def shard_round_robin(s, d):
    return s.range(16).select(F.col("id").alias("shard_id"), shards.round_robin(F.col("id"), 4).alias("node"))


# ---- G: workloads


@query("SELECT i AS k, i + 1 AS seq, repeat('v', (i % 7)::INT) AS v FROM range(0, 20000) t(i)")
def fill_seq(s, d):
    log = s.range(20_000).select(F.col("id").alias("k"), (F.col("id") + 1).alias("seq"), F.lit(1).alias("kind"), F.repeat(F.lit("v"), (F.col("id") % 7).cast("int")).alias("v"))
    return collapse(log, "k").select("k", "seq", "v")


@query("SELECT (i * 7919 + i // 3) % 5000 AS k, max(i) AS seq, count(*)::BIGINT AS writes FROM range(0, 20000) t(i) GROUP BY 1")
def fill_random_overwrite(s, d):
    log = s.range(20_000).select(((F.col("id") * 7919 + F.floor(F.col("id") / 3)) % 5000).alias("k"), F.col("id").alias("seq"), F.lit(1).alias("kind"))
    counts = log.groupBy("k").agg(F.count(F.lit(1)).alias("writes"))
    return collapse(log, "k").join(counts, "k").select("k", "seq", "writes")


def dead(keys: DataFrame) -> DataFrame:
    return keys.select("k", F.lit(1 << 40).cast("long").alias("seq"), F.lit(0).cast("tinyint").alias("kind"), F.lit(None).cast("double").alias("price"))


@query("SELECT o_orderkey AS k, o_totalprice AS price FROM orders WHERE o_orderkey >= (SELECT count(*) // 3 FROM orders)")
def delete_seq(s, d):
    o = orders(s, d).select("k", "seq", "kind", "price")
    gone = s.range(o.count() // 3).select(F.col("id").alias("k"))
    return collapse_dense(o.unionByName(dead(gone)), "k").select("k", "price")


@query("WITH n AS (SELECT count(*) AS n FROM orders) SELECT o_orderkey AS k, o_totalprice AS price FROM orders WHERE o_orderkey NOT IN (SELECT (i * 7919) % n FROM n, range(0, (SELECT count(*) // 5 FROM orders)) t(i))")
def delete_random(s, d):
    o = orders(s, d).select("k", "seq", "kind", "price")
    n = o.count()
    gone = s.range(n // 5).select(F.pmod(F.col("id") * 7919, F.lit(n)).alias("k"))
    return collapse_dense(o.unionByName(dead(gone)), "k").select("k", "price")


_MIX = "WITH {e}, w AS (SELECT k, seq FROM e WHERE seq % 100 >= {p} AND kind = 1), r AS (SELECT k, seq AS at FROM e WHERE seq % 100 < {p}) SELECT r.k, r.at, max(w.seq) AS seen FROM r LEFT JOIN w ON w.k = r.k AND w.seq < r.at GROUP BY r.k, r.at"


def _mix(s: SparkSession, d: str, percent: int) -> DataFrame:
    """Of each hundred operations first ``percent`` read, then the rest write; a read sees what the writes before it left: a
    running maximum in each key, no join."""
    e = events(s, d)
    reads = F.col("seq") % 100 < percent
    wrote = F.max(F.when(~reads & (F.col("kind") == 1), F.col("seq"))).over(W.partitionBy("k").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    return e.withColumn("seen", wrote).where(reads).select("k", F.col("seq").alias("at"), "seen")


@query(_MIX.format(e=E, p=25))
def read_write_mix(s, d):
    return _mix(s, d, 25)


@query(_MIX.format(e=E, p=50))
def read_write_mix_50(s, d):
    return _mix(s, d, 50)


@query(_MIX.format(e=E, p=95))
def read_write_mix_95(s, d):
    return _mix(s, d, 95)


@query("SELECT i AS k, 100000::BIGINT AS bytes, 1::BIGINT AS versions FROM range(0, (SELECT count(*) // 1000 FROM orders)) t(i)")
def fill_100k(s, d):
    """A thousandth of the keys, with values of 100,000 bytes that compress by half."""
    n = orders(s, d).count() // 1000
    log = s.range(n).select(F.col("id").alias("k"), F.col("id").alias("seq"), F.lit(1).alias("kind"), generate.compressible(F.col("id"), 100_000, 0.5, 7).alias("v"))
    return collapse(log, "k").select("k", F.octet_length("v").cast("long").alias("bytes"), F.lit(1).cast("long").alias("versions"))


@query("WITH n AS (SELECT count(*) AS n FROM orders) SELECT (i * 7919) % (n // 8) + 3 * (n // 8) AS k, max(i) AS seq FROM n, range(0, (SELECT count(*) // 4 FROM orders)) t(i) GROUP BY 1")
def fill_random_shard(s, d):
    """Random writes within the fourth of eight shards."""
    n = orders(s, d).count()
    log = s.range(n // 4).select((F.pmod(F.col("id") * 7919, F.lit(n // 8)) + 3 * (n // 8)).alias("k"), F.col("id").alias("seq"), F.lit(1).alias("kind"))
    own = log.where(shards.route(F.col("k"), 0, n, 8) == 3)
    return collapse(own, "k").select("k", "seq")


@query("WITH n AS (SELECT count(*) AS n FROM orders), p AS (SELECT DISTINCT (i * 104729) % (n // 8) + 5 * (n // 8) AS k FROM n, range(0, 2000) t(i)) SELECT k, o_totalprice AS price FROM p JOIN orders ON k = o_orderkey")
def read_random_shard(s, d):
    """Random reads within the sixth of eight shards: the shard's bounds reach the scan."""
    o = orders(s, d)
    n = o.count()
    probes = s.range(2000).select((F.pmod(F.col("id") * 104729, F.lit(n // 8)) + 5 * (n // 8)).alias("k"))
    return View(o.where(F.col("k").between(5 * (n // 8), 6 * (n // 8) - 1)), "k").multi_get(probes).select("k", "price")


@query("WITH n AS (SELECT count(*) AS n FROM orders), p AS (SELECT (i * 104729) % n AS k FROM n, range(0, (SELECT count(*) // 1000 FROM orders)) t(i)) SELECT k, o_totalprice AS price FROM p JOIN orders ON k = o_orderkey")
def read_random_small(s, d):
    o = orders(s, d)
    n = o.count()
    return View(o, "k").multi_get(s.range(n // 1000).select(F.pmod(F.col("id") * 104729, F.lit(n)).alias("k"))).select("k", "price")


@query(f"WITH {vis(f'WHERE seq <= {OLD}')}, late AS (SELECT count(*)::BIGINT AS n FROM e WHERE seq > {OLD}) SELECT v.k, v.seq, late.n AS later_writes FROM v, late")
def read_while_writing(s, d):
    """A pinned view beside the writes that came after it (``store_snapshot_while_writing`` does it with a store)."""
    e, old = events(s, d), at(s, d, 12)
    later = e.where(F.col("seq") > old).count()
    return collapse(e, "k", old).select("k", "seq", F.lit(later).cast("long").alias("later_writes"))


_LIMITS = f"l AS (SELECT unnest({histogram.LIMITS}) AS u, unnest({[0.0, *histogram.LIMITS[:-1]]}) AS w, unnest(range(0, {len(histogram.LIMITS)})) AS bucket)"


@query(f"WITH {_LIMITS} SELECT event_type, bucket::INT AS bucket, count(*)::BIGINT AS n, min(value) AS lo, max(value) AS hi FROM events JOIN l ON value < u AND (value >= w OR bucket = 0) GROUP BY ALL")
def histogram_buckets(s, d):
    """Two halves of the events, merged."""
    e = s.read.parquet(f"{d}/events.parquet")
    halves = [histogram.histogram(e.where(F.col("event_id") % 2 == i), "value", ["event_type"]) for i in (0, 1)]
    return histogram.merge(halves, ["event_type"]).select("event_type", "bucket", "n", "lo", "hi")


@query(f"""WITH {_LIMITS}, b AS (SELECT event_type, bucket, w, u, count(*) AS n FROM events JOIN l ON value < u AND (value >= w OR bucket = 0) GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bucket) AS upto FROM b),
t AS (SELECT event_type, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS dev, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1),
p AS (SELECT event_type, q, min_by(least(greatest(w + (u - w) * ((t.n * q - (upto - c.n)) / c.n), lo), hi), bucket) AS x FROM c JOIN t USING (event_type), (SELECT unnest([0.5, 0.99]) AS q) WHERE upto >= t.n * q GROUP BY 1, 2)
SELECT event_type, round(max(CASE WHEN q = 0.5 THEN x END), 4) AS median, round(max(CASE WHEN q = 0.99 THEN x END), 4) AS p99, round(any_value(mean), 4) AS mean, round(any_value(dev), 4) AS stddev FROM p JOIN t USING (event_type) GROUP BY 1""")
def histogram_stats(s, d):
    h = histogram.histogram(s.read.parquet(f"{d}/events.parquet"), "value", ["event_type"])
    got = histogram.summary(h, ["event_type"], (50.0, 99.0))
    return got.select("event_type", F.round("p50", 4).alias("median"), F.round("p99", 4).alias("p99"), F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"))


# ---- H: codecs


@query("SELECT o_orderkey AS n, lpad(hex(o_orderkey), 16, '0') || repeat('30', 12) AS k FROM orders")
def key_be64_order(s, d):
    return orders(s, d).select(F.col("k").alias("n"), F.hex(be64_key(F.col("k"))).alias("k"))


@query("SELECT o_orderkey AS n, lpad(CAST(o_orderkey AS VARCHAR), 20, '0') AS k FROM orders")
def key_decimal_order(s, d):
    return orders(s, d).select(F.col("k").alias("n"), dec_key(F.col("k")).alias("k"))


@query("""SELECT o_orderkey AS n, hex(o_orderkey % 256)[-2:] || lpad(hex(o_orderkey // 256 % 256), 2, '0') || lpad(hex(o_orderkey // 65536), 4, '0') AS raw,
CASE WHEN o_orderkey < 128 THEN lpad(hex(o_orderkey), 2, '0') WHEN o_orderkey < 16384 THEN hex(o_orderkey % 128 + 128) || lpad(hex(o_orderkey // 128), 2, '0')
ELSE hex(o_orderkey % 128 + 128) || hex(o_orderkey // 128 % 128 + 128) || lpad(hex(o_orderkey // 16384), 2, '0') END AS varint,
'05' || hex(encode(o_orderpriority[:5])) AS prefixed, o_orderstatus AS escaped FROM orders""".replace("hex(o_orderkey % 256)[-2:]", "lpad(hex(o_orderkey % 256), 2, '0')"))
def codecs(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    n = F.col("o_orderkey")
    short = F.encode(F.substring("o_orderpriority", 1, 5), "UTF-8")
    return o.select(n.alias("n"), F.hex(fixed(n, 4)).alias("raw"), F.hex(varint(n)).alias("varint"), F.hex(prefixed(short)).alias("prefixed"), escaped(F.encode("o_orderstatus", "UTF-8")).alias("escaped"))


@query("SELECT lpad(hex(n), 16, '0') AS nk, '[0x' || lower(hex(n)) || ']' AS newest, 2::BIGINT AS versions FROM (SELECT p_partkey AS n FROM part)")
def comparator_normalised(s, d):
    """Two spellings of a number are one key; the newest spelling is reported."""
    p = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("n"))
    a = p.select(F.encode(F.concat(F.lit("["), F.col("n").cast("string"), F.lit("]")), "UTF-8").alias("k"), F.lit(1).alias("seq"), F.lit(1).alias("kind"))
    b = p.select(F.encode(F.concat(F.lit("[0x"), F.lower(F.hex("n")), F.lit("]")), "UTF-8").alias("k"), F.lit(2).alias("seq"), F.lit(1).alias("kind"))
    log = a.union(b).withColumn("nk", bracketed_number(F.col("k")))
    counts = log.groupBy("nk").agg(F.count(F.lit(1)).alias("versions"))
    return collapse(log, "nk").join(counts, "nk").select(F.hex("nk").alias("nk"), F.decode("k", "UTF-8").alias("newest"), "versions")


@query(f"WITH {E} SELECT lpad(hex(k), 16, '0') || ' @ ' || seq || ' : ' || CASE kind WHEN 1 THEN 'put' ELSE 'del' END || ' => ' || CASE kind WHEN 1 THEN event_type ELSE '' END AS line FROM e")
def dump_format(s, d):
    e = events(s, d)
    return e.select(F.format_string("%s @ %d : %s => %s", F.lpad(F.hex("k"), 16, "0"), "seq", F.when(F.col("kind") == 1, "put").otherwise("del"), F.when(F.col("kind") == 1, F.col("event_type")).otherwise("")).alias("line"))


def checksums(s: SparkSession, d: str) -> DataFrame:
    """Checksums and hashes of event properties (no SQL: tested against byte-wise Python)."""
    raw = F.encode("props", "UTF-8")
    e = s.read.parquet(f"{d}/events.parquet").select("event_id", crc32c_of(raw).alias("crc"), hash32(raw).alias("hash"))
    return e.select("event_id", "crc", crc_masked(F.col("crc")).alias("masked"), "hash")


def queries() -> dict[str, Query]:
    return QUERIES | stores.QUERIES | {"checksums": checksums}


def oracle_sql() -> dict[str, str]:
    return ORACLE | stores.ORACLE
