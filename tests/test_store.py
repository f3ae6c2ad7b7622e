"""The durable store: contract scenarios and a model-based random test."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.functions import keys
from tidemark.operators import ranges
from tidemark.sources.batch import OPLOG, WriteBatch, dump, sequenced, validate
from tidemark.functions import generate, histogram
from tidemark.operators import compaction
from tidemark.operators.scan import next_keys, ranked
from tidemark.plans import catalog
from tidemark.sources.batch import dump_files
from tidemark.sources.errors import Conflict, Corruption, InvalidArgument
from tidemark.sources.store import OrderedStore, ShardedStore
from tidemark.streaming.ingest import ingest


@pytest.fixture()
def store(spark, tmp_path):
    return OrderedStore.open(spark, str(tmp_path / "db"))


def rows(df):
    return [(bytes(r.k), bytes(r.v)) for r in df.collect()]


def test_put_overwrite_delete_reopen(spark, store):
    store.put(b"foo", b"v1")
    store.write(WriteBatch().put(b"foo", b"v2").put(b"", b"").put(b"\xff", b"z"))
    assert store.get(b"foo") == b"v2" and store.get(b"") == b"" and store.get(b"none") is None
    store.delete(b"foo")
    again = OrderedStore.open(spark, store.path, create_if_missing=False)
    assert again.get(b"foo") is None and rows(again.scan()) == [(b"", b""), (b"\xff", b"z")]
    with pytest.raises(InvalidArgument):
        OrderedStore.open(spark, store.path, error_if_exists=True)
    with pytest.raises(InvalidArgument):
        OrderedStore.open(spark, store.path, comparator="other")
    with pytest.raises(InvalidArgument):
        OrderedStore.open(spark, store.path + "x", create_if_missing=False)
    OrderedStore.destroy(spark, store.path)
    OrderedStore.destroy(spark, store.path)


def test_two_writers(spark, store):
    other = OrderedStore.open(spark, store.path)
    store.put(b"a", b"1")
    with pytest.raises(InvalidArgument):
        other.put(b"b", b"2")


def test_snapshots_retention_and_tombstones(spark, store):
    store.put(b"foo", b"v1")
    s1 = store.snapshot()
    store.put(b"foo", b"v2")
    s2 = store.snapshot()
    store.write(WriteBatch().delete(b"foo").put(b"bar", b"x"))
    store.compact()
    assert [store.get(b"foo", store.seq_of(s)) for s in (s1, s2)] == [b"v1", b"v2"] and store.get(b"foo") is None
    assert store.oplog().count() == 4
    store.release(s1)
    store.compact()
    assert store.get(b"foo", store.seq_of(s2)) == b"v2" and store.oplog().count() == 3
    store.release(s2)
    store.compact()
    assert rows(store.scan()) == [(b"bar", b"x")] and store.oplog().count() == 1
    assert store.property("num-files-at-level1") == "1" and store.property("num-files-at-level9") is None and store.property("what") is None
    assert store.vacuum() > 0 and rows(store.scan()) == [(b"bar", b"x")]
    repaired = OrderedStore.repair(spark, store.path)
    assert rows(repaired.scan()) == [(b"bar", b"x")] and repaired.property("num-files-at-level0") == "1"
    assert repaired.property("stats") and "62617" in repaired.property("sstables") or "626172" in repaired.property("sstables")


def test_cursor_moves_both_ways(store):
    store.write(WriteBatch().put(b"1", b"a").put(b"2", b"b").put(b"3", b"c").put(b"4", b"d").put(b"5", b"e").put(b"x", b"y").delete(b"x"))
    c = store.cursor()
    c.seek(bytearray(b"5"))
    store.put(b"25", b"later")
    seen = [bytes(c.key)]
    for step in (c.prev, c.prev, c.next, c.next):
        step()
        seen.append(bytes(c.key))
    assert seen == [b"5", b"4", b"3", b"4", b"5"]
    c.next()
    assert not c.valid
    c.seek_to_last()
    assert bytes(c.key) == b"5"
    c.seek_to_first()
    c.prev()
    assert not c.valid


def test_comparator_normalises(spark, tmp_path):
    store = OrderedStore.open(spark, str(tmp_path / "n"), comparator="numbers", normaliser=keys.bracketed_number)
    store.write(WriteBatch().put(b"[10]", b"ten").put(b"[0xa]", b"TEN").put(b"[2]", b"two"))
    assert store.get(b"[10]") == store.get(b"[0xa]") == b"TEN"
    assert [bytes(r.v) for r in store.scan().collect()] == [b"two", b"TEN"]


def test_batch_rules(spark):
    b = WriteBatch().put(b"foo", b"bar").delete(b"box").put(b"baz", b"boo")
    assert [(bytes(r.k), r.seq, r.kind) for r in b.oplog(spark, 100).collect()] == [(b"foo", 100, 1), (b"box", 101, 0), (b"baz", 102, 1)]
    assert b.approximate_size() == 12 + 1 + 4 + 4 + 1 + 4 + 1 + 4 + 4
    log = []
    b.iterate(lambda k, v: log.append((k, v)), lambda k: log.append((k,)))
    assert log == [(b"foo", b"bar"), (b"box",), (b"baz", b"boo")]
    assert len(WriteBatch().append(b).append(b)) == 6
    assert [r.line for r in dump(b.oplog(spark, 1)).collect()][0] == "62617A @ 3 : put => 626F6F"
    with pytest.raises(Corruption):
        validate(spark.createDataFrame([(b"k", -1, 1, b"v")], OPLOG))
    got = sequenced(spark.range(1000).select((F.col("id") * 7 % 1000).alias("o")), 11, "o").collect()
    assert {(r.o, r.seq) for r in got} == {(i, 11 + i) for i in range(1000)}


def test_random_operations_against_a_dict(spark, store):
    r = random.Random(12)
    model, pinned = {}, []
    alphabet = [b"\x00", b"\x01", b"a", b"b", b"\xfd", b"\xff"]
    for step in range(14):
        batch = WriteBatch()
        for _ in range(r.randint(1, 40)):
            k = b"".join(r.choice(alphabet) for _ in range(r.randint(0, 3)))
            if r.random() < 0.5:
                v = r.randbytes(r.randint(0, 7))
                batch.put(k, v)
                model[k] = v
            else:
                batch.delete(k)
                model.pop(k, None)
        store.write(batch)
        if step % 4 == 1:
            pinned.append((store.snapshot(), dict(model)))
        if step % 5 == 4:
            store.compact()
        if len(pinned) > 2:
            store.release(pinned.pop(0)[0])
    assert rows(store.scan()) == sorted(model.items())
    for name, state in pinned:
        assert rows(store.scan(store.seq_of(name))) == sorted(state.items())
    store.compact(b"a", b"b")
    assert rows(store.scan()) == sorted(model.items())
    assert store.approximate_sizes([(b"", b"\xff\xff\xff\xff")])[0] > 0


def test_stream_is_ingested_once(spark, store, tmp_path):
    src = str(tmp_path / "in")
    WriteBatch().put(b"a", b"1").put(b"b", b"2").oplog(spark, 1).write.parquet(src)
    stream = lambda: spark.readStream.schema(OPLOG).parquet(src)
    ingest(stream(), store, str(tmp_path / "cp")).awaitTermination()
    WriteBatch().delete(b"a").oplog(spark, 3).write.mode("append").parquet(src)
    ingest(stream(), store, str(tmp_path / "cp")).awaitTermination()
    ingest(stream(), store, str(tmp_path / "cp")).awaitTermination()
    assert rows(store.scan()) == [(b"b", b"2")] and store.oplog().count() == 3
    assert store.ingest(WriteBatch().put(b"z", b"z").oplog(spark, 9), "ingest-0") is False


def test_key_helpers():
    assert keys.short_successor(b"\xff\xffab") == b"\xff\xffb" and keys.short_successor(b"\xff") == b"\xff"
    assert keys.prefix_end(b"a\xff") == b"b" and keys.prefix_end(b"\xff") is None
    assert keys.shortest_separator(b"abcdefghij", b"abzz") == b"abd" and keys.shortest_separator(b"a", b"ab") == b"a"
    assert keys.crc32c(bytes(32)) == 0x8A9136AA and keys.crc32c(b"hello world") == keys.crc32c(b" world", keys.crc32c(b"hello"))


def test_file_ranges(spark):
    files = spark.createDataFrame([(0, i, 1, a, b) for i, (a, b) in enumerate([("150", "200"), ("200", "250"), ("300", "350"), ("400", "450")])], "level int, number long, size long, smallest string, largest string")
    find = lambda k: [r.number for r in ranges.find_file(files, k).collect()]
    assert find("201") == [1] and find("251") == [2] and find("451") == [] and find("100") == [0]
    hit = lambda lo, hi: not files.where(ranges.overlaps(lo, hi)).isEmpty()
    assert not hit("251", "299") and hit("100", "150") and hit(None, "150") and not hit("451", None) and hit(None, None) and hit("450", "700")


def test_conflict_leaves_the_store_and_the_handle_whole(spark, store):
    other = OrderedStore.open(spark, store.path)
    store.put(b"a", b"1")
    with pytest.raises(Conflict):
        other.put(b"b", b"2")
    assert other.get(b"a") == b"1" and other.get(b"b") is None
    other.put(b"c", b"3")
    with pytest.raises(Conflict):
        store.snapshot()
    assert not store.state.snapshots
    again = OrderedStore.open(spark, store.path)
    assert rows(again.scan()) == [(b"a", b"1"), (b"c", b"3")] and again.state.last_seq == 2
    assert store.vacuum() == 1 and rows(store.scan()) == rows(again.scan())
    third = OrderedStore.open(spark, store.path)
    store.put(b"d", b"4")
    third.write(WriteBatch().put(b"e", b"5"), retries=1)
    assert [k for k, _ in rows(third.scan())] == [b"a", b"c", b"d", b"e"]


def test_bad_rows_are_found_while_writing(spark, store):
    bad = spark.createDataFrame([(b"k", 1, 1, b"v"), (b"l", 2, 1, None)], OPLOG)
    with pytest.raises(Corruption):
        store.ingest(bad)
    assert not store.state.files and store.ingest(bad.limit(0)) is False


def test_repair_keeps_what_manifests_say(spark, store):
    store.ingest(WriteBatch().put(b"a", b"1").delete(b"b").oplog(spark, 1), "s-4")
    name = store.snapshot()
    store.put(b"a", b"2")
    store.compact()
    with open(store.path + f"/MANIFEST-{store.state.version + 1:020d}.json", "w") as f:
        f.write("{broken")
    with pytest.raises(Corruption):
        OrderedStore.open(spark, store.path)
    fixed = OrderedStore.repair(spark, store.path)
    assert fixed.get(b"a") == b"2" and fixed.get(b"a", fixed.seq_of(name)) == b"1"
    assert fixed.oplog().count() == store.oplog().count()
    assert fixed.ingest(WriteBatch().put(b"z", b"z").oplog(spark, 9), "s-4") is False
    assert rows(OrderedStore.open(spark, store.path).scan()) == [(b"a", b"2")]


def test_partial_compaction_keeps_needed_tombstones(spark, store):
    store.write(WriteBatch().put(b"a", b"1").put(b"b", b"1").put(b"m", b"1"))
    store.compact(level=3)
    for _ in range(4):
        store.write(WriteBatch().delete(b"a").delete(b"x").put(b"y", b"2"))
    done = store.compact_once()
    assert done["level"] == 0 and not done["trivial"] and len(done["inputs"]) == 4 and store.compact_once() is None
    left = {bytes(r.k) for r in store.oplog().where("kind = 0").collect()}
    assert left == {b"a"} and store.get(b"a") is None and rows(store.scan()) == [(b"b", b"1"), (b"m", b"1"), (b"y", b"2")]
    assert store.property("stats").splitlines()[1].split()[0] == "1" and int(store.property("stats").splitlines()[1].split()[4]) > 0
    assert len(dump_files(store.files()).collect()) == len(store.state.files)


def test_compaction_policy_rules():
    f = lambda n, level, a, b, size=10: {"number": n, "level": level, "smallest": a, "largest": b, "size": size}
    level = [f(1, 1, "A", "C"), f(2, 1, "C", "E"), f(3, 1, "E", "G"), f(4, 1, "H", "I")]
    assert [x["number"] for x in compaction.boundary_files(level, [level[0]])] == [1, 2, 3]
    assert compaction.boundary_files(level, []) == [] and compaction.bounds(level[:1], level[3:]) == ("A", "I")
    job = compaction.pick([*level, f(5, 2, "B", "B"), f(6, 2, "Z", "Z")], level_bytes=10)
    assert job.level == 1 and [x["number"] for x in job.inputs] == [1, 2, 3] and [x["number"] for x in job.below] == [5] and not job.trivial
    job = compaction.pick(level, {"1": "G"}, level_bytes=10)
    assert [x["number"] for x in job.inputs] == [4] and job.trivial
    assert compaction.pick(level, {"1": "Z"}, level_bytes=10).inputs[0]["number"] == 1
    assert not compaction.may_move([level[3], *[f(10 + i, 3, "H", "H") for i in range(11)]], level[3])
    assert compaction.pick(level, level_bytes=1000) is None
    assert [x["number"] for x in compaction.closure(level, "F", "F")] == [1, 2, 3]


def test_sizes_come_from_the_manifest(spark, store):
    body = spark.range(80).select(F.encode(F.format_string("k%03d", "id"), "UTF-8").alias("k"), (F.col("id") + 1).alias("seq"), F.lit(1).cast("tinyint").alias("kind"), F.encode(generate.text(F.col("id"), 2000, 3), "UTF-8").alias("v"))
    store.ingest(body.coalesce(1))
    total = sum(x["size"] for x in store.state.files)
    got = store.approximate_sizes([(b"", b"\xff"), (b"", b"k040"), (b"k040", b"k041"), (b"k9", b"k99"), (b"k050", b"k010")])
    assert got[0] == total and abs(got[1] / total - 0.5) < 0.1 and 0 < got[2] < total / 20 and got[3] == got[4] == 0


def test_sharded_store(spark, tmp_path):
    bounds = [(b"a", b"h"), (b"h", b"p"), (b"q", b"z")]
    store = ShardedStore.create(spark, str(tmp_path / "s"), bounds)
    with pytest.raises(InvalidArgument):
        ShardedStore.create(spark, str(tmp_path / "s"), bounds[:2])
    store.write(WriteBatch().put(b"abc", b"1").put(b"hij", b"2").put(b"r", b"3").put(b"b", b"4").delete(b"b"))
    assert [store.route(k) for k in (b"a", b"gz", b"h", b"q")] == [0, 0, 1, 2]
    for k in (b"p", b"z", b"A"):
        with pytest.raises(InvalidArgument):
            store.route(k)
        with pytest.raises(InvalidArgument):
            store.put(k, b"x")
    assert store.get(b"hij") == b"2" and [rows(store.scan_shard(i)) for i in range(3)] == [[(b"abc", b"1")], [(b"hij", b"2")], [(b"r", b"3")]]
    name = store.snapshot()
    store.write(WriteBatch().put(b"abc", b"new").put(b"s", b"5"))
    before = store.shard_sizes()
    store.compact_shard(2)
    assert {f["level"] for f in store._of(2)} == {1} and {f["level"] for f in store._of(0)} == {0} and store.shard_sizes()[:2] == before[:2]
    assert rows(store.scan_shard(0, store.seq_of(name))) == [(b"abc", b"1")] and rows(store.scan()) == [(b"abc", b"new"), (b"hij", b"2"), (b"r", b"3"), (b"s", b"5")]
    c = store.shard_cursor(2)
    c.seek_to_last()
    assert bytes(c.key) == b"s"
    again = OrderedStore.repair(spark, store.path)
    assert len(again.state.shards) == 3


def test_ranked_and_next_keys_of_any_type(spark):
    keys = [b"", b"\x00", b"a", b"ab", b"b\xff", b"\xff\xff"]
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "k binary")
    assert [bytes(r.k) for r in sorted(ranked(df, "k").collect(), key=lambda r: r.rn)] == keys
    assert {bytes(r.k): r.rn for r in ranked(df, "k", desc=True).collect()}[b""] == 6
    asked = [b"", b"\x00\x00", b"aa", b"ab", b"c", b"\xff\xff\xff"]
    got = {bytes(r.target): r.found and bytes(r.found) for r in next_keys(df, "k", spark.createDataFrame([(bytearray(t),) for t in asked], "target binary")).collect()}
    assert got == {t: next((k for k in keys if k >= t), None) for t in asked}
    assert next_keys(df.limit(0), "k", df.select(F.col("k").alias("target"))).where("found is not null").count() == 0
    days = spark.sql("SELECT date_add(DATE'2024-01-01', CAST(id * 3 AS INT)) AS k FROM range(300)")
    assert next_keys(days, "k", days.select(F.date_sub("k", 1).alias("target"))).where("found = date_add(target, 1)").count() == 300


def slow_hash(data, seed=0):
    h = seed ^ len(data) * keys.MULTIPLIER & 0xFFFFFFFF
    for at in range(0, len(data) - 3, 4):
        h = (h + int.from_bytes(data[at : at + 4], "little")) * keys.MULTIPLIER & 0xFFFFFFFF
        h ^= h >> 16
    tail = data[len(data) // 4 * 4 :]
    if tail:
        h = (h + sum((b - 256 if b > 127 else b) << 8 * i for i, b in enumerate(tail))) * keys.MULTIPLIER & 0xFFFFFFFF
        h ^= h >> 24
    return h


def test_codecs(spark):
    r = random.Random(4)
    data = [b"", b"a", b"\xe1", b"ab\xff", b"12345678", b"\xe1\x80\xb9\x32"] + [r.randbytes(r.randint(0, 40)) for _ in range(40)]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(data)], "i int, b binary")
    b = F.col("b")
    crc = keys.crc32c_of(b)
    got = df.select("i", crc.alias("crc"), keys.crc_unmasked(keys.crc_masked(crc)).alias("back"), keys.crc_masked(crc).alias("masked"), keys.hash32(b, 7).alias("h"), keys.prefixed_value(keys.prefixed(b)).alias("p"), keys.escaped(b).alias("e")).collect()
    for row in got:
        x = data[row.i]
        assert row.crc == row.back == keys.crc32c(x) and row.masked != row.crc and row.h == slow_hash(x, 7) and bytes(row.p) == x
        assert row.e == "".join(chr(c) if 32 <= c <= 126 else f"\\x{c:02x}" for c in x)
    numbers = [0, 1, 127, 128, 300, 16383, 16384, 2**32 - 1, 2**62, 2**63 - 1]
    n = F.col("n")
    got = spark.createDataFrame([(x,) for x in numbers], "n long").select("n", keys.varint(n).alias("v"), keys.varint_value(keys.varint(n)).alias("w"), keys.fixed(n, 8).alias("f"), keys.fixed_value(keys.fixed(n, 8)).alias("g")).collect()
    for row in got:
        assert row.w == row.g == row.n and len(row.v) == keys.varint_length(row.n) and bytes(row.f) == row.n.to_bytes(8, "little")
    assert spark.range(1).select(keys.varint_value(F.lit(b"\x80")).alias("x"), keys.prefixed_value(F.lit(b"\x05ab")).alias("y")).first() == (None, None)
    said = {"12ab": 12, "007": 7, "x": None, "18446744073709551615": 2**64 - 1, "18446744073709551616": None, "9" * 30: None, "": None}
    assert {r.t: r.n and int(r.n) for r in spark.createDataFrame([(t,) for t in said], "t string").select("t", keys.leading_number(F.col("t")).alias("n")).collect()} == said


def test_codecs_query_on_large_keys(spark, tmp_path):
    """Fixed fields are little-endian in all four bytes, and varints have as many bytes as they need."""
    numbers = [0, 127, 128, 65535, 65536, 65537, 149_999, 2**21 - 1, 2**21, 2**24 - 1, 2**24, 2**28, 2**31, 2**32 - 1]
    spark.createDataFrame([(n, "F", "1-URGENT") for n in numbers], "o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.n: (r.raw, r.varint) for r in catalog.queries()["codecs"](spark, str(tmp_path)).collect()}
    varint = lambda n: bytes([n & 127 | (128 if n > 127 else 0)]) + (varint(n >> 7) if n > 127 else b"")
    assert got == {n: (n.to_bytes(4, "little").hex().upper(), varint(n).hex().upper()) for n in numbers}


def test_checksums_query(spark):
    d = "/root/testdata/sf0.001"
    props = {r.event_id: r.props.encode() for r in spark.read.parquet(f"{d}/events.parquet").select("event_id", "props").collect()}
    for row in catalog.queries()["checksums"](spark, d).collect():
        assert row.crc == keys.crc32c(props[row.event_id]) and row.hash == slow_hash(props[row.event_id])


def test_checksums_of_long_values(spark):
    """Time follows the size of a value: work for each byte must not begin again with the whole of it."""
    r = random.Random(5)
    data = [r.randbytes(n) for n in (20_000, 20_003, 40_001)]
    b = F.col("b")
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(data)], "i int, b binary")
    late = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        got = df.select("i", keys.crc32c_of(b).alias("crc"), keys.hash32(b, 7).alias("h"), keys.escaped(b).alias("e")).collect()
    finally:
        late.cancel()
    for row in got:
        x = data[row.i]
        assert row.crc == keys.crc32c(x) and row.h == slow_hash(x, 7) and row.e == "".join(chr(c) if 32 <= c <= 126 else f"\\x{c:02x}" for c in x)


def test_checksums_of_odd_values(spark):
    """All sizes about a word's, signed and zero bytes; null has the checksum of no bytes and no hash."""
    data = [bytes([b]) * n for n in range(30) for b in (0, 1, 127, 128, 255)] + [bytes([0, 255, 128][i % 3] for i in range(n)) for n in range(30)]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(data)] + [(len(data), None)], "i int, b binary")
    for row in df.select("i", keys.crc32c_of(F.col("b")).alias("crc"), keys.hash32(F.col("b")).alias("h")).collect():
        assert (row.crc, row.h) == ((keys.crc32c(data[row.i]), slow_hash(data[row.i])) if row.i < len(data) else (0, None))


def test_generators(spark):
    i = F.col("id")
    got = spark.range(500).select(generate.text(i, F.col("id") % 9, 1).alias("t"), generate.key(i, 3, 1).alias("k"), generate.compressible(i, 100, 0.25, 1).alias("c"), generate.skewed(i, 10, 1).alias("s")).collect()
    assert all(len(r.t) == n % 9 and r.t.isascii() and r.t.isprintable() for n, r in enumerate(got))
    assert all(set(r.k) <= set(generate.ALPHABET) and len(r.k) == 3 for r in got)
    assert all(r.c[:25] * 4 == r.c for r in got) and sorted(r.s for r in got)[250] < 64 and max(r.s for r in got) > 200


def test_histogram_against_scan(spark):
    r = random.Random(3)
    values = [r.choice([0, 0.5, 9.99, 10, 11, r.random() * 10 ** r.randint(0, 11), -3.0]) for _ in range(400)]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    got = histogram.summary(histogram.histogram(df, "v"), percentiles=(0.0, 50.0, 95.0, 100.0)).first()
    counts = [0] * len(histogram.LIMITS)
    for v in values:
        counts[next((b for b, u in enumerate(histogram.LIMITS) if v < u))] += 1
    assert len(histogram.LIMITS) == 154 and got.n == 400 and got.lo == min(values) and got.hi == max(values)
    assert got.mean == pytest.approx(sum(values) / 400)
    for p in (50, 95, 100):
        need, seen = 400 * p / 100, 0
        for b, n in enumerate(counts):
            if n and seen + n >= need:
                left = histogram.LIMITS[b - 1] if b else 0
                want = left + (histogram.LIMITS[b] - left) * (need - seen) / n
                break
            seen += n
        assert got[f"p{p}"] == pytest.approx(min(max(want, min(values)), max(values)))


def test_routes_by_table(spark):
    from tidemark.operators import shards

    table = spark.createDataFrame([(7, b"a", b"c"), (8, b"c", b"d"), (9, b"x", b"y")], "shard_id long, lower binary, upper binary")
    df = spark.createDataFrame([(bytearray(k),) for k in (b"", b"a", b"bz", b"c", b"d", b"x", b"y")], "k binary")
    assert {bytes(r.k): r.shard_id for r in shards.route_by(df, "k", table).collect()} == {b"": None, b"a": 7, b"bz": 7, b"c": 8, b"d": None, b"x": 9, b"y": None}


def test_settled_files_are_read_without_a_shuffle(spark, store):
    log = spark.range(500).select(F.encode(F.format_string("k%04d", F.col("id") % 300), "UTF-8").alias("k"), (F.col("id") + 1).alias("seq"), F.when(F.col("id") % 7 == 0, 0).otherwise(1).cast("tinyint").alias("kind"), F.encode(F.col("id").cast("string"), "UTF-8").alias("v"))
    store.ingest(log, ranged=False)
    before = rows(store.scan())
    assert len(before) > 200
    store.compact()
    plan = lambda v: v.rows()._jdf.queryExecution().executedPlan().toString()
    assert rows(store.scan()) == before and "parquet" in plan(store.view()) and plan(store.view()).count("Scan parquet") == 1
    store.put(b"k0010", b"new")
    assert store.get(b"k0010") == b"new" and rows(store.scan()) == sorted({**dict(before), b"k0010": b"new"}.items())
    name = store.snapshot()
    store.delete(b"k0010")
    store.compact()
    assert store.get(b"k0010") is None and store.get(b"k0010", store.seq_of(name)) == b"new"
    f = lambda n, a, b: {"number": n, "smallest": a, "largest": b}
    assert [x["number"] for x in compaction.alone([f(1, "A", "C"), f(2, "B", "B"), f(3, "D", "E"), f(4, "E", "F"), f(5, "G", "G")])] == [5]
