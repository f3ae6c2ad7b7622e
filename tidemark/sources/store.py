"""A durable ordered store: sorted Parquet runs under a versioned manifest.

A commit writes new run files first, then one manifest under the next number, in a step that fails if that number exists.
A handle takes the new state over only then, so a lost executor or writer leaves both the store and the handle as they
were; a handle whose commit is refused reloads the store's state and raises ``Conflict``, and the caller may try again.
Any number of readers and writers may have the store open. The manifest is small (a row a file) and lives on the driver;
data work is DataFrame work.
"""

from __future__ import annotations

import copy
import json
import time
import uuid
from bisect import bisect_right
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import compaction
from tidemark.operators.collapse import history, retained, without_tombstones
from tidemark.operators.ranges import LEVELS
from tidemark.operators.scan import Cursor, View, cursor
from tidemark.sources.batch import BROKEN, OPLOG, WriteBatch, checked, validate
from tidemark.sources.errors import Conflict, Corruption, InvalidArgument, NotSupported

OUTSIDE = "a key lies in no shard"
FILES = "level int, number bigint, path string, size bigint, num_entries bigint, smallest binary, largest binary, min_seq bigint, max_seq bigint"


@dataclass
class Manifest:
    version: int = 0
    comparator: str = "bytewise"
    last_seq: int = 0
    next_file: int = 2
    files: list[dict] = field(default_factory=list)
    snapshots: dict[str, int] = field(default_factory=dict)
    #: The last batch of each stream, and ids of batches that aren't numbered.
    streams: dict[str, int] = field(default_factory=dict)
    batches: list[str] = field(default_factory=list)
    #: Per level: files, bytes read and written, and seconds of its compactions.
    compactions: dict[str, dict] = field(default_factory=dict)
    #: Per level: the largest key that a compaction took last.
    pointers: dict[str, str] = field(default_factory=dict)
    shards: list[list[str]] = field(default_factory=list)

    def add(self, rows: list[dict], level: int) -> None:
        for r in sorted(rows, key=lambda r: (r["smallest"], r["path"])):
            self.files.append({"level": level, "number": self.next_file, **r})
            self.next_file += 1
        self.last_seq = max([self.last_seq, *(r["max_seq"] for r in rows)])

    def seen(self, batch_id: str) -> bool:
        name, _, number = batch_id.rpartition("-")
        return self.streams.get(name, -1) >= int(number) if name and number.isdigit() else batch_id in self.batches

    def note(self, batch_id: str | None) -> None:
        name, _, number = (batch_id or "").rpartition("-")
        if name and number.isdigit():
            self.streams[name] = max(self.streams.get(name, -1), int(number))
        elif batch_id:
            self.batches.append(batch_id)


class OrderedStore:
    def __init__(self, spark: SparkSession, path: str, manifest: Manifest, normaliser=None) -> None:
        self.spark, self.path, self.state, self.normaliser = spark, path.rstrip("/"), manifest, normaliser

    # -- files

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    @classmethod
    def _versions(cls, spark: SparkSession, path: str) -> list[int]:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[9:-5]) for n in names if n.startswith("MANIFEST-") and n.endswith(".json"))

    @classmethod
    def open(cls, spark: SparkSession, path: str, create_if_missing: bool = True, error_if_exists: bool = False, comparator: str = "bytewise", normaliser=None, **more) -> OrderedStore:
        found = cls._versions(spark, path)
        if found and error_if_exists:
            raise InvalidArgument("the store exists")
        if not found:
            if not create_if_missing:
                raise InvalidArgument("no store here")
            store = cls(spark, path, Manifest(comparator=comparator, **more), normaliser)
            store._commit(lambda m: None)
            return store
        store = cls(spark, path, Manifest(), normaliser)
        store.reload()
        if store.state.comparator != comparator:
            raise InvalidArgument(f"comparator {comparator} does not match {store.state.comparator}")
        if more and any(getattr(store.state, k) != v for k, v in more.items()):
            raise InvalidArgument("the store was made with other options")
        return store

    def reload(self) -> None:
        """Take over the store's newest state."""
        self.state = self._read(self._versions(self.spark, self.path)[-1])

    def _read(self, version: int) -> Manifest:
        stream = self._fs().open(self._p(f"MANIFEST-{version:020d}.json"))
        try:
            raw = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return Manifest(**json.loads(raw))
        except (ValueError, TypeError) as e:
            raise Corruption(f"manifest: {e}") from e

    def _commit(self, change: Callable[[Manifest], None]) -> None:
        """Publish a changed copy of the state; it becomes the handle's own only if no other writer was first."""
        following = copy.deepcopy(self.state)
        following.version += 1
        change(following)
        if not self._publish(f"MANIFEST-{following.version:020d}.json", json.dumps(following.__dict__).encode()):
            self.reload()
            raise Conflict("another writer has committed; this handle now has its state, so try again")
        self.state = following

    def _publish(self, name: str, content: bytes) -> bool:
        """Whether a new file ``name`` came to be, whole and at once. A local file is linked, which fails if the name is
        taken; elsewhere the rename of Hadoop's ``FileContext`` does not overwrite; object stores, which have no rename,
        refuse a second object where it is created."""
        jvm, fs, final = self.spark._jvm, self._fs(), self._p(name)
        direct = fs.getScheme() in ("s3a", "s3", "gs", "abfs", "abfss", "wasb", "wasbs")
        temp = final if direct else self._p(f".manifest-{uuid.uuid4().hex}")
        try:
            out = fs.create(temp, False)
            out.write(bytearray(content))
            out.close()
            if direct:
                return True
            if fs.getScheme() == "file":
                real = lambda p: jvm.java.io.File(fs.makeQualified(p).toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(real(final), real(temp))
            else:
                none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(temp, final, none)
                return True
        except Exception as e:
            if "AlreadyExist" in str(e):
                if not direct:
                    fs.delete(temp, False)
                return False
            raise
        fs.delete(temp, False)
        return True

    @staticmethod
    def destroy(spark: SparkSession, path: str) -> None:
        """Delete a store; a folder that is missing is fine, one without a manifest is left alone."""
        if OrderedStore._versions(spark, path):
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    @classmethod
    def repair(cls, spark: SparkSession, path: str, comparator: str = "bytewise") -> OrderedStore:
        """Rebuild the manifest. Of the manifests that can be read, the newest gives snapshots, batches and shards, and all of
        them tell which run files a compaction has replaced; every other run file there is goes to level 0."""
        versions = cls._versions(spark, path)
        store = cls(spark, path, Manifest(version=max(versions, default=0), comparator=comparator))
        known: list[Manifest] = []
        for v in reversed(versions):
            try:
                known.append(store._read(v))
            except Corruption:
                continue
        if known:
            keep = {k: getattr(known[0], k) for k in ("comparator", "last_seq", "snapshots", "streams", "batches", "shards")}
            store.state = Manifest(version=max(versions), **keep)
        named = lambda p: tuple(p.rsplit("/", 2)[-2:])
        live = {named(f["path"]) for f in known[0].files} if known else set()
        replaced = {named(f["path"]) for m in known for f in m.files} - live
        rows = []
        if store._fs().exists(store._p("runs")):
            rows = [r for r in store._describe(spark.read.schema(OPLOG).option("recursiveFileLookup", "true").parquet(f"{store.path}/runs")) if named(r["path"]) not in replaced]
        store._commit(lambda m: m.add(rows, 0))
        return store

    # -- writes

    def _describe(self, runs: DataFrame) -> list[dict]:
        """A row a file, from the columns k and seq of what was written."""
        meta = runs.select("k", "seq", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
        found = meta.groupBy("path", "size").agg(F.count(F.lit(1)).alias("num_entries"), F.hex(F.min("k")).alias("smallest"), F.hex(F.max("k")).alias("largest"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))
        return [r.asDict() for r in found.collect()]

    def _write(self, oplog: DataFrame, ranged: bool = False) -> list[dict]:
        """Write run files; what they hold. Nothing refers to them before the commit that follows."""
        folder = f"{self.path}/runs/{uuid.uuid4().hex}"
        shaped = oplog.select("k", "seq", F.col("kind").cast("tinyint").alias("kind"), "v")
        if ranged:
            shaped = shaped.repartitionByRange("k")
        try:
            shaped.sortWithinPartitions("k", F.col("seq").desc()).write.option("parquet.bloom.filter.enabled#k", "true").parquet(folder)
        except PySparkException as e:
            if BROKEN in str(e):
                raise Corruption(BROKEN) from e
            raise
        return self._describe(self.spark.read.schema(OPLOG).parquet(folder))

    def write(self, batch: WriteBatch, strict: bool = False, retries: int = 0) -> None:
        """Commit a batch: its records get the next sequence numbers, in order. ``retries``: how often to try again after
        other writers' commits."""
        if not len(batch):
            return
        while True:
            rows = batch.oplog(self.spark, self.state.last_seq + 1).coalesce(1)
            found = self._write(validate(rows) if strict else rows)
            try:
                return self._commit(lambda m: m.add(found, 0))
            except Conflict:
                if not retries:
                    raise
                retries -= 1

    def put(self, key: bytes, value: bytes) -> None:
        self.write(WriteBatch().put(key, value))

    def delete(self, key: bytes) -> None:
        self.write(WriteBatch().delete(key))

    def ingest(self, oplog: DataFrame, batch_id: str | None = None, strict: bool = True, ranged: bool = True) -> bool:
        """Append rows that bring their own sequence numbers (bulk load, streams), range-partitioned by key; without
        ``ranged`` each task sorts and writes what it has: no shuffle, but files that overlap until they are compacted.

        A batch that was committed before is skipped, so a replayed micro-batch changes nothing. Batches of a stream are
        named ``name-number``, and the last number of each name is kept. Rows are checked while they are written."""
        if batch_id is not None and self.state.seen(batch_id):
            return False
        found = self._write(checked(oplog) if strict else oplog, ranged)
        if not found:
            return False

        def change(m: Manifest) -> None:
            m.add(found, 0)
            m.note(batch_id)

        self._commit(change)
        return True

    # -- reads

    def _live(self, lo: bytes | None = None, hi: bytes | None = None) -> list[dict]:
        return [f for f in self.state.files if self.normaliser or ((hi is None or f["smallest"] <= hi.hex().upper()) and (lo is None or f["largest"] >= lo.hex().upper()))]

    def _rows(self, files: list[dict]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], OPLOG)
        return self.spark.read.schema(OPLOG).parquet(*[f["path"] for f in files])

    def oplog(self, lo: bytes | None = None, hi: bytes | None = None) -> DataFrame:
        """All entries of the live files; files outside [lo, hi] are not opened."""
        return self._rows(self._live(lo, hi))

    def _view(self, files: list[dict], snapshot: int | None) -> View:
        """Files that hold one version a key, none after the snapshot, and that no other file overlaps, need no collapse."""
        seq = self.state.last_seq if snapshot is None else snapshot
        if self.normaliser is not None:
            return View(self._rows(files).withColumn("nk", self.normaliser(F.col("k"))), "nk", seq)
        alone = compaction.alone(files)
        settled = [f for f in alone if f.get("single") and f["max_seq"] <= seq]
        numbers = {f["number"] for f in settled}
        return View(self._rows([f for f in files if f["number"] not in numbers]), "k", seq, settled=self._rows(settled) if settled else None)

    def view(self, snapshot: int | None = None, lo: bytes | None = None, hi: bytes | None = None) -> View:
        """The state at a snapshot, now by default: later commits don't change it."""
        return self._view(self._live(lo, hi), snapshot)

    def get(self, key: bytes, snapshot: int | None = None) -> bytes | None:
        if self.normaliser is None:
            found = self.view(snapshot, key, key).get(F.lit(bytearray(key))).select("v").collect()
        else:
            probe = self.normaliser(F.lit(bytearray(key)))
            found = self.view(snapshot).rows(F.col("nk") == probe).select("v").collect()
        return bytes(found[0][0]) if found else None

    def scan(self, snapshot: int | None = None) -> DataFrame:
        return self.view(snapshot).scan().select("k", "v")

    def cursor(self, snapshot: int | None = None) -> Cursor:
        return cursor(self.view(snapshot))

    def history(self) -> DataFrame:
        return history(self.oplog(), "k")

    # -- snapshots

    def snapshot(self) -> str:
        """Pin the current state; handles are independent of each other."""
        name = uuid.uuid4().hex
        self._commit(lambda m: m.snapshots.update({name: m.last_seq}))
        return name

    def seq_of(self, snapshot: str) -> int:
        return self.state.snapshots[snapshot]

    def release(self, snapshot: str) -> None:
        self._commit(lambda m: m.snapshots.pop(snapshot))

    def oldest(self) -> int:
        return min(self.state.snapshots.values(), default=self.state.last_seq)

    # -- maintenance

    def files(self) -> DataFrame:
        rows = [(f["level"], f["number"], f["path"], f["size"], f["num_entries"], bytes.fromhex(f["smallest"]), bytes.fromhex(f["largest"]), f["min_seq"], f["max_seq"]) for f in self.state.files]
        return self.spark.createDataFrame(rows, FILES)

    def compact(self, lo: bytes | None = None, hi: bytes | None = None, level: int = 1) -> None:
        """Rewrite all files that meet [lo, hi], widened to a fixpoint, as disjoint sorted files of ``level``."""
        if self.normaliser is not None and (lo is not None or hi is not None):
            raise NotSupported("partial compaction under a normalising comparator")
        if not 1 <= level < LEVELS:
            raise InvalidArgument("level")
        hexed = lambda x: None if x is None else x.hex().upper()
        self._rewrite(compaction.closure(self.state.files, hexed(lo), hexed(hi)), level)

    def _rewrite(self, chosen: list[dict], level: int, deeper: list[dict] = (), pointer: tuple[int, str] | None = None) -> None:
        """Merge files into disjoint sorted ones of ``level``. Without ``deeper`` files the chosen ones hold every version of
        their keys, so tombstones that hide nothing go; else only such as lie in none of those files' ranges."""
        if not chosen:
            return
        began = time.monotonic()
        rows, key = self.spark.read.schema(OPLOG).parquet(*[f["path"] for f in chosen]), "k"
        if self.normaliser is not None:
            rows, key = rows.withColumn("nk", self.normaliser(F.col("k"))), "nk"
        limits = [(bytes.fromhex(f["smallest"]), bytes.fromhex(f["largest"])) for f in deeper]
        kept = without_tombstones(retained(rows, key, self.oldest()), self.oldest(), limits or None, key)
        found = self._write(kept, ranged=True)
        if not self.state.snapshots and self.normaliser is None:
            found = [{**f, "single": True} for f in found]  # only the newest version of each key is left
        gone = {f["number"] for f in chosen}

        def change(m: Manifest) -> None:
            m.files = [f for f in m.files if f["number"] not in gone]
            m.add(found, level)
            old = m.compactions.get(str(level), {"files": 0, "read": 0, "written": 0, "seconds": 0.0})
            m.compactions[str(level)] = {
                "files": old["files"] + len(chosen), "read": old["read"] + sum(f["size"] for f in chosen),
                "written": old["written"] + sum(f["size"] for f in found), "seconds": round(old["seconds"] + time.monotonic() - began, 3),
            }
            if pointer:
                m.pointers[str(pointer[0])] = pointer[1]

        self._commit(change)

    def compact_once(self, level_bytes: int = compaction.LEVEL_BYTES, l0_files: int = compaction.L0_FILES) -> dict | None:
        """One step of the policy: the level with the highest score of 1 or more, its next files in key order and all that
        they meet one level down are merged, or, where a trivial move will do, renamed. What was done; None if nothing is due."""
        if self.normaliser is not None:
            raise NotSupported("the compaction policy under a normalising comparator")
        job = compaction.pick(self.state.files, self.state.pointers, level_bytes, l0_files)
        if job is None:
            return None
        if job.trivial:
            self.move(job.inputs[0]["number"], job.level + 1)
        else:
            deeper = [f for f in self.state.files if f["level"] > job.level + 1]
            self._rewrite(job.inputs + job.below, job.level + 1, deeper, (job.level, max(f["largest"] for f in job.inputs)))
        return {"level": job.level, "inputs": [f["number"] for f in job.inputs], "below": [f["number"] for f in job.below], "trivial": job.trivial}

    def move(self, number: int, level: int) -> None:
        """Trivial move: only the manifest changes."""

        def change(m: Manifest) -> None:
            for f in m.files:
                if f["number"] == number:
                    f["level"] = level

        self._commit(change)

    def vacuum(self, older_than: float = 0.0, manifests: int = 100) -> int:
        """Delete run files that the store's newest manifest does not name, and all but the last manifests; the number of run
        files deleted. Give ``older_than`` (seconds) where writers are at work, whose files no manifest names yet."""
        self.reload()
        fs, gone = self._fs(), 0
        live = {tuple(f["path"].rsplit("/", 2)[-2:]) for f in self.state.files}
        for v in self._versions(self.spark, self.path)[:-manifests]:
            fs.delete(self._p(f"MANIFEST-{v:020d}.json"), False)
        if not fs.exists(self._p("runs")):
            return 0
        files = fs.listFiles(self._p("runs"), True)
        while files.hasNext():
            file = files.next()
            path = file.getPath()
            if path.getName().endswith(".parquet") and (path.getParent().getName(), path.getName()) not in live and file.getModificationTime() / 1000 <= time.time() - older_than:
                fs.delete(path, False)
                gone += 1
        return gone

    def property(self, name: str) -> str | None:
        """num-files-at-level<N>, stats (a line a level: files, bytes, then seconds, bytes read and bytes written of its
        compactions), sstables, approximate-memory-usage; None for unknown names."""
        files = self.state.files
        if name.startswith("num-files-at-level"):
            n = name.removeprefix("num-files-at-level")
            return str(sum(f["level"] == int(n) for f in files)) if n.isdigit() and int(n) < LEVELS else None
        if name == "stats":
            lines = []
            for n in range(LEVELS):
                did, own = self.state.compactions.get(str(n), {}), [f["size"] for f in files if f["level"] == n]
                lines.append(f"{n} {len(own)} {sum(own)} {did.get('seconds', 0)} {did.get('read', 0)} {did.get('written', 0)}")
            return "\n".join(lines)
        if name == "sstables":
            return "\n".join(f"level {f['level']} {f['number']}:{f['size']}[{f['smallest']} .. {f['largest']}]" for f in sorted(files, key=lambda f: (f["level"], f["number"])))
        if name == "approximate-memory-usage":
            return str(sum(f["size"] for f in files if f["level"] == 0))
        return None

    def approximate_sizes(self, ranges: Sequence[tuple[bytes, bytes]]) -> list[int]:
        """Bytes on disk of each range [start, limit): files that lie in it count whole, from the manifest; of files that it
        cuts, only keys are read, and the part of their rows that the range holds counts. 0 where the limit is not above."""
        hexed = [(a.hex().upper(), b.hex().upper()) for a, b in ranges]
        out, edges = [0.0] * len(hexed), {}
        for f in self.state.files:
            for i, (a, b) in enumerate(hexed):
                if a < b and a <= f["smallest"] and f["largest"] < b:
                    out[i] += f["size"]
                elif a < b and f["smallest"] < b and f["largest"] >= a:
                    edges.setdefault(f["path"], []).append(i)
        shares = {f["path"]: f["size"] / f["num_entries"] for f in self.state.files}
        cut = sorted({i for v in edges.values() for i in v})
        for at in range(0, len(cut), 200):  # a count a range: a bounded number of them a pass
            some = cut[at : at + 200]
            paths = [p for p, v in edges.items() if set(v) & set(some)]
            rows = self.spark.read.schema(OPLOG).parquet(*paths).select("k", F.col("_metadata.file_path").alias("path"))
            low, high = min(ranges[i][0] for i in some), max(ranges[i][1] for i in some)
            rows = rows.where((F.col("k") >= F.lit(bytearray(low))) & (F.col("k") < F.lit(bytearray(high))))
            inside = [F.count(F.when((F.col("k") >= F.lit(bytearray(ranges[i][0]))) & (F.col("k") < F.lit(bytearray(ranges[i][1]))), 1)).alias(f"n{i}") for i in some]
            for r in rows.groupBy("path").agg(*inside).collect():
                for i in some:
                    if i in edges[r.path]:
                        out[i] += r[f"n{i}"] * shares[r.path]
        return [int(x) for x in out]


class ShardedStore(OrderedStore):
    """A store whose keys belong to range shards [lower, upper). No run file holds keys of two shards, so reads, sizes and
    compactions of a shard touch its own files only. Rows are routed one by one; a batch is one commit over all shards, and
    snapshots and scans span them."""

    @classmethod
    def create(cls, spark: SparkSession, path: str, bounds: Sequence[tuple[bytes, bytes]]) -> ShardedStore:
        """Make or open a store with these shards, which must be in order and not overlap."""
        if not bounds or any(a >= b for a, b in bounds) or any(p[1] > q[0] for p, q in zip(bounds, bounds[1:])):
            raise InvalidArgument("shards")
        return cls.open(spark, path, shards=[[a.hex().upper(), b.hex().upper()] for a, b in bounds])

    def bounds(self, shard: int) -> tuple[bytes, bytes]:
        if not 0 <= shard < len(self.state.shards):
            raise InvalidArgument("no such shard")
        lower, upper = self.state.shards[shard]
        return bytes.fromhex(lower), bytes.fromhex(upper)

    def route(self, key: bytes) -> int:
        """The shard that holds a key."""
        at = bisect_right([lower for lower, _ in self.state.shards], key.hex().upper()) - 1
        if at < 0 or key.hex().upper() >= self.state.shards[at][1]:
            raise InvalidArgument("no shard holds this key")
        return at

    def _write(self, oplog: DataFrame, ranged: bool = False) -> list[dict]:
        edges = [self.bounds(i) for i in range(len(self.state.shards))]
        within = [(F.col("k") >= F.lit(bytearray(a))) & (F.col("k") < F.lit(bytearray(b))) for a, b in edges]
        shard = F.coalesce(*[F.when(w, F.lit(i)) for i, w in enumerate(within)], F.raise_error(F.lit(OUTSIDE)).cast("int"))
        folder = f"{self.path}/runs/{uuid.uuid4().hex}"
        shaped = oplog.select("k", "seq", F.col("kind").cast("tinyint").alias("kind"), "v", shard.alias("shard"))
        if ranged:
            shaped = shaped.repartitionByRange("shard", "k")
        try:
            shaped.sortWithinPartitions("shard", "k", F.col("seq").desc()).write.partitionBy("shard").option("parquet.bloom.filter.enabled#k", "true").parquet(folder)
        except PySparkException as e:
            for said, kind in ((OUTSIDE, InvalidArgument), (BROKEN, Corruption)):
                if said in str(e):
                    raise kind(said) from e
            raise
        return self._describe(self.spark.read.schema(OPLOG).option("recursiveFileLookup", "true").parquet(folder))

    def _of(self, shard: int) -> list[dict]:
        lower, upper = self.state.shards[shard]
        return [f for f in self.state.files if lower <= f["smallest"] < upper]

    def shard_view(self, shard: int, snapshot: int | None = None) -> View:
        """The state of one shard, from its own files."""
        return self._view(self._of(shard), snapshot)

    def scan_shard(self, shard: int, snapshot: int | None = None) -> DataFrame:
        return self.shard_view(shard, snapshot).scan().select("k", "v")

    def shard_cursor(self, shard: int, snapshot: int | None = None) -> Cursor:
        return cursor(self.shard_view(shard, snapshot))

    def shard_sizes(self) -> list[int]:
        """Bytes on disk of each shard, from the manifest alone."""
        return [sum(f["size"] for f in self._of(i)) for i in range(len(self.state.shards))]

    def compact_shard(self, shard: int, level: int = 1) -> None:
        self._rewrite(self._of(shard), level)
