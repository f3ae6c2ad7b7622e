"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], and throughputs of the store; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

NAMES = ["scan_all", "collapse_by_maxby", "collapse_by_window", "overwrite_latest", "history_all", "gc_retained", "tombstone_elimination", "multi_get", "read_random", "seek_random", "scan_range_half_open", "delete_seq", "read_write_mix", "approximate_sizes", "shard_route"]
#: Entries of the store, and keys of a batched get.
ROWS, GETS = int(os.environ.get("BENCH_ROWS", 50_000_000)), 1_000_000


def timed(f) -> float:
    began = time.perf_counter()
    f()
    return time.perf_counter() - began


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def rates(spark: SparkSession, folder: str) -> dict[str, float]:
    """Operations a second through the store: 20-byte keys in random order, 16-byte values."""
    from tidemark.functions.keys import be64_key
    from tidemark.sources.store import OrderedStore

    n = F.col("id")
    # an odd multiplier modulo a power of two visits every number once, in a scattered order
    slots = 1 << (ROWS - 1).bit_length()
    key = lambda i: be64_key(F.pmod(i * 1_000_003, F.lit(slots)))
    log = spark.range(ROWS).select(key(n).alias("k"), (n + 1).alias("seq"), F.lit(1).cast("tinyint").alias("kind"), F.unhex(F.lpad(F.hex(n), 32, "0")).alias("v"))
    out = {"rows": ROWS}
    loose = OrderedStore.open(spark, f"{folder}/loose")
    out["bulk_append_rows_per_sec"] = ROWS / timed(lambda: loose.ingest(log, ranged=False))
    OrderedStore.destroy(spark, loose.path)
    store = OrderedStore.open(spark, f"{folder}/store")
    out["ranged_append_rows_per_sec"] = ROWS / timed(lambda: store.ingest(log))
    out["scan_rows_per_sec"] = ROWS / timed(lambda: noop(store.oplog().select("k", "v")))
    out["collapsed_view_rows_per_sec"] = ROWS / timed(lambda: noop(store.view().rows()))
    out["compaction_rows_per_sec"] = ROWS / timed(store.compact)
    out["compacted_view_rows_per_sec"] = ROWS / timed(lambda: noop(store.view().rows()))
    probes = spark.range(GETS).select(key(F.pmod(n * 48271, F.lit(ROWS))).alias("k"))
    out["multi_get_keys_per_sec"] = GETS / timed(lambda: noop(store.view().multi_get(probes)))
    one = bytes(store.oplog().select("k").first()[0])
    out["single_get_seconds"] = timed(lambda: store.get(one))
    return {k: round(v, 4) if v < 100 else round(v) for k, v in out.items()}


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="tidemark-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.checkpoint.dir", folder).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tidemark.plans import catalog

    found, took = catalog.queries(), {}
    for name in NAMES:
        for _ in range(2):  # compiled code and file listings are warm the second time; nothing that a query keeps is
            took[name] = round(timed(lambda n=name: noop(found[n](spark, sf_dir))), 4)
            spark.catalog.clearCache()
    spark.conf.set("spark.sql.shuffle.partitions", str(8 * int(cpus)))
    through = rates(spark, folder)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "rates": through, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()
    shutil.rmtree(folder, ignore_errors=True)


if __name__ == "__main__":
    main()
