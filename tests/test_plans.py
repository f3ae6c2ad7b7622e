"""Plans: no single partition for the key space, no nested-loop join against data, filters in the scan."""

import pytest

from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["scan_all", "scan_reverse", "seek_random", "seek_ordered", "seek_skips_tombstone", "tombstone_partial", "tombstone_elimination", "gc_retained", "collapse_by_maxby", "multi_get", "shard_balance", "range_sizes_by_prefix_sums", "overwrite_latest", "merge_of_runs"])
def test_no_single_partition(spark, name):
    got = plan(catalog.queries()[name](spark, SF))
    assert "SinglePartition" not in got and "NestedLoop" not in got and "CartesianProduct" not in got


@pytest.mark.parametrize(("name", "found"), [("scan_range_half_open", "GreaterThanOrEqual(user_id,20), LessThan(user_id,60)"), ("scan_prefix", "GreaterThanOrEqual(o_orderkey"), ("get_latest", "EqualTo(user_id,42)"), ("read_random_shard", "GreaterThanOrEqual(o_orderkey")])
def test_filters_reach_the_scan(spark, name, found):
    assert found in plan(catalog.queries()[name](spark, SF))


def test_scan_collapses_once(spark):
    got = plan(catalog.queries()["scan_all"](spark, SF))
    assert got.count("InMemoryRelation") == 1 and "Window" not in got


def test_checksum_is_made_once(spark):
    """One fold for the checksum, that its masked form reads, and two for the hash."""
    assert plan(catalog.queries()["checksums"](spark, SF)).count("aggregate(") == 3


def test_every_query_but_one_has_sql():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"checksums"}
