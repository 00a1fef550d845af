"""What the plans must look like at scale."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from annoframe.catalog import QUERIES
from annoframe.catalog.registry import Tables
from annoframe.operators import lookup


def plan(spark, name, tables):
    return QUERIES[name](spark, tables)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_window_without_partition(name, spark, tables):
    text = plan(spark, name, tables)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    for line in text.splitlines():
        if "Window [" in line and "__rows" not in line:
            assert "windowspecdefinition(" in line and "windowspecdefinition(ROWS" not in line


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("apply_fixed_bins", "l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_extendedprice:double"),
        ("fit_bin_edges", "value:double"),
        ("drop_columns", "o_orderkey:bigint,o_custkey:bigint,o_totalprice:double,o_orderpriority:string"),
        ("filter_by_label", "o_orderkey:bigint,o_orderpriority:string"),
        ("stem_mixdown", "l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int,l_quantity:double"),
    ],
)
def test_scans_read_only_what_is_needed(name, columns, spark, tables):
    assert f"ReadSchema: struct<{columns}>" in plan(spark, name, tables)


def test_filters_reach_the_scan(spark, tables):
    assert "EqualTo(lang,fr)" in plan(spark, "load_split", tables)
    assert "In(o_orderpriority" in plan(spark, "filter_by_label", tables)


@pytest.mark.parametrize(
    ("name", "shuffles"),
    [
        ("apply_fixed_bins", 0), ("strip_tokens", 0), ("build_prompt", 0), ("variant_fanout", 0), ("frame_mean_std", 0),
        ("map_batches_scorer", 0), ("stem_mixdown", 2), ("frame_mean_std_long", 1), ("lexicon_transcribe", 1),
    ],
)
def test_number_of_data_shuffles(name, shuffles, spark, tables):
    main = plan(spark, name, tables).split("Subquery")[0]
    exchanges = [line for line in main.splitlines() if "Exchange hashpartitioning" in line]
    small = 1 if name == "lexicon_transcribe" else 0  # the lexicon's own aggregation
    assert len(exchanges) - small == shuffles


def scans(text, table):
    """Reads of a table in a whole plan, subqueries included; a reused exchange is listed once."""
    return sum("FileScan parquet" in line and f"/{table}.parquet" in line for line in text.splitlines())


@pytest.mark.parametrize(
    ("name", "table", "times"),
    [("masked_frame_mean", "lineitem", 1), ("tag_lookup_last_wins", "customer", 1), ("interpolate_unvoiced", "events", 2)],
)
def test_number_of_scans(name, table, times, spark, tables):
    assert scans(plan(spark, name, tables), table) == times


def test_strict_sides_have_one_check(spark):
    ids = spark.range(10).select(F.col("id").alias("segment_id"))
    sides = {name: ids.select("segment_id", F.lit("x").alias(name), F.lit(1.0).alias(f"{name}_value")) for name in ("a", "b", "c", "d")}
    text = lookup.annotate(ids, sides, strict=True)._jdf.queryExecution().executedPlan().toString()
    # One digest of all sides, and one comparison of keys that it lets through.
    assert len(set(re.findall(r"Subquery subquery#(\d+)", text))) == 2


def test_describe_starts_no_job_and_writes_nothing(spark, tables, tmp_path):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("describe", "plan")
    folder = spark.conf.get("spark.checkpoint.dir")
    before = sorted(Path(folder.removeprefix("file:")).glob("*"))
    # Reading a table's schema is a job of its own; it comes before.
    given = Tables(spark, tables)
    read = [given.orders, given.lineitem]
    jobs = len(tracker.getJobIdsForGroup("describe"))
    described = QUERIES["describe_stage"](spark, tables)
    assert len(tracker.getJobIdsForGroup("describe")) <= jobs + len(read)
    assert sorted(Path(folder.removeprefix("file:")).glob("*")) == before
    assert all("/orders.parquet" in file or "/lineitem.parquet" in file for file in described.inputFiles())
    spark.sparkContext.setJobGroup("", "")
