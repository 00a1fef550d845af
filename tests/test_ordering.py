import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from annoframe.operators import ordering


@pytest.fixture(params=[(500_000, 1024), (40, 1024), (5, 4)])
def bucket_rows(request, monkeypatch):
    """One range; one level of ranges; three and more levels."""
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", request.param[0])
    monkeypatch.setattr(ordering, "FANOUT", request.param[1])


def test_index_by_number(spark, bucket_rows):
    keys = np.random.default_rng(1).permutation(3000) ** 2
    df = spark.createDataFrame([(int(k),) for k in keys], "k long").repartition(7)
    rows = ordering.row_index(df, ["k"]).collect()
    assert sorted((row["k"], row["row_index"]) for row in rows) == list(zip(sorted(int(k) for k in keys), range(3000)))


def test_index_by_text_and_by_two_columns(spark, bucket_rows):
    df = spark.range(2000).select(F.md5(F.col("id").cast("string")).alias("name"), (F.col("id") % 3).alias("g"))
    by_name = ordering.row_index(df, ["name"]).collect()
    assert [row["name"] for row in sorted(by_name, key=lambda row: row["row_index"])] == sorted(row["name"] for row in by_name)
    by_both = ordering.row_index(df, ["g", "name"]).collect()
    assert [(row["g"], row["name"]) for row in sorted(by_both, key=lambda row: row["row_index"])] == sorted(
        (row["g"], row["name"]) for row in by_both
    )
    assert sorted(row["row_index"] for row in by_both) == list(range(2000))


def test_ranges_are_even(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 500)
    df = spark.range(20000).select((F.col("id") * F.col("id")).alias("k"))
    cuts = ordering.range_cuts(df, F.col("k"), 20000)
    sizes = [row["count"] for row in df.groupBy(ordering.range_of(F.col("k"), cuts).alias("r")).count().collect()]
    assert len(sizes) == 40
    assert max(sizes) < 1200


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_a_tree_of_three_levels(spark, monkeypatch, broadcast):
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 5)
    monkeypatch.setattr(ordering, "FANOUT", 4)
    monkeypatch.setattr(ordering, "BROADCAST_CUTS", broadcast)
    df = spark.range(300).select((F.col("id") * F.col("id")).alias("k"))
    placed, path = ordering.in_ranges(df, F.col("k"), 300)
    assert path == ["__range0", "__range1", "__range2"]
    rows = sorted((row["k"], *(row[c] for c in path)) for row in placed.collect())
    assert [r[0] for r in rows] == [k * k for k in range(300)]
    assert [r[1:] for r in rows] == sorted(r[1:] for r in rows)  # leaves follow the keys
    sizes = {}
    for r in rows:
        sizes[r[1:]] = sizes.get(r[1:], 0) + 1
    assert max(sizes.values()) <= 25 and len(sizes) >= 30
    below, want = {tuple(row[c] for c in path): row["__below"] for row in ordering.rows_below(placed, [], path).collect()}, 0
    for leaf in sorted(sizes):
        assert below[leaf] == want
        want += sizes[leaf]


def test_sequential_ids(spark, bucket_rows):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "segment_id string")
    rows = {row["segment_id"]: row["speaker"] for row in ordering.sequential_ids(df, ["segment_id"]).collect()}
    assert rows == {"a": "TmpSpeaker_1", "b": "TmpSpeaker_2", "c": "TmpSpeaker_3"}


@pytest.mark.parametrize("count", [0, 3, 5, 23, 100])
def test_shards(spark, count, bucket_rows):
    rows = ordering.contiguous_shards(spark.range(count), ["id"]).collect()
    size = count // 5
    expected = {i: min(i // size, 4) if size else 4 for i in range(count)}
    assert {row["id"]: row["shard"] for row in rows} == expected


def test_shards_per_split(spark, bucket_rows):
    df = spark.range(230).select("id", F.when(F.col("id") % 10 == 0, "dev").otherwise("train").alias("split"))
    df = df.unionAll(spark.createDataFrame([(1000, None), (1001, None)], "id long, split string"))
    rows = ordering.contiguous_shards(df, ["id"], 5, "split").collect()
    assert len(rows) == 232
    for split, count in (("dev", 23), ("train", 207), (None, 2)):
        own = [row["shard"] for row in sorted(rows, key=lambda row: row["id"]) if row["split"] == split]
        size = count // 5
        assert own == [min(i // size, 4) if size else 4 for i in range(count)]


def test_union_matches_columns_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "id int, t string")
    b = spark.createDataFrame([("y", 2, 0.5)], "t string, id int, s double")
    rows = {tuple(row) for row in ordering.union_shards([a, b]).select("id", "t", "s").collect()}
    assert rows == {(1, "x", None), (2, "y", 0.5)}


def test_a_repeated_key_is_an_error(spark, bucket_rows):
    df = spark.range(100).select((F.col("id") % 99).alias("k"), F.floor(F.col("id") / 99).cast("string").alias("split"))
    with pytest.raises(PySparkException, match="k does not identify a row"):
        ordering.row_index(df, ["k"]).collect()
    assert ordering.row_index(df, ["k"], within="split").count() == 100


def test_the_data_is_shuffled_once(spark, bucket_rows):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        df = spark.range(1000).select("id", F.md5(F.col("id").cast("string")).alias("wide"), (F.col("id") % 2).alias("split"))
        plan = ordering.row_index(df, ["id"], within="split")._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    lines = plan.splitlines()
    assert sum("Exchange" in line and "wide#" in below for line, below in zip(lines, lines[1:], strict=False)) == 1
