import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from annoframe.operators import lookup


def side(spark, name, rows):
    return spark.createDataFrame(rows, f"segment_id string, {name} string, {name}_value double")


@pytest.fixture
def segments(spark):
    return spark.createDataFrame([(f"s{i}", i) for i in range(5)], "segment_id string, n int")


def test_annotate(spark, segments):
    sides = {
        "age": side(spark, "age", [("s0", "teens", 0.95), ("s1", "adult", 0.951), ("s3", None, 0.99), ("zz", "x", 1.0)]),
        "gender": side(spark, "gender", [("s0", "male", 1.0), ("s2", "female", float("nan"))]),
    }
    rows = {row["segment_id"]: row.asDict() for row in lookup.annotate(segments, sides).collect()}
    assert len(rows) == 5
    assert (rows["s0"]["age_ori"], rows["s0"]["age_value"], rows["s0"]["age"]) == ("teens", 0.95, "None")
    assert (rows["s1"]["age_ori"], rows["s1"]["age"]) == ("adult", "adult")
    assert (rows["s3"]["age_ori"], rows["s3"]["age_value"], rows["s3"]["age"]) == ("None", 0.99, "None")
    assert (rows["s4"]["age_ori"], rows["s4"]["age_value"], rows["s4"]["age"]) == ("None", 0.0, "None")
    assert (rows["s2"]["gender_ori"], rows["s2"]["gender_value"], rows["s2"]["gender"]) == ("female", 0.0, "None")
    assert rows["s0"]["gender"] == "male"


def test_annotate_rejects_duplicates(spark, segments):
    sides = {"age": side(spark, "age", [("s0", "teens", 1.0), ("s0", "adult", 1.0)])}
    with pytest.raises(PySparkException, match="more than one side row for id s0"):
        lookup.annotate(segments, sides).collect()


def test_strict_annotate_needs_full_cover(spark, segments):
    full = [(f"s{i}", "x", 1.0) for i in range(5)]
    assert lookup.annotate(segments, {"age": side(spark, "age", full)}, strict=True).count() == 5
    for wrong in (full[1:], [*full, ("s9", "x", 1.0)]):
        with pytest.raises(PySparkException, match="ids that do not match: 1"):
            lookup.annotate(segments, {"age": side(spark, "age", wrong), "sex": side(spark, "sex", full)}, strict=True).collect()


def test_no_row_without_an_id_is_lost_silently(spark, segments):
    nameless = segments.unionAll(spark.createDataFrame([(None, 9)], segments.schema))
    full = [(f"s{i}", "x", 1.0) for i in range(5)] + [(None, "x", 1.0)]
    with pytest.raises(PySparkException, match="ids that do not match: 1"):
        lookup.annotate(nameless, {"age": side(spark, "age", full)}, strict=True).collect()
    assert lookup.annotate(nameless, {"age": side(spark, "age", full[:5])}).count() == 6
    right = nameless.select("segment_id", F.lit(1).alias("y"))
    with pytest.raises(PySparkException, match="merge: ids that do not match: 1"):
        lookup.merge_verified(nameless, right, "segment_id").collect()
    with pytest.raises(PySparkException, match="no row for id NULL"):
        lookup.combine_branches(nameless, [right]).collect()


def test_merge(spark):
    left = spark.createDataFrame([("train", 1, "a"), ("train", 2, "b"), ("dev", 1, "c")], "split string, id int, x string")
    right = spark.createDataFrame([("dev", 1, 9, 0), ("train", 2, 8, 0), ("train", 1, 7, 0)], "split string, id int, y int, z int")
    merged = lookup.merge_verified(left, right, split="split", drop="z")
    assert merged.columns == ["split", "id", "x", "y", "metadata_id"]
    assert {(r["split"], r["id"], r["x"], r["y"], r["metadata_id"]) for r in merged.collect()} == {
        ("train", 1, "a", 7, 1), ("train", 2, "b", 8, 2), ("dev", 1, "c", 9, 1),
    }
    with pytest.raises(ValueError, match="both tables have the columns"):
        lookup.merge_verified(left, right.withColumnRenamed("y", "x"), split="split")
    wrong = {
        "missing split": right.where("split = 'train'"),
        "other id": right.withColumn("id", F.col("id") + 1),
        "duplicate": right.unionAll(right.where("split = 'dev'")),
    }
    for case in wrong.values():
        with pytest.raises(PySparkException, match="merge: ids that do not match"):
            lookup.merge_verified(left, case, split="split").collect()


def test_ids_that_both_sides_repeat_are_found(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, x string")
    right = spark.createDataFrame([(2, 7), (1, 8), (1, 9)], "id int, y int")
    with pytest.raises(PySparkException, match="merge: more than one row for id 1"):
        lookup.merge_verified(left, right).collect()
    swapped = spark.createDataFrame([(2, 7), (2, 8), (1, 9)], "id int, y int")
    with pytest.raises(PySparkException, match="merge: ids that do not match: 2"):
        lookup.merge_verified(left, swapped).collect()


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_keys_are_compared_only_where_digests_differ(spark, kind):
    ids = spark.range(5000).select(F.expr(f"cast(id - 2500 AS {kind})").alias("k"), (F.col("id") % 7).alias("m"))
    cases = {
        "same": (ids.orderBy("m"), False),
        "twice": (ids.unionAll(ids.limit(1)), True),
        "one for another": (ids.withColumn("k", F.when(F.col("k") == "7", F.lit("8").cast(kind)).otherwise(F.col("k"))), True),
        "no key": (ids.withColumn("k", F.when(F.col("k") != "7", F.col("k"))), True),
        "none": (ids.limit(0), True),
    }
    for name, (other, differs) in cases.items():
        both = ids.select("k", "m", F.lit(1).alias("w")).unionAll(other.select("k", "m", F.lit(-1).alias("w")))
        rows = lookup.where_digests_differ(both, ["k", "m"], [F.col("w")]).count()
        assert (rows > 0) == differs, name
        assert rows in (0, both.count()), name


def test_digests_are_the_same_in_any_order_and_partitioning(spark):
    ids = spark.range(3000).select((F.col("id") * 977 % 3000).alias("k"))
    found = {tuple(df.agg(*lookup.key_digest(["k"])).first()) for df in (ids, ids.repartition(5), ids.orderBy("k"), ids.coalesce(1))}
    assert len(found) == 1 and found.pop()[0] == 3000


def test_lookup_join_with_hot_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(lookup, "TARGET_ROWS", 300)
    keys = F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") % 500)
    left = spark.range(20000).select("id", keys.alias("k"))
    right = spark.range(450).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    for how in ("left", "inner"):
        split = lookup.lookup_join(left, right, ["k"], how, ["id"])
        plain = left.join(right, "k", how)
        assert split.columns == plain.columns
        assert split.exceptAll(plain).isEmpty()
        assert plain.exceptAll(split).isEmpty()


@pytest.mark.parametrize("rows", [8000, 32000])
@pytest.mark.parametrize("case", ["one hot key", "many warm keys", "half without a key"])
def test_a_slice_has_the_target_size_whatever_the_table(spark, monkeypatch, rows, case):
    monkeypatch.setattr(lookup, "TARGET_ROWS", 500)
    key = {
        "one hot key": F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")),
        "many warm keys": F.col("id") % 10,
        "half without a key": F.when(F.col("id") % 2 == 0, F.col("id")),
    }[case]
    left = spark.range(rows).select("id", key.alias("k"))
    right = spark.range(rows).select(F.col("id").alias("k"), F.lit("x").alias("w"))
    sliced = lookup.sliced_join(left, right, ["k"], "left", lookup.key_counts(left, ["k"]), ["id"])
    assert sliced.exceptAll(left.join(right, "k", "left")).isEmpty() and sliced.count() == rows
    # The same dealing, looked at before the join.
    counts = {row["k"]: row["rows"] for row in lookup.key_counts(left, ["k"]).collect()}
    slices = {k: -(-n // 500) if n > 500 else 1 for k, n in counts.items()}
    deal = F.create_map(*[x for k, n in slices.items() if n > 1 for x in (F.lit(-1 if k is None else k), F.lit(n))]) if any(n > 1 for n in slices.values()) else None
    own = F.lit(1) if deal is None else F.coalesce(F.try_element_at(deal, F.coalesce("k", F.lit(-1))), F.lit(1))
    sizes = left.groupBy("k", F.pmod(F.xxhash64("id"), own)).count().agg(F.max("count")).first()[0]
    assert sizes <= 1.35 * 500


def test_a_hot_key_does_not_end_in_one_partition(spark, monkeypatch):
    monkeypatch.setattr(lookup, "TARGET_ROWS", 200)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    left = spark.range(40000).select("id", F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("k"))
    left = left.withColumn("k", F.when(F.col("id") % 5 != 1, F.col("k")))
    right = spark.range(40000).select(F.col("id").alias("k"), F.lit("x").alias("w"))
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        joined = lookup.lookup_join(left, right, ["k"], "left", ["id"])
        assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
        sizes = [row["count"] for row in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(sizes) == 40000
    assert len(sizes) == 8
    assert max(sizes) < 1.3 * 40000 / 8


def test_a_key_cannot_be_spread_by_itself(spark):
    keys = spark.range(10).select((F.col("id") % 3).alias("k"))
    right = spark.createDataFrame([(0, "x")], "k long, w string")
    assert lookup.lookup_join(keys, right, ["k"]).where("w = 'x'").count() == 4
    with pytest.raises(ValueError, match="spread by itself"):
        lookup.sliced_join(keys, right, ["k"], "left", lookup.key_counts(keys, ["k"]), ["k"])


def test_small_side_is_broadcast_and_large_side_is_not(spark, monkeypatch):
    left = spark.range(100).select("id", (F.col("id") % 9).cast("string").alias("k"))
    right = spark.range(5).select(F.col("id").cast("string").alias("k"), F.lit("x").alias("w"))
    small = lookup.small_or_lookup_join(left, right, ["k"], ["id"]).orderBy("id").collect()
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 10)
    large = lookup.small_or_lookup_join(left, right, ["k"], ["id"]).orderBy("id").collect()
    assert small == large


def test_last_tag_wins(spark, segments):
    tags = spark.createDataFrame([("s1", "old", 1), ("s1", "new", 5), ("s1", "mid", 3), ("q", "z", 1)], "segment_id string, tag string, position int")
    rows = {row["segment_id"]: row["background"] for row in lookup.add_tag(segments, tags).collect()}
    assert rows == {"s0": "None", "s1": "new", "s2": "None", "s3": "None", "s4": "None"}


def test_unfinished_is_idempotent(spark, segments):
    done = segments.where("n < 2").select("segment_id")
    rest = lookup.unfinished(segments, done)
    assert {row["segment_id"] for row in rest.collect()} == {"s2", "s3", "s4"}
    assert lookup.unfinished(rest, done.unionAll(rest.select("segment_id"))).isEmpty()


def test_combine_branches(spark, segments):
    a = segments.select("segment_id", (F.col("n") * 2).alias("a"))
    b = segments.select("segment_id", (F.col("n") * 3).alias("b"))
    rows = lookup.combine_branches(segments, [a, b]).collect()
    assert all(row["a"] == 2 * row["n"] and row["b"] == 3 * row["n"] for row in rows)
    assert len(rows) == 5


def test_combine_branches_needs_every_row_once(spark, segments):
    branch = segments.select("segment_id", (F.col("n") * 2).alias("a"))
    with pytest.raises(PySparkException, match="branch 1: no row for id s4"):
        lookup.combine_branches(segments, [branch.where("a < 8")]).collect()
    with pytest.raises(PySparkException, match="branch 2: more than one row for id s1"):
        lookup.combine_branches(segments, [branch, branch.where("a = 2").unionAll(branch).withColumnRenamed("a", "b")]).collect()


def test_branches_keep_missing_values_and_names(spark, segments):
    a = segments.select("segment_id", *[F.when(F.col("n") != 3, value).alias(name) for name, value in (("a", F.when(F.col("n") > 1, F.col("n"))), ("t", F.lit("x")))])
    b = segments.select(F.array(F.col("n")).alias("b"), "segment_id")
    rows = {row["segment_id"]: (row["n"], row["a"], row["t"], row["b"]) for row in lookup.combine_branches(segments, [a, b]).collect()}
    assert rows["s0"] == (0, None, "x", [0]) and rows["s3"] == (3, None, None, [3]) and rows["s4"] == (4, 4, "x", [4])
    assert lookup.combine_branches(segments, []).count() == 5
    with pytest.raises(ValueError, match="share the columns"):
        lookup.combine_branches(segments, [a, a])
    # A key that the base table lacks is not of interest, unless it stands twice.
    more = b.unionAll(b.limit(1).withColumn("segment_id", F.lit("zz")))
    assert lookup.combine_branches(segments, [a, more]).count() == 5
