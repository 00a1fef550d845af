import json

import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from annoframe.functions import vocabulary as V
from annoframe.operators import bins, lookup
from annoframe.sources import sidefiles, tables


def test_attribute_csv(spark, tmp_path):
    file = tmp_path / "age.csv"
    file.write_text("extra,segment_id,age,age_value\n1,s1,teens,0.97\n2,s2,None,0.5\n3,s3,,\n4,s4,N/A,NaN\n5,s5,\"a, b\",1\n")
    rows = [tuple(row) for row in sidefiles.read_attribute_csv(spark, str(file), "age").collect()]
    assert rows == [("s1", "teens", 0.97), ("s2", None, 0.5), ("s3", None, None), ("s4", None, None), ("s5", "a, b", 1.0)]


def test_attribute_csv_as_pandas_reads_it(spark, tmp_path):
    labels = ['a "b" c', 'say ""hi"", ok', "two\nlines", "comma, here", 'quote "', "back\\slash", " spaced ", "é", *V.CSV_MISSING]
    frame = pd.DataFrame({"age_value": [k / 4 for k in range(len(labels))], "age": labels, "segment_id": [f"s{k}" for k in range(len(labels))], "more": "x"})
    file = tmp_path / "age.csv"
    frame.to_csv(file, index=False)
    want = [(r.segment_id, None if pd.isna(r.age) else r.age, r.age_value) for r in pd.read_csv(file).itertuples()]
    for columns in (None, list(frame.columns)):
        rows = sidefiles.read_attribute_csv(spark, str(file), "age", multi_line=True, columns=columns).collect()
        assert sorted(map(tuple, rows)) == sorted(want)
    flat = tmp_path / "flat.csv"
    frame[~frame.age.str.contains("\n")].to_csv(flat, index=False)
    assert sidefiles.read_attribute_csv(spark, str(flat), "age").count() == len(labels) - 1
    with pytest.raises(Exception, match="header does not conform"):
        sidefiles.read_attribute_csv(spark, str(file), "age", multi_line=True, columns=["segment_id", "age", "age_value", "more"]).collect()


def test_prompt_parts(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"front": "Describe.\n", "examples": ["a\n", "b\n"]}, indent=2))
    parts = sidefiles.read_prompt_parts(spark, str(tmp_path / "p.json"))
    assert (parts.front, parts.examples, parts.end, parts.keys) == ("Describe.\n", ("a\n", "b\n"), V.PROMPT_END, V.PROMPT_KEYS)
    (tmp_path / "q.json").write_text(json.dumps({"front": "x", "examples": [], "end": "[age]", "keys": ["age"]}))
    parts = sidefiles.read_prompt_parts(spark, str(tmp_path / "q.json"))
    assert (parts.end, parts.keys) == ("[age]", ("age",))
    (tmp_path / "r.json").write_text("{}")
    with pytest.raises(ValueError, match="front and examples"):
        sidefiles.read_prompt_parts(spark, str(tmp_path / "r.json"))


def test_leading_splits_by_several_names(spark):
    df = spark.createDataFrame([("train.clean",), ("train.other",), ("dev",)], "split string")
    assert tables.leading_splits(df, ["clean", "dev"]).count() == 2
    assert tables.leading_splits(df, "train").count() == 2
    assert tables.leading_splits(df, None).count() == 3
    assert tables.leading_splits(df, []).count() == 0


def python_tags(text):
    """Last line wins; one field means no tag."""
    found = {}
    for line in text.splitlines():
        fields = line.strip().split("\t")
        found[fields[0]] = fields[1] if len(fields) > 1 else "None"
    return found


@pytest.mark.parametrize("block", ["128m", "300"])
def test_tag_lines(spark, tmp_path, block):
    lines = [f"id{i % 40}\ttag{i}\tthird" for i in range(200)]
    lines += ["  id1\tspaced \t", "id2", "", "id3\t", "id4\t\tx", "é\tMusic, Opera"]
    text = "\n".join(lines) + "\n"
    (tmp_path / "tags.txt").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        tags = sidefiles.read_tag_lines(spark, str(tmp_path / "tags.txt"))
        rows = lookup.last_tags(tags, "segment_id", "tag", "position").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {row["segment_id"]: row["tag"] for row in rows} == python_tags(text)


def test_edge_files(spark, tmp_path):
    df = spark.createDataFrame([(float(i), float(-i)) for i in range(50)], "speaking_rate_value double, snr double")
    edges = bins.fit_bin_edges(df, bins.DEFAULT_SPECS[:2])
    sidefiles.write_bin_edges(edges, str(tmp_path / "edges"))
    read = sidefiles.read_number_lists(spark, str(tmp_path / "edges"))
    assert set(read) == {"speaking_rate", "noise"}
    assert read["noise"] == edges.first()["noise"]
    fitted = bins.label_columns(df, bins.DEFAULT_SPECS[:2])
    applied = bins.label_columns(df, bins.DEFAULT_SPECS[:2], read)
    assert fitted.exceptAll(applied).isEmpty()


def test_settings_files(spark, tmp_path):
    (tmp_path / "edges.json").write_text(json.dumps(V.PUBLISHED_EDGES, indent=4))
    assert sidefiles.read_number_lists(spark, str(tmp_path / "edges.json")) == {
        name: [float(edge) for edge in edges] for name, edges in V.PUBLISHED_EDGES.items()
    }
    (tmp_path / "words.json").write_text(json.dumps({"snr_bins": ["lo", "hi"]}))
    assert sidefiles.read_word_lists(spark, str(tmp_path / "words.json")) == {"snr_bins": ["lo", "hi"]}


def test_id_file(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "segment_id string, n int")
    sidefiles.write_ids(df, str(tmp_path / "ids"))
    assert sorted(row["value"] for row in spark.read.text(str(tmp_path / "ids")).collect()) == ["a", "b"]


def test_save_and_shards(spark, tmp_path):
    df = spark.range(10).withColumn("si-sdr", F.lit(0.5))
    root = tmp_path / "out"
    tables.save_table(df.where("id < 4"), str(root / "part0_stage8"))
    tables.save_table(df.where("id >= 4"), str(root / "part1_stage8_done"))
    tables.save_table(df, str(root / "part1_stage7"))
    assert tables.read_shards(spark, str(root)).count() == 10
    with pytest.raises(AnalysisException, match="already exists"):
        tables.save_table(df, str(root / "part1_stage7"))
    tables.save_table(df.limit(3), str(root / "part1_stage7"), overwrite=True)
    assert tables.read_table(spark, str(root / "part1_stage7"), df.schema).count() == 3


def test_publish_and_read_a_split(spark):
    df = spark.createDataFrame([(1, "train"), (2, "train_b"), (3, "dev")], "id int, split string")
    tables.publish(df, "segments", "tiny", "split")
    assert tables.read_split(spark, "segments", "train", "tiny").count() == 1
    assert tables.read_split(spark, "segments", configuration="tiny").count() == 3
    assert tables.leading_splits(tables.read_split(spark, "segments", configuration="tiny"), "train").count() == 2
    plan = tables.read_split(spark, "segments", "dev", "tiny")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    tables.publish(df, "plain")
    assert tables.read_split(spark, "plain").count() == 3




def test_a_replaced_table_is_there_all_the_time(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.save_table(spark.range(5), path)
    broken = spark.range(9).withColumn("id", F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("half way")).cast("long")))
    for _ in range(2):
        with pytest.raises(Exception, match="half way"):
            tables.save_table(broken, path, overwrite=True)
        assert sorted(r["id"] for r in tables.read_table(spark, path).collect()) == list(range(5))
    reading = tables.read_table(spark, path)
    tables.save_table(reading.select((F.col("id") * 2).alias("id")), path, overwrite=True)  # made from the table itself
    assert sorted(r["id"] for r in tables.read_table(spark, path).collect()) == [0, 2, 4, 6, 8]
    reading = tables.read_table(spark, path)
    tables.save_table(spark.range(3).withColumn("part", F.col("id") % 2), path, overwrite=True, partition_by=("part",))
    assert reading.count() == 5  # whoever began with the snapshot before can end
    assert sorted(tuple(r) for r in tables.read_table(spark, path).select("id", "part").collect()) == [(0, 0), (1, 1), (2, 0)]
    tables.save_table(spark.range(1), path, overwrite=True)
    assert len(list((tmp_path / "t").glob("_snapshot-*"))) == 2 and tables.read_table(spark, path).count() == 1


def test_rows_are_counted_as_they_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.save_table(spark.range(100), path, expect=100)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("save", "save")
    with pytest.raises(ValueError, match="99 rows written, 100 expected"):
        tables.save_table(spark.range(100).where("id <> 7"), path, overwrite=True, expect=100)
    jobs = len(tracker.getJobIdsForGroup("save"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs == 1
    assert tables.read_table(spark, path).count() == 100
