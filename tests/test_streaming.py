from pathlib import Path

from annoframe.operators import speakers
from annoframe.streaming import speakers as streamed

SCHEMA = "speaker string, gender string, pitch double, at int"


def shard(spark, folder, number, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/shard-{number}")


def rows_of(number):
    """Speakers that come back in later shards, a category that is known late, no speaker, no value."""
    out = [(f"s{k % 7}", None if number == 0 and k % 7 == 3 else ("male", "female")[k % 2 if k % 7 else 0], 100.0 + (k * 37 + number * 11) % 90, 100 * number + k) for k in range(40)]
    return [*out, (None, "male", 5.0, 0), ("s1", None, None, 1), ("s2", "female", float("nan"), 2), (f"only{number}", None, 80.0 + number, 3)]


def run(spark, folder, per_batch=1):
    source = spark.read.schema(SCHEMA).parquet(f"{folder}/in/shard-0").schema
    streamed.update_speakers(spark, f"{folder}/in/*", source, f"{folder}/out", f"{folder}/state", "speaker", "gender", "pitch", "at", per_batch).awaitTermination()
    return table(streamed.current_speakers(spark, f"{folder}/out"))


def table(df):
    return {r["speaker"]: tuple(round(x, 6) if isinstance(x, float) else x for x in (r["mean"], r["category"], r["rows"], r["values"], r["total"], r["squares"], r["low"], r["high"])) for r in df.collect()}


def batch(spark, folder):
    return streamed.speaker_moments(spark.read.schema(SCHEMA).parquet(f"{folder}/in/*"), "speaker", "gender", "pitch", "at")


def test_shards_one_after_another_give_the_table_of_the_batch(spark, tmp_path):
    for number in range(3):
        shard(spark, f"{tmp_path}/in", number, rows_of(number))
    assert run(spark, tmp_path) == table(batch(spark, tmp_path))
    assert len(list(tmp_path.glob("out/batch=*"))) == 3
    # The statistics that edges are fitted on are those of the operator.
    plain = speakers.speaker_table(spark.read.schema(SCHEMA).parquet(f"{tmp_path}/in/*"), "speaker", "gender", "pitch", "at")
    want = {r["speaker"]: (r["category"], r["rows"]) for r in plain.collect()}
    assert {k: (v[1], v[2]) for k, v in table(streamed.current_speakers(spark, f"{tmp_path}/out")).items()} == want
    # A new shard is taken in without the old ones; without a new one nothing happens.
    shard(spark, f"{tmp_path}/in", 3, rows_of(3))
    assert run(spark, tmp_path) == table(batch(spark, tmp_path))
    assert run(spark, tmp_path) == table(batch(spark, tmp_path))


def test_a_batch_that_was_not_committed_is_neither_lost_nor_repeated(spark, tmp_path):
    for number in range(3):
        shard(spark, f"{tmp_path}/in", number, rows_of(number))
    run(spark, tmp_path)
    # As if the driver had died after the rows of the last batch were written and before it was committed.
    last = max(Path(f"{tmp_path}/state/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    last.with_name(f".{last.name}.crc").unlink(missing_ok=True)
    shard(spark, f"{tmp_path}/in", 3, rows_of(3))
    assert run(spark, tmp_path) == table(batch(spark, tmp_path))
