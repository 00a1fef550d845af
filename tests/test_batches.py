import pandas as pd
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from annoframe.operators import batches

SCHEMA = StructType().add("id", "long").add("size", "long").add("loaded", "string")


def factory():
    def load():
        import uuid

        token = uuid.uuid4().hex

        def apply(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"id": frame["id"], "size": len(frame), "loaded": token})

        return apply

    return load


LOADED = StructType().add("id", "long").add("model", "string").add("process", "long").add("closed", "string")


def counting(label, log):
    """A model that tells its process, and writes down when it is loaded and closed."""

    def load():
        import os
        import uuid

        token = f"{label}-{uuid.uuid4().hex}"

        def note(what):
            with open(f"{log}/{what}-{token}", "x") as out:
                out.write(str(os.getpid()))

        class Model:
            def __call__(self, frame):
                return pd.DataFrame({"id": frame["id"], "model": token, "process": os.getpid(), "closed": ""})

            def close(self):
                note("closed")

        note("loaded")
        return Model()

    return load


def test_batches_have_the_given_size(spark):
    df = spark.range(0, 1000, 1, 4)
    rows = batches.map_batches(df, factory(), SCHEMA, ["id"], batch_size=64).collect()
    assert sorted(row["id"] for row in rows) == list(range(1000))
    assert max(row["size"] for row in rows) == 64


def test_a_model_is_loaded_once_a_process(spark, tmp_path):
    load = counting("kept", tmp_path)
    seen = set()
    for _ in range(2):  # the second query finds the models of the first
        rows = batches.map_batches(spark.range(0, 2000, 1, 20), load, LOADED, ["id"]).collect()
        assert sorted(row["id"] for row in rows) == list(range(2000))
        seen |= {(row["process"], row["model"]) for row in rows}
    assert len({process for process, _ in seen}) == len(seen) < 20
    assert len(list(tmp_path.glob("loaded-*"))) == len(seen) and not list(tmp_path.glob("closed-*"))


def test_models_that_a_worker_gives_up_are_closed(spark, tmp_path):
    one = spark.range(0, 50, 1, 1)
    for label in "abc":
        assert batches.map_batches(one, counting(label, tmp_path), LOADED, ["id"], models=1).count() == 50
    # Workers hold one model each; whoever loaded another one has closed the one before.
    by_process = {}
    for path in tmp_path.glob("loaded-*"):
        by_process.setdefault(path.read_text(), []).append(path.name)
    assert len(list(tmp_path.glob("closed-*"))) == sum(len(loaded) - 1 for loaded in by_process.values())
    own = batches.map_batches(spark.range(0, 90, 1, 9), counting("own", tmp_path), LOADED, ["id"], models=0).collect()
    assert len({row["model"] for row in own}) == 9 == len(list(tmp_path.glob("closed-own-*")))


def test_names_of_models():
    assert batches.model_key(counting("a", "x")) == batches.model_key(counting("a", "x")) != batches.model_key(counting("b", "x"))
    profile = batches.device_profile(0.5, cpus=2)
    assert profile.taskResources["gpu"].amount == 0.5 and profile.taskResources["cpus"].amount == 2


def test_filter_and_columns_reach_the_scan(spark, tables):
    documents = spark.read.parquet(f"{tables}/documents.parquet").withColumnRenamed("doc_id", "id")
    scored = batches.map_batches(documents, factory(), SCHEMA, ["id"], where=F.col("n_chars") > 500)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(n_chars,500)" in plan
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in plan


def test_a_stopped_run_goes_on_where_it_stopped(spark, tmp_path):
    path = str(tmp_path / "done")
    kept = StructType().add("id", "long").add("twice", "long")
    todo = spark.range(500)
    turn = F.pmod(F.xxhash64("id"), F.lit(3))
    third = {row["id"] for row in todo.where(turn == 1).collect()}

    def step(broken):
        def load():
            def apply(frame):
                if broken and set(frame["id"]) & third:
                    raise RuntimeError("out of memory")
                return pd.DataFrame({"id": frame["id"], "twice": frame["id"] * 2})

            return apply

        return lambda rows: batches.map_batches(rows, load, kept, ["id"])

    with pytest.raises(PythonException, match="out of memory"):
        batches.run_resumable(todo, step(True), path, kept, ["id"], rounds=3)
    written = {row["id"] for row in batches.finished(spark, path, kept).collect()}
    assert written == {row["id"] for row in todo.where(turn == 0).collect()}
    rows = batches.run_resumable(todo, step(False), path, kept, ["id"], rounds=3).collect()
    assert sorted((row["id"], row["twice"]) for row in rows) == [(i, 2 * i) for i in range(500)]
    again = batches.run_resumable(todo, step(True), path, kept, ["id"], rounds=3)
    assert again.count() == 500


def test_nothing_finished_yet(spark, tmp_path):
    assert batches.finished(spark, str(tmp_path / "absent"), SCHEMA).isEmpty()


def test_finished_rounds_are_not_read_again(spark, tmp_path, monkeypatch):
    path, kept = str(tmp_path / "done"), StructType().add("id", "long").add("twice", "long")
    compared, worked = [], []
    plain = batches.unfinished
    monkeypatch.setattr(batches, "unfinished", lambda todo, done, on: compared.append(len(done.inputFiles())) or plain(todo, done, on))

    def step(rows):
        worked.append(rows.count())
        return rows.select("id", (F.col("id") * 2).alias("twice"))

    todo = spark.range(400)
    first = batches.run_resumable(todo, step, path, kept, ["id"], rounds=4)
    assert first.count() == 400 and sum(worked) == 400 and len(compared) == 4
    compared.clear(), worked.clear()
    assert batches.run_resumable(todo.orderBy(F.desc("id")), step, path, kept, ["id"], rounds=4).count() == 400
    assert compared == [] and worked == []
    # One more row: only its round is compared, and only that row is worked on.
    assert batches.run_resumable(spark.range(401), step, path, kept, ["id"], rounds=4).count() == 401
    assert len(compared) == 1 and worked == [1]
    # Another number of rounds knows nothing of these, and still repeats no row.
    worked.clear()
    again = batches.run_resumable(spark.range(401), step, path, kept, ["id"], rounds=2)
    assert again.count() == 401 == again.select("id").distinct().count() and worked == [0, 0]


def test_a_round_without_its_note_is_compared(spark, tmp_path):
    path, kept = str(tmp_path / "done"), StructType().add("id", "long")
    spark.range(100).write.parquet(path)  # appended, and stopped before the note
    seen = []
    rows = batches.run_resumable(spark.range(150), lambda rest: seen.append(rest.count()) or rest, path, kept, ["id"])
    assert rows.count() == 150 and seen == [50]
    assert batches.run_resumable(spark.range(0), lambda rest: rest, str(tmp_path / "no"), kept, ["id"]).isEmpty()
