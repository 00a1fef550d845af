"""User models over Arrow batches, kept by their workers, with restart."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from .lookup import key_digest, unfinished

BatchFunction = Callable[[pd.DataFrame], pd.DataFrame]


def model_key(factory: Callable[[], BatchFunction]) -> str:
    """A name for what a factory loads: equal code with equal captured values has one name."""
    return hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()


def device_profile(devices: float = 1, device: str = "gpu", cpus: int = 1) -> ResourceProfile:
    """Resources of a stage whose tasks each need (a part of) a device; executors must offer it."""
    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(cpus).resource(device, devices)).build


def map_batches(
    df: DataFrame, factory: Callable[[], BatchFunction], schema: StructType | str, keep: Sequence[str],
    batch_size: int = 1000, where=None, name: str | None = None, models: int = 2, profile: ResourceProfile | None = None,
) -> DataFrame:
    """Apply a model to every row.

    ``factory`` loads a model and returns the function for one batch. A worker process
    loads it once and keeps it for all its tasks, also those of later queries, under
    ``name`` (by default the content of the factory: a model from a changed file needs a
    new name). A worker keeps the ``models`` it used last; one that it gives up is closed if
    its function has ``close``; with 0 every task loads its own and closes it. ``profile``
    are the resources that a task of this stage needs, such as a device.

    Spark cannot see into Python: rows are filtered by ``where`` and cut to the ``keep``
    columns first, so that both reach the scan.
    """
    rows = df if where is None else df.where(where)
    key = name or model_key(factory)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sys
        from types import ModuleType

        # The registry is a module of the worker process: functions are sent anew with every task, modules stay.
        kept = sys.modules.setdefault("_annoframe_models", ModuleType("_annoframe_models")).__dict__.setdefault("kept", {})

        def give_up(most: int) -> None:
            while len(kept) > most:
                close = getattr(kept.pop(next(iter(kept))), "close", None)
                if close is not None:
                    close()

        if key not in kept:
            give_up(max(models - 1, 0))
            kept[key] = factory()
        apply = kept[key] = kept.pop(key)  # the one used last stands last
        try:
            for frame in frames:
                for begin in range(0, len(frame), batch_size):
                    yield apply(frame.iloc[begin : begin + batch_size])
        finally:
            give_up(models)

    return rows.select(*keep).mapInPandas(run, schema, profile=profile)


def finished(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Results written so far; none if nothing has been written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


LEDGER_SCHEMA = "rounds int, round int, digest array<long>"


def ledger_path(path: str) -> str:
    """Where the finished rounds of the results in ``path`` are noted: beside them."""
    return f"{path.rstrip('/')}-ledger"


def round_digests(todo: DataFrame, turn: Column, on: Sequence[str], rounds: int) -> dict[int, list[int]]:
    """For each round that has rows: how many, keys without a value, and the digest of all keys; ``rounds`` rows at most."""
    missing = reduce(Column.__or__, [F.col(name).isNull() for name in on])
    fields = [F.count(F.when(missing, True)).alias("nulls"), *key_digest(on)]
    return {row["round"]: list(row)[1:] for row in todo.groupBy(turn.cast("int").alias("round")).agg(*fields).collect()}


def run_resumable(
    todo: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, schema: StructType, on: Sequence[str],
    rounds: int = 1,
) -> DataFrame:
    """Apply ``step`` to every row of ``todo`` not in ``path`` yet and append the results there.

    The rows are worked off in ``rounds`` appends, parted by a hash of the key; an
    append is committed whole or not at all, so after a crash the same call goes
    on with the first round that is not complete. A ledger beside the results notes each
    finished round with the digest of its keys in ``todo``: a round that it knows with the same
    digest is passed over, and neither its results nor its rows are read again. Only
    another round (not noted, or with other rows by now) is held against the results. A
    crash between an append and its note costs one such comparison. The ledger is believed:
    delete it together with results. Every round reads ``todo``, and one pass over its keys
    finds the digests: give it a saved table.
    """
    spark = todo.sparkSession
    turn = F.pmod(F.xxhash64(*[F.col(name) for name in on]), F.lit(rounds))
    wanted = round_digests(todo, turn, on, rounds)
    ledger = ledger_path(path)
    notes = finished(spark, ledger, StructType.fromDDL(LEDGER_SCHEMA)).where(F.col("rounds") == rounds).collect()
    known = {(note["round"], tuple(note["digest"])) for note in notes}
    for number in sorted(wanted):
        if (number, tuple(wanted[number])) in known:
            continue
        rest = unfinished(todo.where(turn == number), finished(spark, path, schema), on)
        step(rest).write.mode("append").parquet(path)
        note = spark.createDataFrame([(rounds, number, wanted[number])], LEDGER_SCHEMA)
        note.coalesce(1).write.mode("append").parquet(ledger)
    return finished(spark, path, schema)
