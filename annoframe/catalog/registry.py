"""Collects queries and their SQL by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The given tables as attributes, read lazily by path."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark = spark
        self._folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of the tables under its own name, with its SQL."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[build.__name__] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            SQL[build.__name__] = sql
        return build

    return register


def words(values) -> str:
    """A SQL list of string literals."""
    return ", ".join("'" + value.replace("'", "''") + "'" for value in values)


def case_label(value: str, edges: list[str], labels) -> str:
    """SQL for the label of the interval that holds a value; ``edges`` are SQL terms, all of them."""
    arms = " ".join(
        f"WHEN {value} <= {edge} THEN {words([label])}" for edge, label in zip(edges[1:], labels[:-1], strict=False)
    )
    return f"CASE WHEN {value} IS NULL THEN NULL {arms} ELSE {words([labels[-1]])} END"
