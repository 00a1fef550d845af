"""Column lists, row filters and leading rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoframe.functions import text as T
from annoframe.functions import vocabulary as V


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` itself, or an error that lists what is missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")
    return df


def drop_columns(df: DataFrame, columns: Sequence[str] | str) -> DataFrame:
    """Drop columns, given as a list or as names joined by ``+``; unknown names are an error."""
    names = columns.split("+") if isinstance(columns, str) else list(columns)
    return require_columns(df, names).drop(*names)


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename columns; unknown names and collisions are errors."""
    require_columns(df, list(names))
    renamed = [names.get(name, name) for name in df.columns]
    if len(set(renamed)) != len(renamed):
        raise ValueError(f"renaming gives duplicate columns: {renamed}")
    return df.withColumnsRenamed(dict(names))


def first_rows(df: DataFrame, count: int, order_by: Sequence[str]) -> DataFrame:
    """The first ``count`` rows by key, for trial runs: every task keeps only its own first rows."""
    return df.orderBy(*order_by).limit(count)


def without_keywords(
    df: DataFrame, column: str, words: Sequence[str] = V.NON_SPEECH_MARKERS, keep_null: bool = False
) -> DataFrame:
    """Rows whose text holds none of ``words``; rows without text go unless ``keep_null``."""
    clean = ~T.contains_any(F.col(column), words)
    return df.where(F.coalesce(clean, F.lit(keep_null)))


def without_tokens(df: DataFrame, column: str, tokens: Sequence[str] = V.PUNCTUATION_MARKERS) -> DataFrame:
    """Cut punctuation markers out of a text column."""
    return df.withColumn(column, T.strip_tokens(F.col(column), tokens))


def ids_with_label(
    df: DataFrame, column: str = "noise", labels: Sequence[str] = V.NOISY_LABELS, id_column: str = "segment_id"
) -> DataFrame:
    """Ids of the rows whose label is one of ``labels``."""
    return df.where(F.col(column).isin(*labels)).select(id_column)


def at_least_seconds(df: DataFrame, begin: str = "begin_time", end: str = "end_time", seconds: float = 3) -> DataFrame:
    """Rows that last at least ``seconds``."""
    return df.where(F.col(end).cast("double") - F.col(begin).cast("double") >= seconds)
