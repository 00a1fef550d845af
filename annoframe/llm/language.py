"""Language by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoframe.llm import shared
from annoframe.llm.words import LOWER, mixed

SIZES = (1, 2, 3)
#: Columns of the log-probability matrix; languages that it has rows for in one pass (64 MB in all).
FEATURES = 1 << 16
GROUP = 256
_SLICE = 1 << 20
_MAYBE_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Part:
    """Some languages, and one row of log-probabilities of features for each."""

    languages: list[str]
    prior: np.ndarray
    matrix: np.ndarray


@dataclass
class Model:
    """All languages by name, and what makes the parts of ``GROUP`` languages one after the other, in that order."""

    languages: list[str]
    groups: int
    parts: Callable[[], Iterator[Part]]


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size of n-grams, the features of all texts in a row, and the first of each text (one more than texts)."""
    data, bounds = shared.utf8(texts)
    data = LOWER[data]
    letters = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
    text_of = np.repeat(np.arange(len(texts)), np.diff(begins))
    for size in SIZES:
        n = len(letters) - size + 1
        if n <= 0:
            yield np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
            continue
        value = np.full(n, size, np.uint64)
        for k in range(size):
            value = value * np.uint64(0x100000001B3) + letters[k : k + n]
        inside = text_of[:n] == text_of[size - 1 :]
        counts = np.maximum(np.diff(begins) - size + 1, 0)
        yield (mixed(value) >> np.uint64(48)).astype(np.int64)[inside], np.concatenate([[0], np.cumsum(counts)])


def has_letter(text: str | None) -> bool:
    return any(m[0].isalpha() for m in _MAYBE_LETTER.finditer(text)) if text else False


def fit(docs: DataFrame, learn: Column | None = None, id: str = "doc_id", text: str = "text", language: str = "lang") -> Model:
    """Count the n-grams of every document that has a language and where ``learn`` (of ``__id``) holds.

    NULL languages and texts teach nothing; without any language, every text is ``und``. Up to
    ``GROUP`` languages are counted here; of more, each group is counted when its turn comes,
    from its own documents, so that the driver and the tasks hold one matrix at a time.
    """
    rows = docs.select(F.col(id).alias("__id"), F.col(text), F.col(language).alias("__lang")).where(F.col("__lang").isNotNull() & F.col(text).isNotNull())
    rows = (rows if learn is None else rows.where(learn)).select(text, "__lang")
    documents = {row["__lang"]: row["count"] for row in rows.groupBy("__lang").count().collect()}
    known, every = sorted(documents), sum(documents.values())
    groups = [known[at : at + GROUP] for at in range(0, len(known), GROUP)] or [[]]

    def part(names: list[str]) -> Part:
        own = rows if len(groups) == 1 else rows.where(F.col("__lang").isin(names))
        totals = shared.summed(own, _counter(names, text), dict.fromkeys(names, FEATURES)) if names else {}
        matrix = np.zeros((len(names), FEATURES), np.float32)
        for row, name in enumerate(names):
            smooth = totals.pop(name) + 0.5
            matrix[row] = np.log(smooth / smooth.sum())
        return Part(names, np.log(np.array([documents[name] for name in names]) / max(every, 1)), matrix)

    if len(groups) > 1:
        return Model(known, len(groups), lambda: map(part, groups))
    only = part(groups[0])
    return Model(known, 1, lambda: iter([only]))


def _counter(names: list[str], text: str) -> Callable[[Iterator[pa.RecordBatch]], dict[str, np.ndarray]]:
    """What counts the features of each language over the rows of a task."""
    number = {name: k for k, name in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        table = np.zeros((len(names), FEATURES), np.int64)
        for batch in batches:
            for piece in shared.slices(batch, text, _SLICE):
                of = np.array([number[x] for x in shared.column(piece, "__lang").to_pylist()])
                for found, firsts in features(shared.column(piece, text)):
                    joint = np.repeat(of, np.diff(firsts)) * FEATURES + found
                    table += np.bincount(joint, minlength=table.size).reshape(table.shape)
        return dict(zip(names, table, strict=True))

    return count


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns with ``__lang`` and ``__score``, the posterior probability of the language.

    Every whole text is scored against all languages. NULL, and texts without a letter, are
    ``und`` with score 0. Ties go to the first language by name. An empty table gives none;
    a column named as one of the added ones, ``__best`` or ``__odds`` is an error. A model of
    several parts takes one pass each, and the rows are written between passes with the best
    language so far and the odds of all others against it.
    """
    shared.refuse(docs, ["__lang", "__score", "__best", "__odds"])
    spark = docs.sparkSession
    shared.ship(spark)
    plain = [f"`{name}` {kind}" for name, kind in docs.dtypes]
    schema = ", ".join([*plain, "__lang string, __best double, __odds double"])
    table = docs
    for number, part in enumerate(model.parts()):
        given = spark.sparkContext.broadcast(part)
        table = shared.in_batches(table, _rater(given, text, number > 0), schema)
        if model.groups > 1:
            table = shared.kept(table, "languages")
            given.unpersist()
    score = F.when(F.col("__best").isNull(), 0.0).otherwise(1 / F.col("__odds"))
    return table.select(*[F.col(f"`{name}`") for name in docs.columns], "__lang", score.alias("__score"))


def _rater(given, text: str, later: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What scores texts against the languages of one part; a ``later`` part goes on from the best of those before."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = given.value
        for batch in batches:
            for piece in shared.slices(batch, text, _SLICE):
                sums = np.repeat(part.prior[:, None], piece.num_rows, axis=1)
                for found, firsts in features(shared.column(piece, text)):
                    for k in range(len(part.languages)):
                        total = np.concatenate([[0.0], np.cumsum(part.matrix[k][found], dtype=np.float64)])
                        sums[k] += total[firsts[1:]] - total[firsts[:-1]]
                known = np.array([has_letter(t) for t in shared.column(piece, text).to_pylist()], bool) & bool(part.languages)
                top = sums.argmax(axis=0) if part.languages else np.zeros(piece.num_rows, int)
                best = sums.max(axis=0) if part.languages else np.zeros(piece.num_rows)
                odds = np.exp(sums - best).sum(axis=0) if part.languages else np.ones(piece.num_rows)
                names = [part.languages[k] if ok else "und" for k, ok in zip(top.tolist(), known.tolist(), strict=True)]
                columns, titles = piece.columns, piece.schema.names
                if later:
                    names_before, best_before, odds_before = (c for c in columns[-3:])
                    columns, titles = columns[:-3], titles[:-3]
                    former = best_before.fill_null(0.0).to_numpy(zero_copy_only=False)
                    stays = former >= best
                    high = np.maximum(former, best)
                    odds = odds_before.to_numpy(zero_copy_only=False) * np.exp(former - high) + odds * np.exp(best - high)
                    names = [old if keep else new for old, new, keep in zip(names_before.to_pylist(), names, stays.tolist(), strict=True)]
                    best = high
                added = [pa.array(names, pa.string()), pa.array(best, pa.float64(), mask=~known), pa.array(odds, pa.float64())]
                yield pa.RecordBatch.from_arrays([*columns, *added], names=[*titles, "__lang", "__best", "__odds"])

    return rate
