"""Quality rules: plain counts, then a log-likelihood ratio of trusted target to raw corpus.

Words and pairs of words are hashed into two multinomials, one over all documents and
one over trusted ones, the latter smoothed by the former. A document's ratio is the mean
over its words and pairs, so that its length does not matter. One threshold, found on
labelled rows that may be learned from but were not counted as trusted, holds for every
document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoframe.llm import shared
from annoframe.llm.toxicity import labelled
from annoframe.llm.words import NOT_SPACE, SPACES, byte_table, runs, words_of

#: One in so many labelled rows is kept for the threshold.
CALIBRATION = 4
FEATURES = 1 << 16
WIDTH = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
_SYMBOLS = byte_table(b"#*$%&|<>")
_SLICE = 2 << 20
#: Bins of a hundredth, from -5 to 5, in which labelled rows are counted for the threshold.
_BINS = 1000


@dataclass
class Model:
    ratio: np.ndarray
    threshold: float = -np.inf


def _features(hashes: np.ndarray, firsts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of words, then of pairs of words: their features and the first of each text (one more than texts)."""
    counts = np.diff(firsts)
    pairs = runs(hashes, 2)
    inside = np.ones(len(hashes), bool)
    inside[firsts[1:][counts > 0] - 1] = False
    both = np.concatenate([[0], np.cumsum(np.maximum(counts - 1, 0))])
    return [((hashes >> np.uint64(48)).astype(np.int64), firsts), ((pairs >> np.uint64(48)).astype(np.int64)[inside[: len(pairs)]], both)]


def _words(texts: pa.Array):
    data, bounds = shared.utf8(texts)
    return (data, bounds, *words_of(data, bounds, NOT_SPACE, lower=False)[2:])


def _ratios(hashes: np.ndarray, firsts: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    total, n = np.zeros(len(firsts) - 1), np.zeros(len(firsts) - 1)
    for found, begins in _features(hashes, firsts):
        sums = np.concatenate([[0.0], np.cumsum(ratio[found], dtype=np.float64)])
        total += sums[begins[1:]] - sums[begins[:-1]]
        n += np.diff(begins)
    return total / np.maximum(n, 1)


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Count all documents as raw, and trusted ones (label above 0) where ``learn`` (of ``__id``) holds.

    A quarter of the labelled rows where ``learn`` holds is not counted as trusted and gives
    the threshold: the middle of the ratios that part both labels best; of several such
    ranges, from the first to the last. Without rows of both labels there nothing is
    rejected. Rows where ``learn`` does not hold are raw text alone.
    """
    spark = docs.sparkSession
    shared.ship(spark)
    learn = F.lit(True) if learn is None else learn
    rows = labelled(docs, labels, id, text, label)
    reserved = F.floor(shared.crc_of_id(F.col("__id")) / 4) % CALIBRATION == 0
    rows = rows.select(text, "__label", *(F.coalesce(learn & x, F.lit(False)).alias(name) for name, x in (("__learn", ~reserved), ("__calibrates", reserved))))

    def count(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        out = {"raw": np.zeros(FEATURES, np.int64), "trusted": np.zeros(FEATURES, np.int64)}
        for batch in batches:
            for piece in shared.slices(batch, text, _SLICE):
                _, _, hashes, firsts = _words(shared.column(piece, text))
                trusted = np.array([bool(a and b and b > 0) for a, b in zip(shared.column(piece, "__learn").to_pylist(), shared.column(piece, "__label").to_pylist(), strict=True)], bool)
                for found, begins in _features(hashes, firsts):
                    out["raw"] += np.bincount(found, minlength=FEATURES)
                    out["trusted"] += np.bincount(found[np.repeat(trusted, np.diff(begins))], minlength=FEATURES)
        return out

    counts = shared.summed(rows, count, {"raw": FEATURES, "trusted": FEATURES})
    raw = (counts["raw"] + 1) / (counts["raw"].sum() + FEATURES)
    trusted = (counts["trusted"] + FEATURES * raw) / (counts["trusted"].sum() + FEATURES)
    model = Model(np.log(trusted / raw).astype(np.float32))
    ratio = spark.sparkContext.broadcast(model.ratio)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in shared.slices(batch, text, _SLICE):
                _, _, hashes, firsts = _words(shared.column(piece, text))
                at = np.clip(np.floor((_ratios(hashes, firsts, ratio.value) + 5) * 100), 0, _BINS - 1).astype(np.int32)
                enough = pa.array(np.diff(firsts) >= LEAST_WORDS)
                yield pa.RecordBatch.from_arrays([pa.array(at), shared.column(piece, "__label")], names=["bin", "label"]).filter(enough)

    judged = rows.where("__calibrates AND __label IS NOT NULL").select(text, "__label")
    seen = np.zeros((2, _BINS))
    for row in shared.in_batches(judged, bins, "bin int, label int").groupBy("bin", "label").count().collect():
        seen[int(row["label"] > 0), row["bin"]] += row["count"]
    if seen.sum(axis=1).all():
        bad, good = seen / seen.sum(axis=1, keepdims=True)
        # Cut k rejects all bins below k.
        gain = np.concatenate([[0], np.cumsum(bad)]) - np.concatenate([[0], np.cumsum(good)])
        best = np.flatnonzero(gain >= gain.max() - 1e-12)
        model.threshold = float((best[0] + best[-1]) / 200 - 5)
    return model


def _repeated(windows: np.ndarray) -> int:
    """Words inside windows that stand twice or more."""
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[inverse] > 1)
    if not len(again):
        return 0
    steps = np.zeros(len(windows) + WIDTH, np.int64)
    steps[again] += 1
    steps[again + WIDTH] -= 1
    return int((np.cumsum(steps) > 0).sum())


def _equal_lines(text: bytes | None) -> int:
    lines = [line for line in (text or b"").split(b"\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def judge(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns, with counts of each whole text, its ratio and the verdict.

    ``__n_words``, ``__word_chars``, ``__n_symbols``, ``__n_dup_lines``, ``__n_repeat_words``;
    ``__base_failed`` for fewer than ten words or more than 20 % of them in repeated
    windows of five; ``__ratio`` and ``__kept``. NULL and empty texts have no words and
    fail. Equal texts have equal rows; an empty table gives none.
    """
    spark = docs.sparkSession
    shared.ship(spark)
    given = spark.sparkContext.broadcast(model)
    names = ["__n_words", "__word_chars", "__n_symbols", "__n_dup_lines", "__n_repeat_words", "__ratio"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in shared.slices(batch, text, _SLICE):
                data, bounds, hashes, firsts = _words(shared.column(piece, text))

                def by_text(flags: np.ndarray, bounds=bounds) -> np.ndarray:
                    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[bounds])

                windows = runs(hashes, WIDTH)
                repeated = [_repeated(windows[lo : hi - WIDTH + 1]) if hi - lo >= WIDTH else 0 for lo, hi in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)]
                columns = [
                    np.diff(firsts), by_text(NOT_SPACE[data] & ((data & 0xC0) != 0x80)), by_text(_SYMBOLS[data]),
                    np.array([_equal_lines(t) for t in shared.column(piece, text).cast(pa.binary()).to_pylist()], np.int64),
                    np.array(repeated, np.int64),
                ]
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, *(pa.array(c, pa.int64()) for c in columns), pa.array(_ratios(hashes, firsts, given.value.ratio))], names=[*piece.schema.names, *names]
                )

    schema = ", ".join([*(f"`{n}` {k}" for n, k in docs.dtypes), *(f"{n} long" for n in names[:-1]), "__ratio double"])
    failed = (F.col("__n_words") < LEAST_WORDS) | (100 * F.col("__n_repeat_words") > MOST_REPEATED_PERCENT * F.col("__n_words"))
    return shared.in_batches(docs, look, schema).withColumn("__base_failed", failed).withColumn("__kept", ~failed & (F.col("__ratio") >= float(model.threshold)))
