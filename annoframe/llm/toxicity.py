"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary documents.

A class model gives a word after another its count there, less a discount; what the
discount frees goes to the word's continuation count, the number of different words that
it follows in documents of the class, less a discount; what that one frees goes to a
backoff that both classes share, the continuation counts of the whole corpus. A word that
a class has met too rarely gets about the same probability in both.

A text is scored by both models: the differences of log-likelihood, divided by the number
of words, once of its words alone and once of what the word before adds. Both signs count.
A difference within ``GATE`` counts as none and greater ones as what they have above it:
there the smaller class knows too little. How much each of the two means weighs is fitted
on labelled rows that the counts don't hold, as weights of orders are.

Counts are rows of tables keyed by hashes of words (64 bits, 48 of the word before) and of
pairs of words; they grow with the vocabulary. Rows whose difference is none are left out of what scores.
"""

from __future__ import annotations

import itertools
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoframe.llm import shared
from annoframe.llm.words import ALPHANUMERIC, mixed, words_of
from annoframe.operators.lookup import TARGET_ROWS, key_counts, lookup_join, sliced_join

#: Taken from each count of a class; log ratio within which a word or a pair counts as equal in both.
DISCOUNT = 1.5
GATE = 1.5
#: The label whose rows the calibration is fitted on: one in so many labelled rows.
CALIBRATION = 4
THRESHOLD = 0.3
#: Label rows up to this number are broadcast (24 bytes each); more are joined by shuffle.
BROADCAST_LABELS = 1_000_000
#: Rows of words or of pairs up to this number are broadcast once they are counted; of more, the most frequent half of
#: this number is broadcast and the others are joined by shuffle.
BROADCAST_ROWS = 2_000_000
#: Bits for each key of the filter that holds these others, and for all of them at most (32 MB); parts in which it is made; bits set by a key.
FILTER_BITS_A_KEY = 8
FILTER_BITS = 1 << 28
FILTER_PARTS = 128
PROBES = 3
#: Slots in which the rows of keys are counted, to see whether any key can have very many.
SLOTS = 4096
#: Pairs that a task gathers before it adds them up; bytes of text for which there is a bucket of pairs.
GATHERED = 2_000_000
BUCKET_BYTES = 32 << 20
#: Parts in which a task holds these pairs; one at a time is added up, so that sorting takes memory for one.
PARTS = 16
#: Bytes of text whose words are hashed at a time.
PIECE = 1 << 19
#: Means are put on a scale that is linear below ``_FLOOR`` and logarithmic above, with so many bins a unit, up to ``_BINS`` on each side.
_FLOOR = 1e-3
_STEPS = 20
_BINS = 256
#: Bytes of the hash of a word before.
_SHORT = 6


@dataclass
class Model:
    """The differences of words and of pairs, as tables (key, value, seen), and what turns a document's means of them into a probability.

    ``seen`` tells frequent keys from rare ones: the words that a word follows, the times that a class has a pair.
    """

    words: DataFrame | None = None
    pairs: DataFrame | None = None
    #: The difference of words that stand in no table.
    other: float = 0.0
    #: Bias, weight of words, weight of pairs.
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)


def _places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words and of the words before them (1 at the start of a text), and the first word of each text."""
    _, _, hashes, firsts = words_of(*shared.utf8(texts), ALPHANUMERIC, lower=True)
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1] & np.uint64((1 << 8 * _SHORT) - 1)
    before[firsts[:-1][np.diff(firsts) > 0]] = np.uint64(1)
    return hashes, before, firsts


def _paired(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + words)


def labelled(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, asked: Column | None = None) -> DataFrame:
    """(text, __id, __label) of every document; ``__label`` is NULL where there is none. Several labels of an id: the largest.

    ``asked`` is an expression of ``__id``: where it doesn't hold, nobody uses the label, and
    it may be NULL. If labels are too many for a broadcast, these rows are not shuffled.
    """
    known = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id).alias("__of")).agg(F.max(F.col(label).cast("int")).alias("__label"))
    rows = docs.select(F.col(id).alias("__id"), F.col(text))
    if labels.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        return rows.join(F.broadcast(known), F.col("__id") == F.col("__of"), "left").drop("__of")
    asked = F.coalesce(F.col("__id").isNotNull() & (F.lit(True) if asked is None else asked), F.lit(False))
    found = rows.where(asked).join(known, F.col("__id") == F.col("__of"), "left").drop("__of")
    return found.unionByName(rows.where(~asked).withColumn("__label", F.lit(None).cast("int")))


def _planes(numbers: np.ndarray) -> bytes:
    """Small numbers, compressed byte by byte."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _numbers(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _packed(word: np.ndarray, before: np.ndarray, *counts: np.ndarray) -> bytes:
    """Pairs in order of their words: each different hash stands once, in full."""
    words, per_word = np.unique(word, return_counts=True)
    befores, of = np.unique(before, return_inverse=True)
    short = befores.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_SHORT].tobytes()
    return pickle.dumps((words.tobytes(), _planes(per_word), short, _planes(of), [_planes(n) for n in counts]), 5)


def _unpacked(blob: bytes) -> tuple:
    words, per_word, short, of, counts = pickle.loads(blob)
    befores = np.zeros((len(short) // _SHORT, 8), np.uint8)
    befores[:, :_SHORT] = np.frombuffer(short, np.uint8).reshape(-1, _SHORT)
    return np.repeat(np.frombuffer(words, np.uint64), _numbers(per_word)), befores.view("<u8").ravel()[_numbers(of)], *map(_numbers, counts)


def _added(parts: list[tuple]) -> tuple:
    """The different pairs of (word, before, counts ...), with the sums of their counts."""
    word, before, *counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    keys = _paired(before, word)
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    first = order[starts]
    return word[first], before[first], *(np.add.reduceat(n[order], starts) if len(n) else n for n in counts)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple:
    """The different keys in order, and the sums of their values."""
    keys, of = np.unique(keys, return_inverse=True)
    return keys, *(np.bincount(of, n, len(keys)) for n in values)


class _Gathered:
    """Pairs in ``PARTS`` parts, each added up by itself."""

    def __init__(self) -> None:
        self.parts: list[list[tuple]] = [[] for _ in range(PARTS)]
        self.size = 0  # pairs that are held
        self.fresh = 0  # those that have come since all were added up

    def take(self, pairs: tuple, part: np.ndarray) -> None:
        """Pairs, and for each the number of its part."""
        order = np.argsort(part.astype(np.uint8), kind="stable")
        edges = np.append(0, np.cumsum(np.bincount(part, minlength=PARTS)))
        for held, x, y in zip(self.parts, edges, edges[1:], strict=False):
            if y > x:
                held.append(tuple(values[order[x:y]] for values in pairs))
        self.size += len(part)
        self.fresh += len(part)

    def add_up(self) -> None:
        for k, held in enumerate(self.parts):
            if len(held) > 1:
                self.parts[k] = [_added(held)]
        self.size, self.fresh = sum(len(pairs[0]) for held in self.parts for pairs in held), 0

    def given(self) -> Iterator[tuple]:
        """The different pairs of each part that has some, in order of the parts; nothing is held afterwards."""
        parts, self.parts, self.size, self.fresh = self.parts, [[] for _ in range(PARTS)], 0, 0
        while parts:
            held = parts.pop(0)
            if held:
                yield _added(held)


def _buckets(n_bytes: int) -> tuple[int, int]:
    """Into how many buckets words are dealt, and the words before one word: a frequent word meets ever more of them."""
    buckets = max(8, -(-n_bytes // BUCKET_BYTES))
    before = 1 << max(1, int(np.log2(np.sqrt(buckets))))
    return -(-buckets // before), before


def _counted(rows: DataFrame, text: str, n_bytes: int) -> DataFrame:
    """Three kinds of rows, from all different pairs.

    Pairs that a class has more often than the discount takes: word, before, n0, n1. Words
    (before is NULL): every, c0, c1, how many words they follow, in all documents and in
    each class. Words before others (word is NULL): n0, n1, f0, f1, what stands after them
    in each class and how much discounts take of it. Rows of words and of words before are
    parts to be summed, one for each bucket. Tasks send the pairs they hold packed, by
    buckets of about equal size, so that each pair meets in one.
    """
    of_word, of_before = _buckets(n_bytes)

    def bucket_of(word: np.ndarray, before: np.ndarray) -> np.ndarray:
        return ((word >> np.uint64(8)) % np.uint64(of_word) * np.uint64(of_before) + before % np.uint64(of_before)).astype(np.int64)

    def rows_of(pairs: tuple) -> pa.RecordBatch:
        word, before, *counts = pairs
        bucket = bucket_of(word, before)
        order = np.lexsort((before, word, bucket))
        word, before, bucket, *counts = (x[order] for x in (word, before, bucket, *counts))
        edges = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(bucket)]
        blobs = [_packed(word[x:y], before[x:y], *(n[x:y] for n in counts)) for x, y in zip(edges, edges[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]]), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = _Gathered()
        for batch in batches:
            for piece in shared.slices(batch, text, PIECE):
                word, before, firsts = _places(shared.column(piece, text))
                own = np.repeat(shared.column(piece, "__class").to_numpy(zero_copy_only=False), np.diff(firsts))
                pairs = _added([(word, before, *((own == c).astype(np.int32) for c in (0, 1)))])
                gathered.take(pairs, bucket_of(*pairs[:2]) % PARTS)  # all pairs of a bucket are in one part
                if gathered.size > GATHERED:
                    gathered.add_up()
                    if 2 * gathered.size > GATHERED:
                        yield from map(rows_of, gathered.given())
        yield from map(rows_of, gathered.given())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = ((k.as_py(), blob.as_buffer()) for batch in batches for k, blob in zip(*batch.columns, strict=True))
        for _, bucket in itertools.groupby(every, lambda row: row[0]):
            gathered = _Gathered()
            for _, blob in bucket:
                pairs = _unpacked(blob)
                gathered.take(pairs, (pairs[0] >> np.uint64(60)).astype(np.int64))  # all pairs of a word are in one part
                if gathered.fresh > GATHERED:
                    gathered.add_up()
            contexts = []
            for word, before, *counts in gathered.given():
                words, of, follows = np.unique(word, return_inverse=True, return_counts=True)
                in_class = [np.bincount(of[n > 0], minlength=len(words)) for n in counts]
                yield _wide(word=words, every=follows, c0=in_class[0], c1=in_class[1])
                known = np.flatnonzero((counts[0] > 0) | (counts[1] > 0))
                word, before, counts = word[known], before[known], [n[known] for n in counts]
                contexts.append(_summed(before, *counts, *(np.minimum(n, DISCOUNT) for n in counts)))
                often = (counts[0] > DISCOUNT) | (counts[1] > DISCOUNT)
                yield _wide(word=word[often], before=before[often], n0=counts[0][often], n1=counts[1][often])
            before, *sums = _summed(*(np.concatenate(x) for x in zip(*contexts, strict=True)))
            yield _wide(before=before, n0=sums[0], n1=sums[1], f0=sums[2], f1=sums[3])

    packed = shared.in_batches(rows.select(text, "__class"), count, "bucket long, blob binary")
    return shared.in_batches(packed.repartition("bucket").sortWithinPartitions("bucket"), merge, ", ".join(f"{n} {kind}" for n, kind in _WIDE.items()))


_WIDE = {"word": "long", "before": "long", "n0": "long", "n1": "long", "every": "long", "c0": "long", "c1": "long", "f0": "double", "f1": "double"}


def _wide(**columns: np.ndarray) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    kinds = {name: pa.int64() if kind == "long" else pa.float64() for name, kind in _WIDE.items()}
    arrays = [pa.array(columns[name].astype(np.int64 if kind == pa.int64() else float)) if name in columns else pa.nulls(size, kind) for name, kind in kinds.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(_WIDE))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        before, word = (shared.column(batch, name).to_numpy().view(np.uint64) for name in ("before", "word"))
        yield pa.RecordBatch.from_arrays([pa.array(_paired(before, word).view(np.int64)), shared.column(batch, "value"), shared.column(batch, "seen")], names=["key", "value", "seen"])


def _looked_up(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Left join to a table with one row a key: broadcast if it has few rows, else with frequent keys dealt out."""
    few = right.limit(BROADCAST_ROWS // 2 + 1).count() <= BROADCAST_ROWS // 2
    return left.join(F.broadcast(right), on, "left") if few else lookup_join(left, right, [on])


def _met(table: DataFrame, pairs: DataFrame, on: str) -> DataFrame:
    """The rows whose key stands in the pairs, if these keys are few enough for a broadcast; else all rows."""
    keys = pairs.select(on).distinct()
    few = keys.limit(BROADCAST_ROWS // 2 + 1).count() <= BROADCAST_ROWS // 2
    return table.join(F.broadcast(keys), on, "left_semi") if few else table


def _gated(ratio: Column) -> Column:
    return F.signum(ratio) * F.greatest(F.abs(ratio) - GATE, F.lit(0.0))


def _taken(count: Column) -> Column:
    return F.least(count.cast("double"), F.lit(DISCOUNT))


@dataclass
class Likelihoods:
    """Both models: the probabilities of class 0 and 1, as tables."""

    #: (word, every, p0, p1) of words that a class has.
    words: DataFrame | None
    #: (before, word, n0, n1, p0, p1, q0, q1) of pairs that a class has more often than the discount takes; q: after the word before.
    pairs: DataFrame | None
    #: Logarithm of what the toxic class frees to the backoff over what the ordinary one does.
    freed: float


def likelihoods(rows: DataFrame, text: str, n_bytes: int) -> Likelihoods:
    """The models of (text, ``__class``), class 0 and 1, and -1 for documents that the backoff alone counts.

    Where a class has no word there are no tables, and ``freed`` is infinite with the sign of the other.
    """
    counted = shared.kept(_counted(rows, text, n_bytes), "pairs")
    pairs = counted.where("word IS NOT NULL AND before IS NOT NULL").select("word", "before", "n0", "n1")
    follows = shared.kept(counted.where("before IS NULL").groupBy("word").agg(*(F.sum(n).alias(n) for n in ("every", "c0", "c1"))), "continuations")
    of_words = follows.agg(F.count("*").alias("words"), *(F.sum(n).alias(n) for n in ("every", "c0", "c1")), *(F.sum(_taken(F.col(n))).alias(f"of_{n}") for n in ("c0", "c1"))).first()
    if not of_words["c0"] or not of_words["c1"]:
        return Likelihoods(None, None, np.inf if of_words["c1"] else -np.inf)

    backoff = (F.col("every") + 0.5) / float(of_words["every"] + 0.5 * of_words["words"])
    probabilities, freed = [], []
    for c in ("c0", "c1"):
        freed.append(float(of_words[f"of_{c}"] / of_words[c]))
        probabilities.append((F.col(c) - _taken(F.col(c))) / float(of_words[c]) + freed[-1] * backoff)
    words = follows.where("c0 > 0 OR c1 > 0").select("word", "every", *(p.alias(f"p{c}") for c, p in enumerate(probabilities)))

    # What the word before adds, for pairs that a class holds more often than the discount takes.
    contexts = _met(counted.where("word IS NULL").select("before", "n0", "n1", "f0", "f1"), pairs, "before").groupBy("before").agg(
        *(F.sum(f"n{c}").alias(f"all{c}") for c in (0, 1)), *(F.sum(f"f{c}").alias(f"freed{c}") for c in (0, 1))
    )
    met = _looked_up(_looked_up(pairs, shared.kept(contexts, "contexts"), "before"), _met(words, pairs, "word"), "word")

    def after(c: int) -> Column:
        n = F.col(f"all{c}")
        return F.when(n > 0, (F.col(f"n{c}") - _taken(F.col(f"n{c}"))) / n + F.col(f"freed{c}") / n * F.col(f"p{c}")).otherwise(F.col(f"p{c}"))

    met = met.select("before", "word", "n0", "n1", "p0", "p1", *(after(c).alias(f"q{c}") for c in (0, 1)))
    return Likelihoods(words, met, float(np.log(freed[1]) - np.log(freed[0])))


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Count words over all documents, learn classes from labelled rows where ``learn`` holds, fit the calibration.

    ``learn`` is an expression of ``__id``; by default every label is used. A quarter of
    these rows calibrates, the rest is counted. A class without rows leaves all scores at
    the share of the other one.
    """
    shared.ship(docs.sparkSession)
    learn = F.lit(True) if learn is None else learn
    rows = labelled(docs, labels, id, text, label, learn)
    reserved = (F.floor(shared.crc_of_id(F.col("__id")) / 4) % CALIBRATION) == 0
    use = F.when(learn & F.col("__label").isNotNull(), F.when(reserved, F.lit(-1)).otherwise((F.col("__label") > 0).cast("int"))).otherwise(F.lit(-1))
    rows = rows.select(text, "__label", F.coalesce(use, F.lit(-1)).alias("__class"), F.coalesce(learn & reserved, F.lit(False)).alias("__calibrates"))

    n_bytes = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    both = likelihoods(rows, text, n_bytes)
    if both.words is None:
        return Model(weights=(30.0 if both.freed > 0 else -30.0, 0.0, 0.0))
    ratio = F.log("p1") - F.log("p0")
    model = Model(other=float(np.sign(both.freed) * max(abs(both.freed) - GATE, 0)))
    model.words = shared.kept(both.words.select(F.col("word").alias("key"), (_gated(ratio) - model.other).alias("value"), F.col("every").alias("seen")).where("abs(value) > 1e-9"), "words")
    values = both.pairs.select("before", "word", _gated(F.log("q1") - F.log("q0") - ratio).alias("value"), (F.col("n0") + F.col("n1")).alias("seen")).where("value <> 0")
    model.pairs = shared.kept(shared.in_batches(values, _keyed, "key long, value double, seen long"), "pair-values")
    model.weights = _calibrated(rows.where("__calibrates AND __label IS NOT NULL").select(text, "__label"), model, text)
    return model


def _table(values: DataFrame | None) -> tuple[tuple[np.ndarray, np.ndarray], DataFrame | None]:
    """The values in order of their keys, for all tasks. If there are more than are broadcast: the most frequent ones, and a table of the others."""
    if values is None:
        return (np.zeros(0, np.int64), np.zeros(0)), None
    others = None
    if values.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        step = F.floor(F.log2("seen") * 8)
        sizes = sorted(((row["step"], row["count"]) for row in values.groupBy(step.alias("step")).count().collect()), reverse=True)
        within = [at for (at, _), upto in zip(sizes, itertools.accumulate(n for _, n in sizes), strict=True) if upto <= BROADCAST_ROWS // 2]
        least = min(within, default=sizes[0][0] + 1)
        values, others = values.where(step >= least), values.where(step < least)
    got = values.select("key", "value").toArrow()
    keys, numbers = got.column("key").to_numpy(), got.column("value").to_numpy()
    order = np.argsort(keys, kind="stable")
    return (keys[order], numbers[order]), others


def _found(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key would stand in the table, and whether it does."""
    ordered, keys = table[0], keys.view(np.int64)
    if not len(ordered):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)
    return at, ordered[at] == keys


def _looked(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    at, stands = _found(table, keys)
    return np.where(stands, table[1][at], 0.0) if len(table[1]) else np.zeros(len(keys))


def _bits(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The bits of each key in its part of a filter, a probe at a time; a part has ``bits``."""
    for k in range(PROBES):
        yield ((keys >> np.uint64(18 * k)) & np.uint64(bits - 1)).astype(np.int64)


def _part(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(57)).astype(np.int64)  # 128 parts, by bits that no probe takes


def _filter(keys: DataFrame) -> np.ndarray:
    """Bits of all keys, a row for each part. A full filter holds more than its keys, never less."""
    bits = FILTER_BITS_A_KEY * keys.count() // FILTER_PARTS
    bits = 1 << min(max(10, bits.bit_length()), (FILTER_BITS // FILTER_PARTS).bit_length() - 1)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            own = shared.column(batch, "key").to_numpy().view(np.uint64)
            parts = _part(own)
            for part in np.unique(parts).tolist():
                bitmap = held.setdefault(part, np.zeros(bits, bool))
                for places in _bits(own[parts == part], bits):
                    bitmap[places] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in held.values()], pa.binary())], names=["part", "blob"])

    dealt = keys.select("key").repartition(F.shiftrightunsigned("key", 57))
    out = np.zeros((FILTER_PARTS, bits // 8), np.uint8)
    for row in shared.in_batches(dealt, fill, "part int, blob binary").collect():
        out[row["part"]] |= np.frombuffer(row["blob"], np.uint8)
    return out


def _may_hold(bitmaps: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The places of the keys that the filter holds."""
    left = np.arange(len(keys))
    for k in range(PROBES):
        own = keys[left]
        at = next(itertools.islice(_bits(own, bitmaps.shape[1] * 8), k, None))
        left = left[(bitmaps[_part(own), at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
    return left


_MEANS = ("__of_words", "__of_pairs")


def _with_means(docs: DataFrame, model: Model, text: str, orders: tuple[bool, bool] = (True, True)) -> DataFrame:
    """All columns, with the mean difference of a text's words and of its pairs; an order that is not asked for is 0.

    Tables of few rows are broadcast. Of a longer one the most frequent keys are; those of
    the others that a text has are joined to it, and texts find their sums by hash: equal texts share them.
    """
    tables, others = zip(*(_table(values if asked else None) for values, asked in zip((model.words, model.pairs), orders, strict=True)), strict=True)
    given = docs.sparkSession.sparkContext.broadcast((tables, model.other if orders[0] else 0.0))

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, other = given.value
        for batch in batches:
            for piece in shared.slices(batch, text, PIECE):
                keys, firsts = _keys(shared.column(piece, text))
                n = np.maximum(np.diff(firsts), 1)
                of = np.repeat(np.arange(piece.num_rows), np.diff(firsts))
                out = [np.bincount(of, _looked(table, own) + start, piece.num_rows) / n for table, own, start in zip(tables, keys, (other, 0.0), strict=True)]
                yield pa.RecordBatch.from_arrays([*piece.columns, *map(pa.array, out)], names=[*piece.schema.names, *_MEANS])

    means = shared.in_batches(docs, mean, ", ".join([*(f"`{n}` {k}" for n, k in docs.dtypes), *(f"{name} double" for name in _MEANS)]))
    if others == (None, None):
        return means
    added = _added_means(docs, others, given, text)
    more = [(F.col(name) + F.coalesce(f"__more{k}", F.lit(0.0))).alias(name) for k, name in enumerate(_MEANS)]
    return means.select("*", *_marks(text)).join(added, ["__a", "__b"], "left").select(*(F.col(f"`{name}`") for name in docs.columns), *more)


def _keys(texts: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The keys of all words and of all pairs, and the first word of each text."""
    words, before, firsts = _places(texts)
    return (words, _paired(before, words)), firsts


def _marks(text: str) -> tuple[Column, Column]:
    """Two hashes that stand for a text."""
    return F.xxhash64(F.lit(1), F.col(text)).alias("__a"), F.xxhash64(F.lit(2), F.col(text)).alias("__b")


def _added_means(docs: DataFrame, others: tuple[DataFrame | None, ...], given, text: str) -> DataFrame:
    """What the values of ``others`` add to both means of a text, by its marks; a text without them may be missing.

    A text sends the different keys that the filter of all these values may hold and that
    ``given``, the broadcast tables, don't have. A key of very many rows is dealt to slices.
    """
    values = [table.select("key", F.lit(order).alias("order"), "value") for order, table in enumerate(others) if table is not None]
    values = values[0].unionAll(values[1]) if len(values) > 1 else values[0]
    asked = tuple(table is not None for table in others)
    held = docs.sparkSession.sparkContext.broadcast(_filter(values))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, _ = given.value
        for batch in batches:
            for piece in shared.slices(batch, text, PIECE):
                keys, firsts = _keys(shared.column(piece, text))
                of = np.repeat(np.arange(piece.num_rows), np.diff(firsts))
                rows, parts = [], []
                for order in np.flatnonzero(asked):
                    left = _may_hold(held.value, keys[order])
                    left = left[~_found(tables[order], keys[order][left])[1]]
                    own, mine = keys[order][left].view(np.int64), of[left]
                    ordered = np.lexsort((own, mine))
                    own, mine = own[ordered], mine[ordered]
                    starts = np.flatnonzero(np.append(True, (np.diff(mine) != 0) | (np.diff(own) != 0))[: len(own)])
                    rows.append((mine[starts], np.full(len(starts), order, np.int32), own[starts]))
                    parts.append(np.diff(np.append(starts, len(own))) / np.diff(firsts)[mine[starts]])
                # A row without a key for each text that sends keys: so many copies there are of it.
                texts = np.unique(np.concatenate([x[0] for x in rows]))
                rows.append((texts, np.full(len(texts), -1, np.int32), np.zeros(len(texts), np.int64)))
                mine, order, own = (np.concatenate(x) for x in zip(*rows, strict=True))
                marks = [shared.column(piece, name).take(pa.array(mine)) for name in ("__a", "__b")]
                yield pa.RecordBatch.from_arrays([*marks, pa.array(order), pa.array(own), pa.array(np.concatenate([*parts, np.ones(len(texts))]))], names=["__a", "__b", "order", "key", "part"])

    texts = docs.where(F.col(text).isNotNull()).select(text, *_marks(text))
    sent = shared.kept(shared.in_batches(texts, spread, "__a long, __b long, order int, key long, part double"), "keys")
    keyed, slot = sent.where("order >= 0"), F.pmod("key", F.lit(SLOTS))
    full = [row["slot"] for row in keyed.groupBy(slot.alias("slot")).count().where(F.col("count") > TARGET_ROWS).collect()]
    on = ["key", "order"]
    met = sliced_join(keyed, values, on, "inner", key_counts(keyed.where(slot.isin(full)), on), ["__a", "__b"]) if full else keyed.join(values, on)
    terms = met.select("__a", "__b", "order", (F.col("part") * F.col("value")).alias("term"))
    sums = terms.unionAll(sent.where("order < 0").select("__a", "__b", "order", F.col("part").alias("term"))).groupBy("__a", "__b").agg(
        *(F.sum(F.when(F.col("order") == k, F.col("term")).otherwise(0.0)).alias(f"sum{k}") for k in (0, 1)), F.count(F.when(F.col("order") < 0, 1)).alias("copies")
    )
    return shared.kept(sums.select("__a", "__b", *((F.col(f"sum{k}") / F.col("copies")).alias(f"__more{k}") for k in (0, 1))), "added-means")


def _scaled(mean: Column) -> Column:
    return F.asinh(mean / _FLOOR)


def _calibrated(rows: DataFrame, model: Model, text: str) -> tuple[float, float, float]:
    """Logistic regression of the label on both means, scaled, over counts of all calibration rows by bin; no weight is negative."""
    places = [F.least(F.greatest(F.round(_scaled(F.col(name)) * _STEPS), F.lit(-_BINS)), F.lit(_BINS)).alias(name) for name in _MEANS]
    bins = shared.kept(_with_means(rows, model, text).select((F.col("__label") > 0).alias("toxic"), *places).groupBy("toxic", *_MEANS).count(), "bins").toPandas()
    if not len(bins):
        return 0.0, 1.0, 0.0
    scaled = bins[list(_MEANS)].to_numpy(float).T / _STEPS
    weights, toxic = bins["count"].to_numpy(float), bins["toxic"].to_numpy(float)
    for used in ([0, 1], [0], [1], []):
        design = np.stack([np.ones(len(bins)), *scaled[used]])
        beta = np.zeros(len(design))
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(beta @ design, -30, 30)))
            hessian = (design * (weights * p * (1 - p))) @ design.T + 1e-2 * np.eye(len(design))
            step = np.linalg.solve(hessian, design @ (weights * (toxic - p)) - 1e-2 * beta)
            beta += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        if (beta[1:] > 0).all():
            break
    of = dict(zip(used, beta[1:].tolist(), strict=True))
    return float(beta[0]), of.get(0, 0.0), of.get(1, 0.0)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns and ``__score``: how likely the text is toxic, from 0 to 1.

    Words are runs of ASCII letters, digits and all characters beyond ASCII, A-Z
    lower-cased. NULL, empty texts and texts without words get the score of a text whose
    words say nothing. Equal texts have equal scores; an empty table gives none.
    """
    bias, of_words, of_pairs = model.weights
    means = _with_means(docs, model, text, (of_words != 0, of_pairs != 0))
    sums = F.lit(bias) + of_words * _scaled(F.col(_MEANS[0])) + of_pairs * _scaled(F.col(_MEANS[1]))
    return means.select(*(F.col(f"`{name}`") for name in docs.columns), (1 / (1 + F.exp(-F.least(F.greatest(sums, F.lit(-30.0)), F.lit(30.0))))).alias("__score"))


def not_held_out() -> Column:
    """Rows that may be learned from: crc32 of the id as text, mod 4, is not 2."""
    return F.col("__id").isNotNull() & ~shared.held_out(F.col("__id"))
