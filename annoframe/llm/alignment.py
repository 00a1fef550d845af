"""Tokens of two tokenizers over the same text, cut into groups that end at the same byte.

The ends of both sides are walked along a diagonal: while the k-th token of one side and the
(k + shift)-th of the other end together, stretches of doubling length are compared at once,
so runs of one-to-one groups are jumped up to the first difference. The tokens from there to
the next common end are one irregular group, which is walked token by token and gives the new
shift. Walks begin at a common end every so many tokens and go on side by side as arrays.

Ids and group sizes travel as bytes: ids in the smallest unsigned type that holds the
vocabulary, sizes in one byte each, a larger one as bytes of 255 and the rest.

Links are pairs of tokens that share a byte. How often two ids are linked is counted over
the whole corpus, as rows of a table keyed by both ids.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoframe.llm import shared, tokens
from annoframe.operators.lookup import lookup_join

#: Counts of id pairs up to this number are broadcast once they are counted (17 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 2_000_000
#: Pairs of ids that a task gathers before it sends the different ones on.
GATHERED = 2_000_000
ALIGNED = ("__a", "__b", "__groups_a", "__groups_b")
_SLICE = 1 << 20
#: Tokens of the first stretch that is compared; each further one is twice as long.
_NEAR = 4
#: Tokens of a that a walk goes over; walks over a slice of texts go on side by side.
_WALK = 64
_BLANK = "▁"


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class PieceEncoder(tokens.Encoder):
    """A sentencepiece vocabulary, which adds a space before the text, and the words it has met."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.pieces_of = SentencePieceProcessor(model_file=path)
        size = self.pieces_of.get_piece_size()
        self.kind, self.code, self.pieces = np.dtype("<u2" if size <= 1 << 16 else "<u4"), "H", {}
        names = [self.pieces_of.id_to_piece(k) for k in range(size)]
        #: Words can be encoded apart if no piece goes on with a space after something else.
        self.cuts = not any(_BLANK in name.lstrip(_BLANK) for name in names)
        self.raw = [bytes([int(name[3:5], 16)]) if self.pieces_of.is_byte(k) else name.replace(_BLANK, " ").encode() for k, name in enumerate(names)]
        self.added = [_BLANK]  # in a text it joins the spaces beside it
        self._forget()

    def plain(self, text: str) -> bytes:
        """The ids of a text that begins with a space, which the library adds."""
        return np.array(self.pieces_of.encode(text.removeprefix(" "), num_threads=1), self.kind).tobytes()

    def odd(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        """Words whose text has to be encoded as a whole: all but those after a single space."""
        return (gaps != 1) | (not self.cuts)

    def _learned(self, words: list[bytes]) -> list[bytes]:
        return [np.array(ids, self.kind).tobytes() for ids in self.pieces_of.encode([w.decode() for w in words], num_threads=1)]

    def entries(self) -> list[bytes]:
        """The bytes of each token."""
        return self.raw


_ENCODERS: dict[str, tokens.Encoder] = {}


def encoder(path: str) -> tokens.Encoder:
    """The tokenizer of this worker process: byte-level (``.json``) or of pieces (``.model``); special tokens in texts are plain text."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path) if path.endswith(".model") else tokens.Encoder(path, special_as_text=True)
    return _ENCODERS[path]


def _common(ends_a: np.ndarray, ends_b: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From tokens x of a and y of b on, token by token to the first that end together."""
    x, y, left = x.copy(), y.copy(), np.arange(len(x))
    while len(left):
        a, b = ends_a[x[left]], ends_b[y[left]]
        x[left] += a < b
        y[left] += b < a
        left = left[a != b]
    return x, y


def diagonal(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of a and of b each group has; both cover the same bytes, and the last tokens end together."""
    n, m = len(ends_a), len(ends_b)
    if (n == 0) != (m == 0) or n and ends_a[-1] != ends_b[-1]:
        raise ValueError("both sides don't end together")
    # Many walks go side by side, each from the common end after so many tokens to that of the next one.
    x = np.arange(_WALK - 1, n - 1, _WALK)
    x, y = _common(ends_a, ends_b, x, np.searchsorted(ends_b, ends_a[x]))
    i, first = np.unique(np.concatenate([[0], x + 1]), return_index=True)
    j = np.concatenate([[0], y + 1])[first]
    stops = np.append(i[1:], n)
    i, j, stops = (v[i < n] for v in (i, j, stops))
    # Beyond the last tokens nothing ends together.
    far_a, far_b = np.concatenate([ends_a, [-1]]), np.concatenate([ends_b, [-2]])
    closes_a, closes_b = np.zeros(n, bool), np.zeros(m, bool)
    while len(i):
        # Runs of one-to-one groups at the shift of each walk: stretches of doubling length.
        probing, width = np.arange(len(i)), _NEAR
        while len(probing):
            at = np.arange(width)
            of_a, of_b = i[probing, None] + at, j[probing, None] + at
            same = np.logical_and.accumulate(far_a[np.minimum(of_a, n)] == far_b[np.minimum(of_b, m)], axis=1)
            closes_a[of_a[same]] = True
            closes_b[of_b[same]] = True
            length = same.sum(axis=1)
            i[probing] += length
            j[probing] += length
            probing = probing[(length == width) & (i[probing] < stops[probing])]
            width *= 2
        left = i < stops
        i, j, stops = i[left], j[left], stops[left]
        # The irregular group after each run, which gives the new shift.
        x, y = _common(ends_a, ends_b, i, j)
        closes_a[x] = True
        closes_b[y] = True
        i, j = x + 1, y + 1
        left = i < stops
        i, j, stops = i[left], j[left], stops[left]
    return np.diff(np.flatnonzero(closes_a), prepend=-1), np.diff(np.flatnonzero(closes_b), prepend=-1)


def packed(values: np.ndarray, per_row: np.ndarray) -> pa.Array:
    """The values as bytes, so many for each row."""
    bounds = np.concatenate([[0], np.cumsum(per_row)]) * values.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(per_row), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def unpacked(blobs: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows, and the bounds between the rows."""
    offsets = np.frombuffer(blobs.buffers()[1], np.int32, len(blobs) + 1, blobs.offset * 4).astype(np.int64) if len(blobs) else np.zeros(1, np.int64)
    raw = np.frombuffer(blobs.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(raw.tobytes(), kind), (offsets - offsets[0]) // np.dtype(kind).itemsize


def packed_sizes(sizes: np.ndarray, per_row: np.ndarray) -> pa.Array:
    """Sizes from 1 on, in one byte each; from 255 on in several."""
    if sizes.max(initial=0) < 255:
        return packed(sizes.astype(np.uint8), per_row)
    n_bytes = sizes // 255 + 1
    out = np.full(int(n_bytes.sum()), 255, np.uint8)
    upto = np.cumsum(n_bytes)
    out[upto - 1] = sizes % 255
    ends = np.concatenate([[0], upto])[np.concatenate([[0], np.cumsum(per_row)])]
    return packed(out, np.diff(ends))


def unpacked_sizes(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sizes of all rows, and the bounds between the rows."""
    raw, bounds = unpacked(blobs, np.uint8)
    if raw.max(initial=0) < 255:
        return raw.astype(np.int64), bounds
    last = np.flatnonzero(raw != 255)
    sizes = np.diff(np.concatenate([[0], np.cumsum(raw, dtype=np.int64)[last]]))
    return sizes, np.searchsorted(last, bounds)


def align(docs: DataFrame, id: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(id, ``__a``, ``__b``, ``__groups_a``, ``__groups_b``): the ids of both sides, and how many each group has of them.

    Both sides encode a space and the text. A text that is NULL, empty, or whose tokens
    don't give back those bytes on either side has empty lists. Every row gets its own; rows
    without an id or with a repeated one too. An empty table gives none.
    """
    path_a, path_b = path_a or default_paths()[0], path_b or default_paths()[1]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = encoder(path_a), encoder(path_b)
        raw = [np.frombuffer(b"".join(c.entries()), np.uint8) for c in coders]
        widths = [np.array([len(x) for x in c.entries()], np.int64) for c in coders]
        begins = [np.cumsum(w) - w for w in widths]
        for batch in batches:
            for piece in shared.slices(batch, text, _SLICE):
                own = shared.column(piece, text)
                full = pc.fill_null(pc.not_equal(own, ""), False)
                texts = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), own.filter(full).cast(pa.large_string()), pa.scalar(" ", pa.large_string()))
                data, bounds = shared.utf8(texts)
                good = np.ones(len(texts), bool)
                sides, cut = [], tokens.cut(texts)
                for coder, flat, width, begin in zip(coders, raw, widths, begins, strict=True):
                    ids, upto = coder.encode(texts, cut)
                    ends = np.cumsum(width[ids])
                    text_ends = np.concatenate([[0], ends])[upto]
                    sizes = np.diff(text_ends)
                    same = sizes == np.diff(bounds)
                    if same.all():  # the usual case: one comparison of all bytes
                        given = flat[np.repeat(begin[ids] - (ends - width[ids]), width[ids]) + np.arange(len(data))]
                        wrong = np.flatnonzero(given != data)
                        same[np.searchsorted(bounds, wrong, "right") - 1] = False
                    else:
                        entries = coder.entries()
                        for k in np.flatnonzero(same).tolist():
                            same[k] = b"".join(map(entries.__getitem__, ids[upto[k] : upto[k + 1]].tolist())) == data[bounds[k] : bounds[k + 1]].tobytes()
                    good &= same
                    sides.append((ids.astype(np.int64), np.diff(upto)))
                groups_of = np.zeros(len(texts), np.int64)
                kept, counts, ends = [], [], []
                for (ids, n), width in zip(sides, widths, strict=True):
                    kept.append(ids[np.repeat(good, n)])
                    counts.append(np.where(good, n, 0))
                    ends.append(np.cumsum(width[kept[-1]]))
                group_a, group_b = diagonal(*ends)
                if len(group_a):
                    firsts = np.cumsum(group_a) - group_a  # a group never runs over the end of a text
                    groups_of = np.diff(np.searchsorted(firsts, np.concatenate([[0], np.cumsum(counts[0])])))
                rows = np.zeros((3, len(own)), np.int64)
                rows[:, full.to_numpy(zero_copy_only=False)] = *counts, groups_of
                lists = [packed(ids.astype(coder.kind), n) for ids, n, coder in zip(kept, rows, coders, strict=False)] + [packed_sizes(sizes, rows[2]) for sizes in (group_a, group_b)]
                yield pa.RecordBatch.from_arrays([shared.column(piece, id), *lists], names=["__id", *ALIGNED])

    kind = dict(docs.dtypes)[id]
    return shared.in_batches(docs.select(id, text), encode, f"__id {kind}, " + ", ".join(f"{name} binary" for name in ALIGNED))


def links(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, widths: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of both tokens of every link and its group: first those of one-to-one groups, then the others."""
    odd = (group_a != 1) | (group_b != 1)
    odd_a, odd_b, groups = np.repeat(odd, group_a), np.repeat(odd, group_b), np.flatnonzero(odd)
    own_a, own_b = a[odd_a], b[odd_b]
    ends_a, ends_b = np.cumsum(widths[0][own_a]), np.cumsum(widths[1][own_b])
    ends = np.concatenate([ends_a, ends_b])
    ends.sort(kind="stable")  # two runs in order are merged
    ends = ends[np.diff(ends, prepend=0) > 0]
    at = np.searchsorted(ends_a, ends)
    of = np.repeat(groups, group_a[groups])
    return np.concatenate([a[~odd_a], own_a[at]]), np.concatenate([b[~odd_b], own_b[np.searchsorted(ends_b, ends)]]), np.concatenate([np.flatnonzero(~odd), of[at]])


def _keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) << 32) | b


def _rows(aligned: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a bounded number of tokens; a longer row is a run of its own."""
    _, upto = unpacked(shared.column(aligned, "__a"), np.uint8)
    at = 0
    while at < aligned.num_rows:
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + _SLICE, "right")) - 1)
        yield aligned.slice(at, to - at)
        at = to


def _sides(piece: pa.RecordBatch, kinds: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """Values and bounds of the ids of both sides and of the sizes of their groups."""
    a, b, group_a, group_b = (shared.column(piece, name) for name in ALIGNED)
    return [unpacked(a, kinds[0]), unpacked(b, kinds[1]), unpacked_sizes(group_a), unpacked_sizes(group_b)]


def _kinds(path_a: str, path_b: str) -> list:
    return [encoder(p).kind for p in (path_a, path_b)]


def _widths(path_a: str, path_b: str) -> list[np.ndarray]:
    return [np.array([len(x) for x in encoder(p).entries()], np.int64) for p in (path_a, path_b)]


def link_counts(aligned: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(``__pair``, ``__count``, ``__best``): how many links of the whole corpus hold the ids a << 32 | b, and whether no other a has more with this b."""
    path_a, path_b = path_a or default_paths()[0], path_b or default_paths()[1]

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        different, of = np.unique(keys, return_inverse=True)
        return different, np.bincount(of, counts, len(different)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widths, kinds, parts, size = _widths(path_a, path_b), _kinds(path_a, path_b), [], 0
        for batch in batches:
            for piece in _rows(batch):
                linked_a, linked_b, _ = links(*(x for x, _ in _sides(piece, kinds)), widths)
                parts.append(np.unique(_keys(linked_a, linked_b), return_counts=True))
                size += len(parts[-1][0])
                if size > GATHERED:
                    parts = [summed(parts)]
                    size = len(parts[0][0])
                    if 2 * size > GATHERED:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, parts[0])), names=["__pair", "__n"])
                        parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, summed(parts))), names=["__pair", "__n"])

    every = shared.in_batches(aligned.select(*ALIGNED), count, "__pair long, __n long").groupBy("__pair").agg(F.sum("__n").alias("__count"))
    every = shared.kept(every, "pairs")
    b_id = F.col("__pair").bitwiseAND(0xFFFFFFFF).alias("__of")
    most = every.groupBy(b_id).agg(F.max("__count").alias("__most"))
    return shared.kept(every.withColumn("__of", b_id).join(most, "__of").select("__pair", "__count", (F.col("__count") == F.col("__most")).alias("__best")), "pair-counts")


@functools.cache
def _decimals(width: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of up to so many digits in ASCII, as eight bytes with zeros before them and one after, and how many digits each has."""
    if width > 7:
        raise ValueError("ids of more than seven digits")
    numbers, powers = np.arange(10**width), 10 ** np.arange(width - 1, -1, -1)
    lengths = 1 + (numbers[:, None] >= powers[None, :-1]).sum(axis=1)
    cells = np.zeros((len(numbers), 8), np.uint8)
    cells[:, 7 - width : 7] = np.where(np.arange(width) < width - lengths[:, None], 0, 48 + numbers[:, None] // powers % 10)
    return cells.view(np.uint64).ravel(), lengths


def _written(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups of all rows as ``a1,a2|b1;a3|b2,b3`` in bytes, and the bounds between the rows."""
    before_a, before_b = np.cumsum(group_a) - group_a, np.cumsum(group_b) - group_b
    # In their order: the tokens of a of a group, then those of b; each with the sign after it.
    place_a = np.arange(len(a)) + np.repeat(before_b, group_a)
    place_b = np.arange(len(b)) + np.repeat(before_a + group_a, group_b)
    ids = np.empty(len(a) + len(b), np.int64)
    ids[place_a], ids[place_b] = a, b
    signs = np.full(len(ids), ord(","), np.uint8)
    signs[before_a + group_a + before_b - 1] = ord("|")
    closes = before_a + group_a + before_b + group_b - 1
    signs[closes] = ord(";")
    rows = np.concatenate([[0], np.cumsum(groups)])
    signs[closes[rows[1:][groups > 0] - 1]] = 0  # no sign after the last group of a row
    digits, lengths = _decimals(len(str(int(ids.max(initial=0)))))
    cells = digits[ids].view(np.uint8)
    cells[7::8] = signs
    ends = np.concatenate([[0], np.cumsum(lengths[ids] + (signs > 0))])
    tokens_upto = np.concatenate([[0], (closes + 1)])[rows] if len(closes) else np.zeros(len(rows), np.int64)
    return cells[cells > 0], ends[tokens_upto]


SUMMARY = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def summarise(aligned: DataFrame, counts: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(``__id``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of :func:`align`.

    ``n_best`` are the links whose count is the highest that their id of b has, ``count_sum``
    adds up the counts of all links. The digest is that of the groups as text; a row without
    tokens has zeros and an empty digest.
    """
    path_a, path_b = path_a or default_paths()[0], path_b or default_paths()[1]
    few = counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    spark = aligned.sparkSession
    table = None
    if few:
        got = counts.orderBy("__pair").toArrow()
        pairs, count, tops = (got.column(name).combine_chunks().to_numpy(zero_copy_only=False) for name in ("__pair", "__count", "__best"))
        # Where the most frequent pair of each id of a stands: most links are of that pair.
        order = np.lexsort((count, pairs >> 32))
        usual = np.zeros(int(pairs[-1] >> 32) + 1 if len(pairs) else 0, np.int64)
        usual[pairs[order] >> 32] = order
        table = pairs, count, tops, usual
    given = spark.sparkContext.broadcast(table)
    schema = f"__id {dict(aligned.dtypes)['__id']}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widths, kinds = _widths(path_a, path_b), _kinds(path_a, path_b)
        for batch in batches:
            for piece in _rows(batch):
                (a, a_upto), (b, b_upto), (group_a, g_upto), (group_b, _) = _sides(piece, kinds)
                linked_a, linked_b, groups = links(a, b, group_a, group_b, widths)
                of = np.searchsorted(g_upto, groups, "right") - 1
                best = total = np.zeros(piece.num_rows, np.int64)
                if given.value is not None and len(groups):
                    pairs, count, tops, usual = given.value
                    keys, at = _keys(linked_a, linked_b), usual[linked_a]
                    other = np.flatnonzero(pairs[at] != keys)
                    at[other] = np.searchsorted(pairs, keys[other])
                    order = np.argsort(of, kind="stable")
                    upto = np.searchsorted(of[order], np.arange(piece.num_rows + 1))
                    best, total = (np.diff(np.concatenate([[0], np.cumsum(x[at[order]], dtype=np.int64)])[upto]) for x in (tops, count))
                raw, bounds = _written(a, b, group_a, group_b, np.diff(g_upto))
                view = memoryview(raw)
                digests = [hashlib.sha256(view[x:y]).hexdigest() if y > x else "" for x, y in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
                columns = [np.diff(x) for x in (a_upto, b_upto, g_upto)] + [np.bincount(of, minlength=piece.num_rows), best, total]
                yield pa.RecordBatch.from_arrays([shared.column(piece, "__id"), *(pa.array(c.astype(np.int64)) for c in columns), pa.array(digests, pa.string())], names=["__id", *SUMMARY])

    if few:
        return shared.in_batches(aligned, summary, schema)
    return _joined(aligned, counts, summary, schema, path_a, path_b)


def _joined(aligned: DataFrame, counts: DataFrame, summary, schema: str, path_a: str, path_b: str) -> DataFrame:
    """The summaries where the counts are too many for a broadcast: the different pairs of each row meet them by shuffle."""
    numbered = shared.kept(aligned.withColumn("__row", F.monotonically_increasing_id()), "numbered")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widths, kinds = _widths(path_a, path_b), _kinds(path_a, path_b)
        for batch in batches:
            for piece in _rows(batch):
                (a, _), (b, _), (group_a, g_upto), (group_b, _) = _sides(piece, kinds)
                linked_a, linked_b, groups = links(a, b, group_a, group_b, widths)
                keys, of = _keys(linked_a, linked_b), np.searchsorted(g_upto, groups, "right") - 1
                order = np.lexsort((keys, of))
                new = np.ones(len(order), bool)
                new[1:] = (np.diff(of[order]) != 0) | (np.diff(keys[order]) != 0)
                starts = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays(
                    [shared.column(piece, "__row").take(pa.array(of[order][starts])), pa.array(keys[order][starts]), pa.array(np.diff(np.append(starts, len(order))))], names=["__row", "__pair", "__times"]
                )

    pairs = shared.in_batches(numbered.select("__row", *ALIGNED), spread, "__row long, __pair long, __times long")
    found = lookup_join(pairs, counts, ["__pair"], "inner", ["__row"]).groupBy("__row").agg(
        F.sum(F.when(F.col("__best"), F.col("__times")).otherwise(0)).alias("__links"), F.sum(F.col("__times") * F.col("__count")).alias("__total")
    )

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _rows(batch):
                for out in summary([piece]):
                    yield pa.RecordBatch.from_arrays([*out.columns, shared.column(piece, "__row")], names=[*out.schema.names, "__row"])

    rows = shared.in_batches(numbered, plain, schema + ", __row long")
    joined = rows.join(found, "__row", "left")
    return joined.withColumns({"n_best": F.coalesce("__links", F.lit(0).cast("long")), "count_sum": F.coalesce("__total", F.lit(0).cast("long"))}).select("__id", *SUMMARY)


def aligned_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """The summary of every document: aligned once, saved, counted over the whole corpus, then summed up."""
    aligned = shared.kept(align(docs, id, text, path_a, path_b), "aligned")
    return summarise(aligned, link_counts(aligned, path_a, path_b), path_a, path_b).withColumnRenamed("__id", id)
