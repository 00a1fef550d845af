"""Fill-in-the-middle: cut texts into prefix, middle and suffix, and send the middle to the end.

Whole batches are moved at once. A scan finds the cuts of every text, a difference array
gets at each cut by how much the bytes from there on move, its running sum is the shift of
every byte, and one scatter puts all bytes in their places; markers go into what is left
free. The way back finds the markers in the output and gathers every byte from its place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoframe.llm import shared
from annoframe.llm.words import NOT_SPACE

PLAIN, PSM, SPM = "plain", "psm", "spm"
ADDED = ("__n", "__form", "__prefix_chars", "__middle_chars")
_SLICE = 2 << 20


@dataclass(frozen=True)
class Rule:
    """Markers of prefix, suffix and middle; of 100 texts how many are cut, and of 100 cut ones how many begin with the suffix."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    cut: int = 50
    suffix_first: int = 80
    seed: int = 42

    def __post_init__(self):
        marks = self.marks
        heads = {m[0] for m in marks if m}
        if not all(marks) or any(heads & set(m[1:]) for m in marks) or any(b.startswith(a) for a, b in permutations(marks, 2)):
            raise ValueError("a marker's first byte stands nowhere else in a marker, and no marker begins another one")

    @property
    def marks(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix.encode(), self.suffix.encode(), self.middle.encode()


def draws(id: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 from the digest of seed and id; a row without an id has those of an empty id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def scattered(data: np.ndarray, at: np.ndarray, moves: np.ndarray, size: int) -> np.ndarray:
    """Bytes in their new places: from ``at[k]`` on they move by ``moves[k]`` more than those before."""
    shift = np.zeros(len(data) + 1, np.int64)
    np.add.at(shift, at, moves)
    out = np.zeros(size, np.uint8)
    out[np.arange(len(data)) + np.cumsum(shift[:-1])] = data
    return out


def gathered(data: np.ndarray, at: np.ndarray, moves: np.ndarray, size: int) -> np.ndarray:
    """``size`` bytes from their old places: from place ``at[k]`` on they lie ``moves[k]`` further than those before."""
    shift = np.zeros(size + 1, np.int64)
    np.add.at(shift, at, moves)
    return data[np.arange(size) + np.cumsum(shift[:-1])]


def strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def units(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of all words, the first word of each text (one more than texts), and how many units each text has.

    A unit is a word with the white space before it; white space at the end is one more.
    """
    inside = NOT_SPACE[data]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    full = np.flatnonzero(np.diff(bounds) > 0)
    tails = bounds[full + 1] - 1
    last[tails] = inside[tails]
    ends = np.flatnonzero(last) + 1
    firsts = np.searchsorted(ends, bounds, "right")
    n = np.diff(firsts)
    n[full] += ~inside[tails]
    return ends, firsts, n


def _cuts(bounds: np.ndarray, ends: np.ndarray, firsts: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Where the first ``m`` units of each text end."""
    words = np.diff(firsts)
    known = np.append(ends, 0)
    end = known[np.clip(firsts[:-1] + np.minimum(m, words) - 1, 0, len(ends))]
    return np.where(m == 0, bounds[:-1], np.where(m <= words, end, bounds[1:]))


def transformed(texts: pa.Array, h: list[np.ndarray], rule: Rule) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The outputs, and of each text its units, form, and characters of prefix and middle."""
    data, bounds = shared.utf8(texts)
    ends, firsts, n = units(data, bounds)
    marked = np.zeros(len(texts), bool)
    for mark in (rule.prefix, rule.suffix, rule.middle):
        marked |= pc.fill_null(pc.match_substring(texts, mark), False).to_numpy(zero_copy_only=False)
    lo, hi = bounds[:-1], bounds[1:]
    form = np.where((lo == hi) | marked | (h[2] % 100 >= rule.cut), PLAIN, np.where(h[3] % 100 < rule.suffix_first, SPM, PSM))
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    one, two = (_cuts(bounds, ends, firsts, m) for m in (np.minimum(a, b), np.maximum(a, b)))

    p, s, m = (len(x) for x in rule.marks)
    plain, spm = form == PLAIN, form == SPM
    upto = np.concatenate([[0], np.cumsum(hi - lo + np.where(plain, 0, p + s + m))])
    begin = upto[:-1]
    # Where each part begins in the output.
    to_prefix = np.where(plain, begin, np.where(spm, begin + s + (hi - two) + p, begin + p))
    to_middle = np.where(plain, begin + (one - lo), np.where(spm, to_prefix + (one - lo) + m, begin + p + (one - lo) + s + (hi - two) + m))
    to_suffix = np.where(plain, begin + (two - lo), np.where(spm, begin + s, begin + p + (one - lo) + s))
    at = np.stack([lo, one, two], 1).ravel()
    shifts = np.stack([to_prefix - lo, to_middle - one, to_suffix - two], 1).ravel()
    out = scattered(data, at, np.diff(shifts, prepend=0), int(upto[-1]))
    for mark, place in zip(rule.marks, (to_prefix, to_suffix, to_middle), strict=True):
        for k, byte in enumerate(mark):
            out[place[~plain] - len(mark) + k] = byte

    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return strings(out, upto), n, form, chars[one] - chars[lo], chars[two] - chars[one]


def _marker_places(data: np.ndarray, mark: bytes, bounds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where the marker stands in each of the rows, which hold it once."""
    n = len(data) - len(mark) + 1
    found = data[: max(n, 0)] == mark[0]
    for k in range(1, len(mark)):
        found &= data[k : k + n] == mark[k]
    places = np.flatnonzero(found)
    at = np.searchsorted(places, bounds[rows])
    if len(rows) and (at >= len(places)).any() or (places[at] >= bounds[rows + 1]).any():
        raise ValueError("an output without its markers")
    return places[at]


def restored(outputs: pa.Array, form: np.ndarray, rule: Rule) -> pa.Array:
    """The exact texts, from outputs and forms alone."""
    data, bounds = shared.utf8(outputs)
    lo, hi = bounds[:-1], bounds[1:]
    rows = np.flatnonzero(form != PLAIN)
    p, s, m = (_marker_places(data, mark, bounds, rows) for mark in rule.marks)
    sizes = [len(x) for x in rule.marks]
    spm = form[rows] == SPM
    prefix = p + sizes[0], np.where(spm, m, s)
    middle = m + sizes[2], hi[rows]
    suffix = s + sizes[1], np.where(spm, p, m)
    length = hi - lo
    length[rows] -= sum(sizes)
    upto = np.concatenate([[0], np.cumsum(length)])
    # Plain texts are one part, the others three.
    at, source = [upto[:-1]], [lo.copy()]
    source[0][rows] = prefix[0]
    second = upto[:-1][rows] + (prefix[1] - prefix[0])
    at += [second, second + (middle[1] - middle[0])]
    source += [middle[0], suffix[0]]
    order = np.lexsort((np.concatenate([np.zeros(len(lo), int), np.ones(len(rows), int), np.full(len(rows), 2)]), np.concatenate([np.arange(len(lo)), rows, rows])))
    at, source = np.concatenate(at)[order], np.concatenate(source)[order]
    return strings(gathered(data, at, np.diff(source - at, prepend=0), int(upto[-1])), upto)


def fill_in_middle(docs: DataFrame, rule: Rule = Rule(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows, the text in its new form, with ``__n`` (units), ``__form``, and ``__prefix_chars`` and ``__middle_chars`` (NULL if plain).

    Units are words with the white space before them, and white space at the end. Draws
    from seed and id cut a text before any unit or at its end: the prefix ends at the
    smaller, the middle at the larger. A text is plain if it is empty, holds a marker, or
    by draw. NULL is an empty text. Rows without an id draw by the seed alone, rows that
    repeat an id draw the same numbers. An empty table gives none; other columns stay, and
    one that has a name of those added is an error.
    """
    shared.refuse(docs, ADDED)
    schema = ", ".join([*(f"`{name}` {kind}" for name, kind in docs.dtypes), "__n long, __form string, __prefix_chars long, __middle_chars long"])
    width = len(docs.columns)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text)
            for piece in shared.slices(batch, text, _SLICE):
                h = [c.to_numpy(zero_copy_only=False) for c in piece.columns[width:]]
                out, n, form, first, second = transformed(piece.column(place), h, rule)
                plain = form == PLAIN
                columns = [out.cast(c.type) if k == place else c for k, c in enumerate(piece.columns[:width])]
                columns += [pa.array(n.astype(np.int64)), pa.array(form.tolist(), pa.string()), *(pa.array(x.astype(np.int64), mask=plain) for x in (first, second))]
                yield pa.RecordBatch.from_arrays(columns, names=[*piece.schema.names[:width], *ADDED])

    return shared.in_batches(docs.select("*", *(h.alias(f"__h{k}") for k, h in enumerate(draws(F.col(id), rule.seed)))), move, schema)


def restore(outputs: DataFrame, rule: Rule = Rule(), text: str = "text", form: str = "__form") -> DataFrame:
    """All rows and columns, the text as it was before; from the output and its form alone."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text)
            for piece in shared.slices(batch, text, _SLICE):
                forms = np.array(shared.column(piece, form).to_pylist(), object)
                texts = restored(piece.column(place), forms, rule)
                yield pa.RecordBatch.from_arrays([texts.cast(c.type) if k == place else c for k, c in enumerate(piece.columns)], names=piece.schema.names)

    return shared.in_batches(outputs, back, ", ".join(f"`{name}` {kind}" for name, kind in outputs.dtypes))
