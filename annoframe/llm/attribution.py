"""Tokens of whole documents, attributed to fields and sections.

The fields of a row are joined to one document, which is encoded once. Each token covers
as many bytes as its entry of a byte-level vocabulary, so running sums give the span of
every token. Sections are spans too, and both meet in an interval join by binary search.
A token over a boundary is allocated by a rule, so that the counts of all sections add up
to those of the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from annoframe.llm import shared, tokens

#: ``first``: to the section with the token's first byte; ``most``: to that with most of its bytes, of equals the first.
RULES = ("first", "most")
_SLICE = 2 << 20


def joined(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> np.ndarray:
    """The number of tokens of each section; both cover the same text without gaps."""
    starts = np.concatenate([[0], token_ends[:-1]])
    of = np.searchsorted(section_ends, starts, "right")
    if rule == "most":
        last = np.searchsorted(section_ends, token_ends - 1, "right")
        for k in np.flatnonzero(last > of).tolist():
            edges = [int(starts[k]), *section_ends[of[k] : last[k]].tolist(), int(token_ends[k])]
            of[k] += int(np.argmax(np.diff(edges)))
    return np.bincount(of, minlength=len(section_ends))


def attribute(
    docs: DataFrame, fields: tuple[str, ...], sections_of: str = "text", rule: str = "first", tokenizer: str | None = None, id: str = "doc_id", separator: str = "\n"
) -> DataFrame:
    """One row per section: id, ``field``, ``section`` (from 0), ``start`` and ``end`` in characters of the joined document, ``n_tokens``.

    The document is the fields' texts with ``separator`` between them. Field ``sections_of``
    is cut into lines, each with its line break; every other field is one section. A
    separator belongs to the section before it. NULL and empty fields are empty sections
    of no tokens but for their separator. Counts of a row add up to the tokens of its
    document. Rows that repeat an id are counted each for itself.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    tokenizer = tokenizer or tokens.default_path()
    plain = docs.select(id, *[docs[f].cast("string").alias(f"__{f}") for f in fields])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(tokenizer)
        widths = coder.widths()
        for batch in batches:
            for piece in shared.slices(batch, f"__{sections_of}", _SLICE):
                values = [[t or "" for t in shared.column(piece, f"__{f}").to_pylist()] for f in fields]
                texts = [separator.join(row) for row in zip(*values, strict=True)]
                rows, names, numbers, starts, ends, counts = [], [], [], [], [], []
                every, bounds = coder.encode(pa.array(texts, pa.large_string()))
                for row, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)):
                    parts = []
                    for k, f in enumerate(fields):
                        value = values[k][row] + (separator if k + 1 < len(fields) else "")
                        lines = value.split("\n") if f == sections_of else [value]
                        lines = [line + "\n" for line in lines[:-1]] + lines[-1:] if f == sections_of else lines
                        parts += [(f, number, line) for number, line in enumerate(lines)]
                    bytes_upto = np.cumsum([len(p[2].encode()) for p in parts])
                    chars_upto = np.cumsum([len(p[2]) for p in parts])
                    found = joined(np.cumsum(widths[every[a:b]]), bytes_upto, rule)[: len(parts)]
                    rows += [row] * len(parts)
                    names += [p[0] for p in parts]
                    numbers += [p[1] for p in parts]
                    ends.append(chars_upto), starts.append(chars_upto - [len(p[2]) for p in parts]), counts.append(found)
                ids = piece.column(0).take(pa.array(rows, pa.int64()))
                spans = [pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)) for x in (starts, ends, counts)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(names, pa.string()), pa.array(numbers, pa.int32()), *spans], names=[id, "field", "section", "start", "end", "n_tokens"])

    return shared.in_batches(plain, count, f"`{id}` {dict(docs.dtypes)[id]}, field string, section int, start long, end long, n_tokens long")
