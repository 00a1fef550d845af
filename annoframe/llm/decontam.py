"""Find and remove passages of benchmark items.

All normalised items go into one generalised suffix automaton over word hashes. Each
document's words are streamed through it; the state tells the longest run ending here
that stands in some item. Runs of words that no item has in a row cannot hold a window,
so numpy cuts the stream at them first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoframe.llm import shared
from annoframe.llm.words import ALPHANUMERIC, runs, words_of

WINDOW = 10
#: Most words of items in one automaton; more items make more automata, whose hits are put together.
AUTOMATON_WORDS = 2_000_000


@dataclass
class Automaton:
    """Generalised suffix automaton: states by number, the root is 0."""

    window: int
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    length: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])
    #: Items whose window or whole short text ends in the state, by the length of that window.
    ends: dict[int, dict[int, set]] = field(default_factory=dict)
    vocabulary: np.ndarray | None = None
    pairs: np.ndarray | None = None
    #: Sizes of windows, rising.
    sizes: list[int] = field(default_factory=list)

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves), self.length.append(length), self.link.append(link)
        return len(self.next) - 1

    def _extend(self, last: int, word: int) -> int:
        """The state of the text so far and this word, from the state of the text so far."""
        there = self.next[last].get(word)
        if there is not None and self.length[there] == self.length[last] + 1:
            return there
        state = self._state(self.length[last] + 1, 0, {}) if there is None else None
        at = last
        while at != -1 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at == -1:
            return state
        target = self.next[at][word]
        if self.length[target] == self.length[at] + 1:
            link = target
        else:
            link = self._state(self.length[at] + 1, self.link[target], dict(self.next[target]))
            while at != -1 and self.next[at].get(word) == target:
                self.next[at][word] = link
                at = self.link[at]
            self.link[target] = link
        if state is None:
            return link
        self.link[state] = link
        return state

    def step(self, state: int, matched: int, word: int) -> tuple[int, int]:
        """The state of the longest run ending with this word that stands in an item, and its length."""
        while state and word not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        there = self.next[state].get(word)
        return (0, 0) if there is None else (there, matched + 1)

    def suffix(self, state: int, size: int) -> int:
        """The state of the last ``size`` words of a run that has at least as many."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    @classmethod
    def of(cls, items: list[tuple[object, np.ndarray]], window: int = WINDOW) -> Automaton:
        """Of (item id, word hashes); items without words are left out."""
        made = cls(window)
        items = [(name, words.tolist()) for name, words in items if len(words)]
        for _, words in items:
            state = 0
            for word in words:
                state = made._extend(state, word)
        for name, words in items:
            size, state, matched = min(window, len(words)), 0, 0
            for word in words:
                state, matched = made.step(state, matched, word)
                if matched >= size:
                    made.ends.setdefault(made.suffix(state, size), {}).setdefault(size, set()).add(name)
        made.vocabulary = np.unique(np.array([w for _, words in items for w in words], np.uint64))
        both = [runs(np.array(words, np.uint64), 2) for _, words in items]
        made.pairs = np.unique(np.concatenate(both)) if both else np.zeros(0, np.uint64)
        return made

    def seal(self) -> Automaton:
        self.sizes = sorted({size for by in self.ends.values() for size in by})
        return self

    def stretches(self, hashes: np.ndarray, firsts: np.ndarray) -> list[tuple[int, int]]:
        """The stretches of words that may hold a window: in each, every two words in a row do so in an item.

        ``firsts``: the first word of every text; no stretch crosses into the next text.
        """
        if not self.sizes or not len(hashes):
            return []
        if self.sizes[0] == 1:
            flags, more = _member(self.vocabulary, hashes), 0
            cuts = np.unique(firsts[(firsts > 0) & (firsts < len(hashes))])
        else:
            flags, more = _member(self.pairs, runs(hashes, 2)), 1
            flags[firsts[(firsts > 0) & (firsts < len(hashes))] - 1] = False
            cuts = np.zeros(0, np.int64)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]])))
        out = []
        for start, stop in zip(edges[::2].tolist(), (edges[1::2] + more).tolist(), strict=True):
            bounds = [start, *cuts[(cuts > start) & (cuts < stop)].tolist(), stop] if len(cuts) else [start, stop]
            out += [(x, y) for x, y in zip(bounds, bounds[1:], strict=False) if y - x >= self.sizes[0]]
        return out

    def hits(self, hashes: np.ndarray, start: int, stop: int) -> Iterator[tuple[int, int, set]]:
        """(end, size, items) of every window that lies in the stretch; the end is exclusive."""
        state = matched = 0
        for at, word in enumerate(hashes[start:stop].tolist(), start + 1):
            state, matched = self.step(state, matched, word)
            for size in self.sizes:
                if size > matched:
                    break
                found = self.ends.get(self.suffix(state, size), {}).get(size)
                if found:
                    yield at, size, found


def _member(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def words_in(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return words_of(*shared.utf8(texts), ALPHANUMERIC, lower=True)


def automata(items: DataFrame, id: str = "item_id", text: str = "text", window: int = WINDOW, most: int = AUTOMATON_WORDS) -> Iterator[Automaton]:
    """Automata over all items, each of about ``most`` words; items without text or without words are left out."""
    group, size = [], 0
    for row in items.select(F.col(id).cast("string"), F.col(text)).where(F.col(text).isNotNull()).toLocalIterator():
        words = words_in(pa.array([row[1]], pa.string()))[2]
        group.append((row[0], words))
        size += len(words)
        if size >= most:
            yield Automaton.of(group, window).seal()
            group, size = [], 0
    if group or size == 0:
        yield Automaton.of(group, window).seal()


def scan(automaton: Automaton, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, set]]:
    """Word starts, ends, first words of the texts, the hit words, and the items of each text that has any."""
    starts, ends, hashes, firsts = words_in(texts)
    hit = np.zeros(len(hashes), bool)
    items: dict[int, set] = {}
    for start, stop in automaton.stretches(hashes, firsts):
        for end, size, found in automaton.hits(hashes, start, stop):
            hit[end - size : end] = True
            items.setdefault(int(np.searchsorted(firsts, end - 1, "right")) - 1, set()).update(found)
    return starts, ends, firsts, hit, items


def spans_of(hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words, as (first, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def find_items(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents with what they hold of the items.

    Words are runs of ASCII letters, digits and all characters beyond ASCII, A-Z
    lower-cased. A window is ``window`` words in a row of an item; a shorter item is one
    window. All columns return, with ``__n_words``, ``__n_hit`` (words inside windows),
    ``__items`` (ids as sorted strings) and ``__spans`` (first and end word of each run
    of hit words, in pairs).

    NULL and empty texts have no words. Items without words match nothing; an item
    without an id marks words and is not listed; items that repeat an id are one item.
    Without items nothing is hit. Repeated documents each get their own row.
    """
    columns = docs.columns
    schema = [f"`{name}` {kind}" for name, kind in docs.dtypes]
    spark = docs.sparkSession
    shared.ship(spark)
    for turn, automaton in enumerate(automata(items, item_id, item_text, window)):
        docs = shared.in_batches(docs, _marking(spark.sparkContext.broadcast(automaton), text, len(columns), bool(turn)), ", ".join([*schema, "__n_words long, __n_hit long, __items array<string>, __spans array<long>"]))
    return docs


def _marking(automaton, text: str, width: int, again: bool):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in shared.slices(batch, text):
                _, _, firsts, hit, items = scan(automaton.value, shared.column(piece, text))
                before = [c.to_pylist() for c in piece.columns[width:]] if again else None
                n_words, n_hit, names, spans = [], [], [], []
                for row, (lo, hi) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)):
                    mine, found = hit[lo:hi], items.get(row, set()) - {None}
                    if again:
                        found = found | set(before[2][row])
                        for x, y in zip(before[3][row][::2], before[3][row][1::2], strict=True):
                            mine[x:y] = True
                    n_words.append(hi - lo), n_hit.append(int(mine.sum())), names.append(sorted(found))
                    spans.append([x for span in spans_of(mine) for x in span] if n_hit[-1] else [])
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:width], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64()))],
                    names=[*piece.schema.names[:width], "__n_words", "__n_hit", "__items", "__spans"],
                )

    return mark


def without_spans(text: bytes, automaton: Automaton, longest: int, others: Sequence[Automaton] = ()) -> tuple[bytes, int]:
    """The text without runs of ``longest`` words or more that any automaton hits, and the number of words that went; what closes up is scanned again by all."""
    gone = 0
    while True:
        starts, ends, _, hit, _ = scan(automaton, given := pa.array([text], pa.binary()).cast(pa.string()))
        for other in others:
            hit |= scan(other, given)[3]
        doomed = [(a, b) for a, b in spans_of(hit) if b - a >= longest]
        if not doomed:
            return text, gone
        out, at = [], 0
        for a, b in doomed:
            out.append(text[at : starts[a]])
            at, gone = ends[b - 1], gone + b - a
        text = b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, longest: int = 1, coverage: float = 0.5) -> DataFrame:
    """The documents without the passages that stand in items.

    Runs of ``longest`` hit words or more are cut out of the text (a run has at least a
    window's words, or those of a whole short item). A document of whose words more than
    the share ``coverage`` is hit goes altogether. All other rows and columns stay as
    they are; NULL and empty texts stay. Without items nothing changes. What is cut does
    not depend on how the items are dealt to automata.
    """
    schema = ", ".join(f"`{name}` {kind}" for name, kind in docs.dtypes)
    spark = docs.sparkSession
    shared.ship(spark)
    given = [spark.sparkContext.broadcast(automaton) for automaton in automata(items, window=window)]
    return shared.in_batches(docs, _cleaning(given, text, longest, coverage), schema)


def _cleaning(given: list, text: str, longest: int, coverage: float):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, *others = (automaton.value for automaton in given)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for piece in shared.slices(batch, text):
                _, _, firsts, _, items = scan(first, piece.column(at))
                hit = sorted(set(items).union(*(scan(other, piece.column(at))[4] for other in others)))
                if not hit:
                    yield piece
                    continue
                texts, stay = piece.column(at).cast(pa.binary()).to_pylist(), np.ones(piece.num_rows, bool)
                for row in hit:
                    texts[row], gone = without_spans(texts[row], first, longest, others)
                    stay[row] = gone <= coverage * (firsts[row + 1] - firsts[row])
                columns = [pa.array(texts, pa.binary()).cast(c.type) if k == at else c for k, c in enumerate(piece.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=piece.schema.names).filter(pa.array(stay))

    return clean
