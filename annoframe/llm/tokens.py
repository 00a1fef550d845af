"""Token ids of whole texts, by the tokenizers library.

A byte-level BPE never merges across a single space between two printable characters. So
texts are cut there, the different words of a batch are looked up once, and only words
that a worker has not met are encoded; arrays then put the ids of each text together.
Texts with any other kind of space at a cut, or with the string of an added token, are
encoded as they are. The ids are those of the whole text; ``tests/llm`` compares both. Words of a batch are told apart by 64-bit
hashes, remembered ones by 128 bits.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from annoframe.llm import shared
from annoframe.llm.words import byte_table, other_hashes, words_of

#: Words that a worker remembers (about 40 bytes each) before it starts anew, and pieces of words.
REMEMBERED = 2_000_000
REMEMBERED_PIECES = 100_000
#: Words encoded in one text, and texts in one call.
_TOGETHER, _CALLS = 512, 16

_NOT_BLANK = ~byte_table(b" ")
_GRAPHIC = byte_table(bytes(range(0x21, 0x7F)))
#: First bytes of the letters from U+00C0 to U+023F, which have two.
_LATIN = byte_table(bytes(range(0xC3, 0xC9)))
#: A byte-level vocabulary writes a byte as itself if it is printable, and the others in order from U+0100.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_WRITTEN = {b: 0x100 + k for k, b in enumerate(b for b in range(0x100) if b not in set(_PRINTABLE))}
_SPACE = chr(_WRITTEN[0x20])
#: Signs that may follow a word in one piece of their own.
_SIGNS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27)
#: Pieces that the pre-tokenizer makes of a word: letters, signs but for the apostrophe, a lone line break.
_PIECES = re.compile(r"[^\W\d_]+|[!-&(-/:-@\[-`{-~]+|(?<!\n)\n(?!\n)")

_ENCODERS: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Starts, ends and hashes of the words of all texts, and the first word of every text."""
    return words_of(*shared.utf8(texts), _NOT_BLANK, lower=False)


class Encoder:
    """One tokenizer of a worker process, and the words it has met.

    The strings of added tokens in a text are those tokens, as the library has it by
    default, or plain text with ``special_as_text``.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.added = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        #: Tokens that begin with a space: in " a b c" each begins a word.
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith(_SPACE) for i in range(size)])
        self._forget()
        self.pieces: dict[str, bytes] = {}
        if self._cut("Éaß.") != self.plain(" Éaß."):
            raise ValueError("not a byte-level tokenizer")

    def widths(self) -> np.ndarray:
        """The bytes that each token covers: a byte-level vocabulary writes one character for each."""
        return np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())])

    def entries(self) -> list[bytes]:
        """The bytes of each token."""
        byte_of = {chr(b): b for b in _PRINTABLE} | {chr(c): b for b, c in _WRITTEN.items()}
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        return [bytes(map(byte_of.__getitem__, name)) if all(c in byte_of for c in name) else name.encode() for name in names]

    def plain(self, text: str) -> bytes:
        """The ids of a text as bytes, by the library alone."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _piece(self, text: str) -> bytes | None:
        """The ids of one piece, by the model alone; None if it isn't what it seems."""
        bare = text.removeprefix(" ")
        if not bare.isalpha() and not (bare.isascii() and not any(map(str.isalnum, bare))):
            return None
        written = text.replace(" ", _SPACE) if text.isascii() and "\n" not in text else text.encode().decode("latin-1").translate(_WRITTEN)
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(written)]).tobytes()

    def _cut(self, word: str) -> bytes | None:
        """The ids of a space and a word; None where its pieces aren't plain to see."""
        parts = _PIECES.findall(word)
        if sum(map(len, parts)) != len(word):
            return None
        parts[0] = " " + parts[0]
        if len(parts) == 1:
            return self._piece(parts[0])
        out = []
        for part in parts:
            ids = self.pieces.get(part)
            if ids is None:
                ids = self._piece(part)
                if ids is None:
                    return None
                self.pieces[part] = ids
            out.append(ids)
        return b"".join(out)

    def _forget(self) -> None:
        #: Both hashes of the words met, by the first; where their ids begin in ``flat``, and how many they are.
        self.hashes, self.others = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.begins, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, self.kind)

    def _learned(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word with a space before it."""
        if len(self.pieces) > REMEMBERED_PIECES:
            self.pieces = {}
        tokenize, code = self.tokenizer.model.tokenize, self.code
        out: list[bytes | None] = []
        mixed = []
        for at, raw in enumerate(words):
            stem = raw if raw.isalpha() else raw.rstrip(_SIGNS)
            if stem.isalpha():  # ASCII letters, and signs perhaps: the most frequent kinds
                ids = array(code, [t.id for t in tokenize(_SPACE + stem.decode())]).tobytes()
                if stem is not raw and len(stem) < len(raw):
                    tail = raw[len(stem) :].decode()
                    if tail not in self.pieces:
                        self.pieces[tail] = self._piece(tail)
                    ids += self.pieces[tail]
            else:
                ids = self._cut(raw.decode())
                if ids is None:
                    mixed.append((at, raw.decode()))
            out.append(ids)
        runs = [mixed[k : k + _TOGETHER] for k in range(0, len(mixed), _TOGETHER)]
        for first in range(0, len(runs), _CALLS):
            texts = [" " + " ".join(word for _, word in run) for run in runs[first : first + _CALLS]]
            for run, found in zip(runs[first:], self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=False):
                ids = np.array(found.ids, self.kind)
                cuts = np.flatnonzero(self.opens[ids]).tolist()
                if len(cuts) != len(run):
                    raise ValueError("a tokenizer that doesn't begin words with a space")
                blob, size = ids.tobytes(), self.kind.itemsize
                bounds = [size * c for c in cuts] + [len(blob)]
                for (at, _), a, b in zip(run, bounds, bounds[1:], strict=False):
                    out[at] = blob[a:b]
        return out

    def _ids(self, data: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``flat`` the ids of each word begin, and how many they are; words in order of their hashes, each once."""
        if len(self.hashes) > REMEMBERED:
            self._forget()
        others = other_hashes(data, starts, ends)
        at = np.searchsorted(self.hashes, hashes)
        near = np.minimum(at, max(len(self.hashes) - 1, 0))
        same = self.hashes[near] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        hit = same & (self.others[near] == others) if len(self.hashes) else same
        begins, sizes = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int32)
        begins[hit], sizes[hit] = self.begins[near[hit]], self.sizes[near[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            found = self._learned([raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            sizes[new] = np.array([len(x) for x in found], np.int32) // self.kind.itemsize
            begins[new] = len(self.flat) + np.concatenate([[0], np.cumsum(sizes[new][:-1], dtype=np.int64)])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(found), self.kind)])
            keep = new[~same[new]]  # a word whose first hash stands for another one is not remembered
            places = at[keep]
            self.hashes, self.others = np.insert(self.hashes, places, hashes[keep]), np.insert(self.others, places, others[keep])
            self.begins, self.sizes = np.insert(self.begins, places, begins[keep]), np.insert(self.sizes, places, sizes[keep])
        return begins, sizes

    def odd(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        """Words whose text has to be encoded as a whole: they begin or end with other than plain signs, or follow several spaces."""
        head, tail, second = data[starts], data[ends - 1], data[np.maximum(ends - 2, 0)]
        return ~((_GRAPHIC[head] | _LATIN[head]) & (_GRAPHIC[tail] | (((tail & 0xC0) == 0x80) & _LATIN[second]))) | (gaps > 1)

    def encode(self, texts: pa.Array, words: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the bounds between them (one more than texts); NULL has none.

        ``words``: what :func:`cut` gives for these texts, where several encoders need it.
        """
        data, bounds = shared.utf8(texts)
        starts, ends, hashes, firsts = words or cut(texts)
        counts, n = np.diff(firsts), len(texts)
        # The space before each word; the first of a text may have none.
        gaps = starts - np.concatenate([[0], ends[:-1]])
        leads = firsts[:-1][counts > 0]
        gaps[leads] = starts[leads] - bounds[:-1][counts > 0]
        simple = np.diff(np.concatenate([[0], np.cumsum(self.odd(data, starts, ends, gaps))])[firsts]) == 0
        simple[counts > 0] &= ends[firsts[1:][counts > 0] - 1] == bounds[1:][counts > 0]
        simple[counts == 0] = np.diff(bounds)[counts == 0] == 0
        for string in self.added:
            simple &= ~pc.fill_null(pc.match_substring(texts, string), False).to_numpy(zero_copy_only=False)

        raw = data.tobytes()
        used = np.repeat(simple, counts)
        bare = used & (gaps == 0)
        spaced = np.flatnonzero(used & ~bare)
        values, first, inverse = np.unique(hashes[spaced], return_index=True, return_inverse=True)
        sample = spaced[first]
        begins, size = self._ids(data, raw, starts[sample], ends[sample], values)
        # Words without a space before them, and whole texts that can't be cut, are entries of their own.
        single, whole = np.flatnonzero(bare), np.flatnonzero(~simple)
        extra = [self.plain(raw[a:b].decode()) for a, b in zip(starts[single].tolist(), ends[single].tolist(), strict=True)]
        extra += [self.plain(raw[a:b].decode("utf-8", "replace")) for a, b in zip(bounds[whole].tolist(), bounds[whole + 1].tolist(), strict=True)]
        more = np.array([len(x) for x in extra], np.int64) // self.kind.itemsize
        flat = np.concatenate([self.flat, np.frombuffer(b"".join(extra), self.kind)])
        begins = np.concatenate([begins, len(self.flat) + np.cumsum(more) - more])
        size = np.concatenate([size, more])

        entry = np.full(len(starts), -1, np.int64)
        entry[spaced] = inverse
        entry[single] = len(first) + np.arange(len(single))
        entries = entry[used]
        per_text = np.where(simple, counts, 0)
        if len(whole):
            places = np.concatenate([[0], np.cumsum(per_text)])[whole]
            entries = np.insert(entries, places, len(first) + len(single) + np.arange(len(whole)))
            per_text[whole] = 1
        lengths = size[entries]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ids = flat[np.repeat(begins[entries] - upto[:-1], lengths) + np.arange(upto[-1])]
        return ids, upto[np.concatenate([[0], np.cumsum(per_text)])]


def encoder(path: str) -> Encoder:
    """The tokenizer of this worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
