import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from annoframe.llm import attribution, packing, shared, token_files, tokens, wavelet
from tests.llm import cases

PATH = tokens.default_path()


FRESH = Tokenizer.from_file(PATH)


def ids(text):
    """By a tokenizer of the library with all its defaults."""
    return FRESH.encode(text or "", add_special_tokens=False).ids


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'sZ1²_\u0301 \n\té中\U0001f600.,\x1c\x85 <|>"), max_size=30), max_size=4))
def test_ids_are_those_of_the_whole_text(texts):
    coder = tokens.encoder(PATH)
    assert encoded(coder, texts) == [ids(t) for t in texts]


def test_strings_of_added_tokens():
    special = "<|endoftext|>"
    assert ids(special) == [50256]
    texts = [special, f"{special} at the start", f"at the end {special}", f"in{special}side", f"a {special} b", f"twice {special}{special} in a row", f"  {special}\n{special} ", f"{special[:-1]} cut", "none"]
    coder = tokens.encoder(PATH)
    assert encoded(coder, texts) == [ids(t) for t in texts]
    as_text = tokens.Encoder(PATH, special_as_text=True)
    assert all(50256 not in x for x in encoded(as_text, texts))
    assert [b"".join(as_text.entries()[i] for i in x).decode() for x in encoded(as_text, texts)] == texts


def encoded(coder, texts):
    every, bounds = coder.encode(pa.array(texts, pa.string()))
    return [every[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]


def test_ids_with_a_small_memory(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 20)
    monkeypatch.setattr(tokens, "REMEMBERED_PIECES", 2)
    texts = [cases.prose(k % 7, 40) for k in range(30)] + [None, *cases.odd_texts()[:20]]
    coder = tokens.Encoder(PATH)
    for at in range(0, len(texts), 5):
        assert encoded(coder, texts[at : at + 5]) == [ids(t) for t in texts[at : at + 5]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70000), max_size=200), st.integers(1, 20))
def test_wavelet_matrix(values, size):
    old, wavelet.BLOCK = wavelet.BLOCK, size
    try:
        matrix = wavelet.WaveletMatrix(wavelet.build(np.array(values, np.uint32), np.array([len(values)]), [None], 17))
    finally:
        wavelet.BLOCK = old
    assert matrix.tokens().tolist() == values and matrix.names == [None]
    for token in {*values[:5], 0, 1 << 20}:
        places = [k for k, v in enumerate(values) if v == token]
        assert matrix.count(token) == len(places)
        assert matrix.count(token, 3, max(3, len(values) // 2)) == sum(3 <= p < len(values) // 2 for p in places)
        assert [matrix.occurrence(token, k) for k in range(len(places))] == places
    assert [matrix.token(k) for k in range(len(values))] == values


def test_files_give_back_every_document(spark, monkeypatch):
    monkeypatch.setattr(token_files, "RANGE_BYTES", 40_000)
    rows = [*((k * 3 % 50, t) for k, t in enumerate(cases.odd_texts())), (None, "no id"), (None, None), (7, "again"), (7, "again")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(4)
    folder = shared.new_path(spark, "tokens")
    manifest = token_files.write_files(df, folder)
    got = sorted(((r["__start"], r["__id"], r["__n_tokens"], r["__crc32"], r["__ids"]) for r in token_files.read_files(spark, folder, manifest, with_ids=True).collect()))
    start, want = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        own = [*ids(text), 2]
        want.append((start, doc, len(own), crc(own), own))
        start += len(own)
    assert got == want


def packed(df):
    return [r.asDict() for r in df.collect()]


def check_packing(rows, out, capacity=2048):
    lengths = {}
    for doc, text in rows:
        own = [*ids(text), 0]
        pieces, first = [], len(own) % capacity or capacity
        for number, start in enumerate([0, *range(first, len(own), capacity)]):
            part = own[start : start + (capacity if number else first)]
            pieces.append((doc, number, start, len(part), crc(part)))
        for p in pieces:
            lengths[p] = lengths.get(p, 0) + 1
    for r in out:
        lengths[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] -= 1
    assert not any(lengths.values())
    sequences = {}
    for r in sorted(out, key=lambda r: r["offset"]):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(sequences.values()) <= capacity
    return len(sequences)


def test_every_piece_has_a_place(spark):
    rows = [*enumerate(cases.odd_texts()), (None, "no id"), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, piece int")
    n = check_packing(rows, packed(packing.pack(df)))
    total = sum(len(ids(t)) + 1 for _, t in rows)
    assert n <= -(-total // 2048) + 1


def test_packings_of_several_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 60)
    rows = [(k, cases.prose(k, 20 + 37 * k % 400)) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    n = check_packing(rows, packed(packing.pack(df)))
    assert n <= 1.05 * packing.least_bins(np.array([len(ids(t)) + 1 for _, t in rows]), 2048) + 4


def valid(sizes, bins, capacity):
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= capacity for b in bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=40), st.integers(0, 10**6))
def test_evolution_keeps_every_document(sizes, seed):
    one = packing.best_fit(sizes, list(range(len(sizes))), [], 100)
    valid(sizes, one, 100)
    draw = np.random.default_rng(seed)
    other = packing.best_fit(sizes, draw.permutation(len(sizes)).tolist(), [], 100, as_given=True)
    valid(sizes, packing.crossed(sizes, one, other, 100, draw), 100)
    valid(sizes, packing.mutated(sizes, one, 100, draw), 100)
    best = packing.evolve(sizes, [one, other], 100, seed)
    valid(sizes, best, 100)
    assert packing.least_bins(np.array(sizes), 100) <= len(best) <= min(len(one), len(other))


def test_evolution_beats_best_fit():
    """Triplets that fill every bin exactly: largest first leaves room that evolution finds."""
    better = worse = 0
    for seed in range(6):
        draw = np.random.default_rng(seed)
        sizes = []
        for _ in range(20):
            a = int(draw.integers(380, 490))
            b = int(draw.integers(250, 1000 - a - 250 + 1))
            sizes += [a, b, 1000 - a - b]
        first = packing.best_fit(sizes, list(range(60)), [], 1000)
        bins = first
        for turn in range(8):
            bins = packing.evolve(sizes, [bins, first], 1000, turn)
        better += len(bins) < len(first)
        worse += len(bins) > len(first)
    assert better > 0 and not worse


@pytest.mark.parametrize("rule", attribution.RULES)
def test_tokens_by_section(spark, rule):
    rows = [(k, t, None if k % 4 == 0 else f"s{k}") for k, t in enumerate(cases.odd_texts()) if k != 25]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, n_tokens int")
    out = attribution.attribute(df, ("source", "text"), rule=rule).collect()
    coder = tokens.encoder(PATH)
    for doc, text, source in rows:
        whole = (source or "") + "\n" + (text or "")
        own = sorted((r for r in out if r["doc_id"] == doc), key=lambda r: (r["field"] == "text", r["section"]))
        assert [r["field"] for r in own] == ["source"] + ["text"] * ((text or "").count("\n") + 1)
        assert [r["start"] for r in own] == [0, *(r["end"] for r in own[:-1])] and own[-1]["end"] == len(whole)
        assert sum(r["n_tokens"] for r in own) == len(ids(whole))
        if whole.isascii():  # elsewhere a token may be a part of a character
            spans = coder.tokenizer.encode(whole, add_special_tokens=False).offsets
            want = [0] * len(own)
            for a, b in spans:
                overlap = [max(0, min(b, r["end"]) - max(a, r["start"])) for r in own]
                want[next(k for k, o in enumerate(overlap) if o) if rule == "first" else overlap.index(max(overlap))] += 1
            assert [r["n_tokens"] for r in own] == want
