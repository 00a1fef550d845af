import hashlib
import itertools
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from annoframe.llm import alignment
from tests.llm import cases

PATH_A, PATH_B = alignment.default_paths()
BYTE_LEVEL, PIECES = Tokenizer.from_file(PATH_A), SentencePieceProcessor(model_file=PATH_B)
BYTE_LEVEL.encode_special_tokens = True
ODD = [
    "<s> a </s> <unk> <0x41> <|endoftext|>", "a▁b", " leading", "trailing ", "two  spaces   three", "\ttabs\t\tand\r\nlines\n\n", "　ideographic \xa0nbsp", "ﬁ ligature Å",
    "中文 \U0001f600\U0001f600 mixed é é", "a\x00b", "x" * 300, " ", "   ", "word", "▁", "ends with blank▁",
]


def byte_of():
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


BYTE_OF = byte_of()


def sides(text):
    """(id, bytes) of all tokens of both sides, by the libraries alone; empty where they don't give back the text."""
    if not text:
        return [], []
    a = [(i, bytes(BYTE_OF[c] for c in BYTE_LEVEL.id_to_token(i))) for i in BYTE_LEVEL.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in PIECES.encode(text):
        piece = PIECES.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if PIECES.is_byte(i) else piece.replace("▁", " ").encode()))
    given_bytes = (" " + text).encode()
    return (a, b) if all(b"".join(x[1] for x in side) == given_bytes for side in (a, b)) else ([], [])


def spans(side):
    ends = list(itertools.accumulate(len(raw) for _, raw in side))
    return [(i, end - len(raw), end) for (i, raw), end in zip(side, ends, strict=True)]


def plain(texts):
    """The contract's columns of each text, by comparing every token with every other one."""
    every = [[spans(s) for s in sides(t)] for t in texts]
    linked = [[(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] for a, b in every]
    counts = Counter(pair for row in linked for pair in row)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (a, b), links in zip(every, linked, strict=True):
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, low = [], 0
        for cut in cuts:
            groups.append(",".join(str(x[0]) for x in a if low < x[2] <= cut) + "|" + ",".join(str(y[0]) for y in b if low < y[2] <= cut))
            low = cut
        text = ";".join(groups)
        out.append((len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'sZ1²_́ \n\té中\U0001f600.,\x1c\x85 <|>▁"), max_size=30), max_size=4))
def test_pieces_are_those_of_the_whole_text(texts):
    coder = alignment.encoder(PATH_B)
    ids, bounds = coder.encode(pa.array([" " + t for t in texts], pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [PIECES.encode(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.booleans()), max_size=200))
def test_diagonal_finds_all_common_ends(marks):
    marks = [*marks, (True, True)]
    a, b = (np.array([k + 1 for k, m in enumerate(marks) if m[side]]) for side in (0, 1))
    group_a, group_b = alignment.diagonal(a, b)
    common = np.intersect1d(a, b)
    assert a[np.cumsum(group_a) - 1].tolist() == b[np.cumsum(group_b) - 1].tolist() == common.tolist()
    assert group_a.sum() == len(a) and group_b.sum() == len(b)


def test_diagonal_of_long_runs_and_none():
    ends = np.arange(1, 100_001) * 3
    other = np.delete(ends, [50, 51, 7000, 99_990])
    group_a, group_b = alignment.diagonal(ends, other)
    assert group_a.sum() == 100_000 and group_b.sum() == 99_996 and group_a.max() == 3 and group_b.max() == 1
    assert [len(x) for x in alignment.diagonal(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]
    with pytest.raises((ValueError, IndexError)):
        alignment.diagonal(np.array([2, 4]), np.array([2, 4, 6]))


def test_walks_side_by_side_beat_token_by_token():
    """Groups of some tokens each, as two tokenizers make them: many short runs."""
    draw = np.random.default_rng(4)
    ends = np.cumsum(draw.integers(1, 6, 300_000))
    a, b = (np.append(ends[draw.random(len(ends)) < 0.75], ends[-1] + 3) for _ in range(2))
    began = time.process_time()
    group_a, group_b = alignment.diagonal(a, b)
    took = time.process_time() - began
    began = time.process_time()
    common, x, y, list_a, list_b = [], 0, 0, a.tolist(), b.tolist()
    while x < len(list_a):
        if list_a[x] == list_b[y]:
            common.append(list_a[x])
            x, y = x + 1, y + 1
        elif list_a[x] < list_b[y]:
            x += 1
        else:
            y += 1
    plain_took = time.process_time() - began
    assert a[np.cumsum(group_a) - 1].tolist() == b[np.cumsum(group_b) - 1].tolist() == common
    assert took < plain_took


def test_groups_as_text():
    draw = np.random.default_rng(6)
    group_a, group_b = (draw.integers(1, 4, 500) for _ in range(2))
    a, b = (draw.integers(0, 10 ** draw.integers(1, 7, g.sum())) for g in (group_a, group_b))
    groups = np.array([0, 1, 120, 0, 0, 379, 0])
    raw, bounds = alignment._written(a, b, group_a, group_b, groups)
    cut_a, cut_b = (np.split(v, np.cumsum(g)[:-1]) for v, g in ((a, group_a), (b, group_b)))
    every = [",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in zip(cut_a, cut_b, strict=True)]
    upto = np.concatenate([[0], np.cumsum(groups)])
    assert [raw[x:y].tobytes().decode() for x, y in zip(bounds, bounds[1:], strict=False)] == [";".join(every[x:y]) for x, y in zip(upto, upto[1:], strict=False)]


@pytest.mark.parametrize("broadcast", [2_000_000, 3])
def test_documents_equal_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(alignment, "BROADCAST_ROWS", broadcast)
    texts = [*(t for t in cases.odd_texts() if t is None or len(t) < 3000), *ODD, *(cases.prose(k, 30 + k) for k in range(12)), cases.prose(3, 33)]
    rows = [*enumerate(texts), (None, "no id"), (3, "again"), (3, "again")]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_a int, `__row` string").repartition(4)
    got = sorted((tuple(r[c] for c in ("doc_id", *alignment.SUMMARY)) for r in alignment.aligned_documents(df).collect()), key=str)
    assert got == sorted(((doc, *rest) for (doc, _), rest in zip(rows, plain([t for _, t in rows]), strict=True)), key=str)
    assert sum(r[1] == 0 for r in got) == 5


def test_small_gathers_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "_SLICE", 4000)
    rows = [(k, cases.prose(k, 400)) for k in range(6)] + [(9, "\n".join(["One line again and again."] * 300))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted(tuple(r[c] for c in ("doc_id", *alignment.SUMMARY)) for r in alignment.aligned_documents(df).collect())
    assert got == [(doc, *rest) for (doc, _), rest in zip(rows, plain([t for _, t in rows]), strict=True)]
