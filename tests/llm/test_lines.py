import hashlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from annoframe.llm import lines
from tests.llm import cases

SCHEMA = "doc_id long, text string, n_lines string, `__key` int"


def digest(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def result(df):
    return sorted(((r["doc_id"], r["__n_lines"], r["__n_dropped"], digest(r["text"])) for r in df.collect()), key=str)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    line = "a line of at least forty code points that repeats"
    rows = [(None, line), (None, line), (1, line), (1, line), (2, line + "  "), (3, line.upper()), (4, None), (5, "x\n" + line), (6, "")]
    df = spark.createDataFrame([(*r, "other", 7) for r in rows], SCHEMA)
    out = lines.dedup_lines(df)
    assert out.columns == [*df.columns, "__n_lines", "__n_dropped"]
    assert result(out) == sorted(cases.lines_plain(rows), key=str)
    assert {r["n_lines"] for r in out.collect()} == {"other"}
    assert [r["text"] for r in out.where("doc_id = 4").collect()] == [None]


@pytest.mark.parametrize(("bits", "hot"), [(8, 1000), (1 << 12, 3), (1 << 12, 1000)])
def test_full_filters_and_hot_keys_change_no_result(spark, monkeypatch, bits, hot):
    monkeypatch.setattr(lines, "HOT_KEYS", hot)
    rows = list(enumerate(cases.odd_texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert result(lines.dedup_lines(df, bits=bits)) == sorted(cases.lines_plain(rows), key=str)


@given(st.lists(st.integers(0, 2**64 - 1), max_size=60))
def test_filters_forget_nothing(values):
    hashes, bitmap = np.array(values, np.uint64), np.zeros(64, np.uint8)
    lines._put(bitmap, lines._places(hashes, 512))
    assert lines.holds(bitmap, hashes).all()


def test_folding_sees_what_stands_in_two_parts():
    one, two = np.zeros(64, np.uint8), np.zeros(64, np.uint8)
    hashes = np.array([12345678901234567], np.uint64)
    for bitmap in (one, two):
        lines._put(bitmap, lines._places(hashes, 512))
    empty = np.zeros(64, np.uint8)
    (folded,) = lines._folded(iter([lines._chunks(one, empty), lines._chunks(two, empty)]))
    import zlib

    assert lines.holds(np.frombuffer(zlib.decompress(folded.column(1)[0].as_py()), np.uint8), hashes).all()
