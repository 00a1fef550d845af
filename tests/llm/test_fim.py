import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from annoframe.llm import fim
from tests.llm import cases

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plain(doc, text, rule=fim.Rule()):
    """(units, form, output, characters of prefix and middle) of one text."""
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{rule.seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    one, two = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in (rule.prefix, rule.suffix, rule.middle)) or h[2] % 100 >= rule.cut:
        return len(units), "plain", text, None, None
    prefix, middle, suffix = ("".join(units[a:b]) for a, b in ((0, one), (one, two), (two, len(units))))
    if h[3] % 100 < rule.suffix_first:
        return len(units), "spm", rule.suffix + suffix + rule.prefix + prefix + rule.middle + middle, len(prefix), len(middle)
    return len(units), "psm", rule.prefix + prefix + rule.suffix + suffix + rule.middle + middle, len(prefix), len(middle)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 500), st.text(st.sampled_from("ab <PSM>\n\té中\U0001f600.\x1c\x85"), max_size=25)), max_size=6), st.integers(0, 100), st.integers(0, 100))
def test_batches_equal_single_texts(rows, cut, suffix_first):
    rule = fim.Rule(cut=cut, suffix_first=suffix_first)
    h = [np.array([int(hashlib.sha256(f"42:{doc}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for doc, _ in rows], np.int64) for k in range(4)]
    out, n, form, first, second = fim.transformed(pa.array([t for _, t in rows], pa.string()), h, rule)
    got = [(a, b, c, None if b == "plain" else d, None if b == "plain" else e) for a, b, c, d, e in zip(n.tolist(), form.tolist(), out.to_pylist(), first.tolist(), second.tolist(), strict=True)]
    assert got == [plain(doc, text, rule) for doc, text in rows]
    assert fim.restored(out, form, rule).to_pylist() == [t for _, t in rows]


def test_table_and_way_back(spark):
    rule = fim.Rule("{pre}", "[suf]", "|mid>", cut=90, suffix_first=30, seed=7)
    rows = [*enumerate(cases.odd_texts()), (None, "no id here"), (None, None), (3, "again and again"), (3, "again and again"), (99, "<P> a {pre} b"), (98, "<P> only other markers <M>")]
    df = spark.createDataFrame([(*r, 5, "kept") for r in rows], "doc_id long, text string, n int, form string").repartition(3)
    moved = fim.fill_in_middle(df, rule)
    got = sorted(((r["doc_id"], r["__n"], r["__form"], r["text"], r["__prefix_chars"], r["__middle_chars"], r["n"], r["form"]) for r in moved.collect()), key=str)
    assert got == sorted(((doc, *plain(doc, text, rule), 5, "kept") for doc, text in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = sorted(((r["doc_id"], r["text"]) for r in fim.restore(moved, rule).collect()), key=str)
    assert back == sorted(((doc, text or "") for doc, text in rows), key=str)


def test_clashing_columns_and_bad_markers(spark):
    with pytest.raises(ValueError, match="__form"):
        fim.fill_in_middle(spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, `__form` string"))
    for bad in (dict(prefix=""), dict(prefix="<P<"), dict(prefix="<S>x"), dict(prefix="<S>", suffix="<S>")):
        with pytest.raises(ValueError, match="marker"):
            fim.Rule(**bad)
    with pytest.raises(ValueError, match="markers"):
        fim.restored(pa.array(["no marker"]), np.array(["psm"], object), fim.Rule())
