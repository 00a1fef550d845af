import random

import numpy as np
import pyarrow as pa
import pytest

from annoframe.llm import minhash
from tests.llm import cases
from tests.llm.test_jaccard import edited


def groups_plain(rows):
    return cases.groups_plain(rows, 2)


def result(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


def corpus():
    """Exact copies, near copies around the limit, chains of near copies, shared passages, and a large group."""
    draw = random.Random(9)
    rows = []
    for k in range(10):
        base = cases.prose(300 + k, 60 + 11 * k).split()
        rows += [" ".join(base)] * (k % 3 + 1)
        rows += [edited(base, draw, e) for e in (0, 1, 2, 4, 6, 8) for _ in range(2)]
        step = base
        for _ in range(4):
            step = edited(step, draw, 3).split()
            rows.append(" ".join(step))
    passage = cases.prose(999, 60)
    rows += [passage + " " + cases.prose(400 + k, 4 + k) for k in range(25)]
    rows += [cases.prose(500 + k, 1 + k % 4) for k in range(20)]
    large = cases.prose(77, 80).split()
    rows += [edited(large, draw, 1 + k % 3) for k in range(60)]
    draw.shuffle(rows)
    return [(1000 - k, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize(("list_rows", "broadcast"), [(4, 0), (4096, 1_000_000)])
def test_equals_all_pairs(spark, monkeypatch, list_rows, broadcast):
    monkeypatch.setattr(minhash, "LIST_ROWS", list_rows)
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", broadcast)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(minhash.near_duplicates(df)) == sorted((doc, n, c, doc == c) for doc, n, c in groups_plain(rows))


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    text = cases.prose(1, 30)
    rows = [(5, text), (5, text), (9, text + " more"), (None, text), (None, None), (7, None), (7, ""), (8, "other words here"), (8, text), (11, "One"), (12, "one")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, component_id int, `__class` string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()), key=str)
    want = [(5, 29, 5, True), (5, 29, 5, True), (9, 30, 5, False), (None, 29, None, True), (None, 0, None, True), (7, 0, 7, True), (7, 0, 7, True), (8, 2, 8, True), (8, 29, 5, False), (11, 1, 11, True), (12, 1, 11, False)]
    assert got == sorted(want, key=str)


def test_coordinates_agree_as_often_as_sets_are_alike():
    draw = np.random.default_rng(1)
    for alike in (0.5, 0.8, 0.95):
        n = 400
        common = round(2 * n * alike / (1 + alike))
        rates = []
        for _ in range(60):
            every = draw.integers(0, 1 << 63, 2 * n - common, np.uint64)
            a, b = minhash.signatures([np.unique(every[:n]), np.unique(every[n - common :])])
            rates.append(float((a == b).mean()))
        assert abs(np.mean(rates) - common / (2 * n - common)) < 0.03


def test_merging_counts_all_collisions():
    draw = np.random.default_rng(4)
    for _ in range(30):
        m = int(draw.integers(1, 80))
        base = draw.integers(0, 50, minhash.COORDINATES).astype(np.int32)
        matrix = np.where(draw.random((m, minhash.COORDINATES)) < draw.uniform(0.3, 1, (m, 1)), base, draw.integers(0, 50, (m, minhash.COORDINATES))).astype(np.int32)
        colors, sizes, asks = draw.integers(0, 4, m), draw.integers(80, 130, m), draw.random(m) < 0.6
        classes = draw.permutation(1000)[:m]
        # Prefixes in the order of their numbers; all hold post 50.
        prefixes = [np.unique(np.append(draw.integers(0, 100, draw.integers(0, 6)), 50)) for _ in range(m)]
        sets = [np.flatnonzero(draw.random(120) < n / 135).astype(np.int32) for n in sizes]
        sizes = np.array([len(x) for x in sets])
        want = {
            (min(classes[x], classes[y]), max(classes[x], classes[y])) for x in np.flatnonzero(asks) for y in range(m)
            if colors[x] != colors[y] and 5 * min(sizes[x], sizes[y]) >= 4 * max(sizes[x], sizes[y]) and (matrix[x] == matrix[y]).sum() >= minhash.LEAST_MATCHES
            and min(np.intersect1d(prefixes[x], prefixes[y])) == 50
            and 100 * (both := len(np.intersect1d(sets[x], sets[y]))) >= 80 * (sizes[x] + sizes[y] - both)
        }
        x, y = minhash.block_pairs(classes, colors, asks, sizes, matrix, prefixes, 50, sets)
        assert set(zip(x.tolist(), y.tolist(), strict=True)) == {(int(a), int(b)) for a, b in want}


def test_posts_of_coordinates_keep_their_order():
    matrix = np.array([[-1] * minhash.COORDINATES, list(range(minhash.COORDINATES))], np.int32)
    rows, coordinates = np.array([0, 1, 1]), np.array([63, 5, 0], np.int8)
    assert minhash.posts_of(matrix, rows, coordinates).tolist() == [(63 << 32) + 0xFFFFFFFF, (5 << 32) + 5, 0]


def test_rows_for_blocks_are_short(spark, monkeypatch):
    """One byte a coordinate of a prefix, two a shingle: these rows go to every list of a class."""
    seen = {}
    plain = minhash.shared.kept
    monkeypatch.setattr(minhash.shared, "kept", lambda df, label: seen.setdefault(label, plain(df, label)))
    texts = [cases.prose(k % 7, 40) + " " + cases.prose(50 + k, 12 + k % 5) for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    minhash.near_duplicates(df).collect()
    assert dict(seen["sets-short"].dtypes)["__short"] == "array<smallint>"
    assert "__posts" not in seen["shares"].columns


def test_sets_of_texts():
    texts = [None, "", " \n", "One", "one TWO", "a b a b a", "é\xa0ü b\tc"]
    assert [len(s) for s in minhash.shingles_of(pa.array(texts))] == [0, 0, 0, 1, 1, 2, 2]
    keys = [minhash.set_key(s) for s in minhash.shingles_of(pa.array(["a b c a", "b c a b", "a b c", "c a b c a"]))]
    assert len({keys[0], keys[1], keys[3]}) == 1 and keys[2] != keys[0]


def test_lists_of_one_head_find_pairs_of_any_post():
    """Members of several lists that are met together: pairs are found whatever their first common post is, or none."""
    draw = np.random.default_rng(12)
    base = np.unique(draw.integers(0, 1 << 63, 200, np.uint64))
    full = [base, base[5:], np.unique(draw.integers(0, 1 << 63, 200, np.uint64)), base[:-5]]
    matrix = minhash.signatures(full).view(np.int32)
    prefixes = [minhash.posts_of(matrix, np.full(3, k), np.arange(3) + 3 * k) for k in range(4)]
    short = [np.sort(s.astype(np.uint16).view(np.int16)) for s in full]
    pairs = minhash.block_pairs(np.arange(4), np.arange(4), np.array([True, True, True, False]), np.array(list(map(len, full))), matrix, prefixes, None, short)
    assert list(zip(*map(np.ndarray.tolist, pairs), strict=True)) == [(0, 1), (0, 3), (1, 3)]


def test_a_passage_sends_its_members_once(spark, monkeypatch):
    """Texts that share a passage share many lists; each goes to one group of them all, with the exact result."""
    groups = []
    apply = type(spark.range(1).groupBy("id")).applyInArrow

    def counted(self, function, schema):
        if function is minhash._in_blocks:
            groups.append(self._df.select("__list", "__row", "__col", "__class").count())
        return apply(self, function, schema)

    monkeypatch.setattr(type(spark.range(1).groupBy("id")), "applyInArrow", counted)
    passage = cases.prose(999, 300)
    rows = [(k, passage + " " + cases.prose(400 + k, 60 + 3 * k)) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def found():
        return sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(df).collect())

    got = found()
    monkeypatch.setattr(minhash, "SHORT_ROWS", 0)
    assert got == found()
    assert groups[0] < groups[1]


def tables_kept(monkeypatch):
    """Rows of each table that is written from now on."""
    seen = {}
    plain = minhash.shared.kept

    def kept(df, label):
        out = plain(df, label)
        seen[label] = out.count()
        return out

    monkeypatch.setattr(minhash.shared, "kept", kept)
    return seen


def test_spanning_pairs_join_what_all_pairs_join():
    draw = np.random.default_rng(6)
    base = np.unique(draw.integers(0, 1 << 63, 300, np.uint64))
    full = [np.delete(base, draw.integers(0, len(base), 12)) for _ in range(40)] + [np.unique(draw.integers(0, 1 << 63, 300, np.uint64))]
    short = [np.sort(s.astype(np.uint16).view(np.int16)) for s in full]
    n = len(full)
    block = (np.arange(n), np.arange(n), np.ones(n, bool), np.array(list(map(len, full))), minhash.signatures(full).view(np.int32), [np.array([50])] * n, 50, short)
    every, few = (list(zip(*map(np.ndarray.tolist, minhash.block_pairs(*block, spanning=spanning)), strict=True)) for spanning in (False, True))
    assert set(few) <= set(every) and len(every) > 10 * n

    def joined(pairs):
        found = list(range(n))
        for x, y in pairs:
            found = [found[x] if c == found[y] else c for c in found]
        return [found.index(c) for c in found]

    assert joined(few) == joined(every) and len(few) == n - len(set(joined(every)))


def test_pairs_that_are_no_link_tear_nothing(spark, monkeypatch):
    """With hashes of 8 bits many pairs of blocks are no link; what they held together is met again, and links are found there."""
    monkeypatch.setitem(minhash.SETS, "short", (np.uint8, np.int8, "tinyint"))
    seen = tables_kept(monkeypatch)
    draw, texts = random.Random(5), []
    for group in range(12):
        base = cases.prose(900 + group, 60).split()
        texts += [edited(base, draw, 1 + draw.randrange(5)) for _ in range(20)]
    draw.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(minhash.near_duplicates(df)) == sorted((doc, n, c, doc == c) for doc, n, c in groups_plain(rows))
    assert seen["torn"] > 0 and seen["links-torn"] > 0
