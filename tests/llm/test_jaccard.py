import os
import random
import tracemalloc

import numpy as np
import pytest

from annoframe.llm import jaccard
from annoframe.llm.components import components
from tests.llm import cases


def result(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def edited(words, draw, n):
    words = list(words)
    for _ in range(n):
        words[draw.randrange(len(words))] = f"edit{draw.randrange(10**6)}"
    return " ".join(words)


def corpus():
    """Exact copies, near copies around the limit, chains of near copies, and shared passages."""
    draw = random.Random(5)
    rows = []
    for k in range(12):
        base = cases.prose(300 + k, 40 + 11 * k).split()
        rows += [" ".join(base)] * (k % 3 + 1)
        rows += [edited(base, draw, e) for e in (0, 1, 1, 2, 3) for _ in range(2)]
        step = base
        for _ in range(4):
            step = edited(step, draw, 1).split()
            rows.append(" ".join(step))
    passage = cases.prose(999, 60)
    rows += [passage + " " + cases.prose(400 + k, 4 + k) for k in range(25)]
    rows += [cases.prose(500 + k, 3 + k % 4) for k in range(30)]
    draw.shuffle(rows)
    return [(1000 - k, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("list_rows", [4, 4096])
def test_equals_all_pairs(spark, monkeypatch, list_rows):
    monkeypatch.setattr(jaccard, "LIST_ROWS", list_rows)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(jaccard.similar_documents(df)) == sorted(cases.groups_plain(rows))


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    text = cases.prose(1, 30)
    rows = [(5, text), (5, text), (9, text + " more"), (None, text), (None, None), (7, None), (7, ""), (8, "other words here"), (8, text)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, component_id int, `__class` string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(df).collect()), key=str)
    assert got == sorted([(5, 26, 5), (5, 26, 5), (9, 27, 5), (None, 26, None), (None, 0, None), (7, 0, 7), (7, 0, 7), (8, 1, 8), (8, 26, 5)], key=str)


def test_prefixes_of_linked_sets_share_what_both_ask_for():
    draw = np.random.default_rng(3)
    counts = draw.integers(1, 200, jaccard.SKETCH)
    for _ in range(300):
        n = int(draw.integers(1, 120))
        a = np.unique(draw.integers(0, 1 << 63, n, np.uint64))
        b = np.unique(np.concatenate([a[draw.random(len(a)) > draw.uniform(0, 0.2)], draw.integers(0, 1 << 63, int(draw.integers(0, 12)), np.uint64)]))
        common = len(np.intersect1d(a, b))
        if common and 100 * common >= 80 * (len(a) + len(b) - common):
            (x, l, _), (y, m, _) = jaccard.prefix(a, counts, 40.0), jaccard.prefix(b, counts, 40.0)
            assert len(np.intersect1d(x, y)) >= min(l, m)


def test_frequent_rare_ends_ask_for_more():
    counts = np.ones(jaccard.SKETCH, np.int64)
    shingles = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 100, np.uint64))
    assert jaccard.prefix(shingles, counts, 10.0)[1] == 1
    counts[jaccard._bucket(shingles)] = np.where(np.arange(len(shingles)) < 15, 1, 5000)
    tokens, least, met = jaccard.prefix(shingles, counts, 10.0)
    assert least > 1 and len(tokens) == 20 + least and met > 0


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (103, 101), (200, 200)]
    nodes = spark.createDataFrame([(k,) for k in (*range(61), 100, 101, 102, 103, 200)], "__node long")
    found = {r["__node"]: r["__component"] for r in components(nodes, spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 103: 100, 102: 102, 200: 200}


def large_files(folder):
    return {e.name for e in os.scandir(folder) if e.stat().st_size > 1 << 20}


def test_the_sketch_is_held_once_and_given_up(spark):
    docs = spark.createDataFrame([(k, cases.prose(k % 7, 40)) for k in range(20)], "doc_id long, text string")
    folder = spark.sparkContext._temp_dir  # broadcast values wait here for executors
    before = large_files(folder)
    tracemalloc.start()
    try:
        jaccard.similar_classes(docs)
        _, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert most < 2 * 8 * jaccard.SKETCH  # 8 bytes a counter
    assert large_files(folder) == before
