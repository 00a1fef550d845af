import random
from pathlib import Path

import numpy as np
import pytest

from annoframe.llm import confirm, jaccard, minhash, shared
from annoframe.operators import lookup
from tests.llm import cases


def edited(words, draw, n):
    words = list(words)
    for at in draw.sample(range(len(words)), n):
        words[at] = f"edit{draw.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("operator, sets_of, key_of", [(jaccard.similar_documents, jaccard.shingle_sets, jaccard.signature), (minhash.near_duplicates, minhash.shingles_of, minhash.set_key)])
def test_what_meets_at_pairs_is_smaller_than_sets(spark, monkeypatch, operator, sets_of, key_of):
    draw, rows = random.Random(3), []
    for k in range(8):
        base = cases.prose(700 + k, 3000).split()
        rows += [edited(base, draw, e) for e in (0, 9, 20)]
    written, keep = [], shared.kept

    def kept(df, label):
        out = keep(df, label)
        if label.startswith(("sets-", "texts-")) and not label.endswith("short"):
            written.append(sum(p.stat().st_size for f in out.inputFiles() for p in [Path(f.removeprefix("file://"))]))
        return out

    monkeypatch.setattr(shared, "kept", kept)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["component_id"] for r in operator(df).collect()}
    assert found == {k: k // 3 * 3 for k in range(len(rows))}
    assert 0 < max(written) < 0.6 * 8 * sum(len(s) for s in sets_of(as_array(rows)))


def as_array(rows):
    import pyarrow as pa

    return pa.array(rows)


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_pairs_are_compared_by_whole_sets(spark, monkeypatch, broadcast_rows):
    """Also where an id stands at several texts, and where a row is repeated in several tasks."""
    monkeypatch.setattr(confirm, "TOGETHER", 3)
    draw = random.Random(8)
    base = cases.prose(1, 200).split()
    texts = [edited(base, draw, e) for e in (0, 1, 2, 4, 6, 9, 14, 30)] + [cases.prose(5, 60)]
    sets = list(jaccard.shingle_sets(as_array(texts)))
    keys = [jaccard.signature(s) for s in sets]
    classes = spark.createDataFrame([(k, 100 + k // 2, a, b) for k, (a, b) in enumerate(keys)], "__class long, __first long, __a long, __b long")
    docs = spark.createDataFrame([(100 + k // 2, t) for k, t in enumerate(texts)] * 3 + [(None, texts[0]), (100, None)], "doc_id long, text string").repartition(4)
    pairs = [(x, y) for x in range(len(texts)) for y in range(x + 1, len(texts))]
    got = confirm.linked(spark.createDataFrame(pairs, "__x long, __y long"), docs, "doc_id", "text", classes, jaccard.shingle_sets, jaccard.signature, broadcast_rows, "test").collect()
    both = {(x, y): len(np.intersect1d(sets[x], sets[y])) for x, y in pairs}
    want = [(x, y) for x, y in pairs if 100 * both[x, y] >= 80 * (len(sets[x]) + len(sets[y]) - both[x, y])]
    assert 0 < len(want) < len(pairs)
    assert sorted((r["__x"], r["__y"]) for r in got) == want


def test_pairs_are_dealt_to_slices_only_where_a_class_has_very_many(spark, monkeypatch):
    """Every slicing join adds two broadcasts that the driver builds; the pairs are the same with and without."""
    pairs = [(0, k) for k in range(1, 30)] + [(k, 40) for k in range(1, 5)] + [(50, 51)]
    table = spark.createDataFrame(pairs, "__x long, __y long")
    rows = spark.range(45).selectExpr("id AS __class", "id * 10 AS __value")
    want = sorted((x, y, 10 * x, 10 * y) for x, y in pairs if y < 45)
    sliced, plain = [], lookup.sliced_join
    monkeypatch.setattr(lookup, "sliced_join", lambda left, right, on, *rest: sliced.append(on[0]) or plain(left, right, on, *rest))
    for most, sides in ((1_000_000, []), (30, []), (20, ["__x"]), (2, ["__x", "__y"])):
        monkeypatch.setattr(lookup, "TARGET_ROWS", most)
        sliced.clear()
        got = confirm.both_ends(table, rows, rows, {"__value": "__value_"}).select("__x", "__y", "__value_x", "__value_y")
        assert sliced == sides
        assert sorted(map(tuple, got.collect())) == want
        if not sides:
            assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
