import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from annoframe.llm import catalog, language, licenses, quality, shared, toxicity
from annoframe.operators import lookup
from tests.llm import cases


def truth(spark, tables, column):
    docs = spark.read.parquet(f"{tables}/documents.parquet").toPandas()
    if column == "lang":
        return docs
    return docs.merge(spark.read.parquet(f"{tables}/labels.parquet").toPandas(), on="doc_id")


def area(scores, labels):
    ranks = pd.Series(scores).rank()
    n = labels.sum()
    return (ranks[labels].sum() - n * (n + 1) / 2) / (n * (~labels).sum())


def held(ids):
    return np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in ids])


def test_toxicity_of_held_out_rows(spark, tables):
    out = catalog.QUERIES["op2_toxicity"](spark, tables).toPandas()
    assert (out.held_out.to_numpy() == held(out.doc_id)).all()
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all()
    both = truth(spark, tables, "toxic").merge(out, on="doc_id")
    both = both[both.held_out]
    assert area(both.score.to_numpy(), (both.toxic == 1).to_numpy()) > 0.75


def test_toxicity_learns_expressions(spark):
    rude = [f"{cases.prose(k, 25)} vile{k % 3} {cases.prose(900 + k, 5)}" for k in range(60)]
    plain = [cases.prose(k, 30) for k in range(60, 260)]
    rows = list(enumerate([*rude, *plain, None, "", "...", "vile1 vile2 vile0"]))
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, `score` double").unionAll(spark.createDataFrame([(None, "vile1", 0.0)], "doc_id long, text string, score double"))
    labels = spark.createDataFrame([(k, int(k < 60)) for k in range(260) if k % 5] + [(2, None), (1, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, toxicity.not_held_out())
    out = toxicity.score(docs, model)
    assert out.columns == [*docs.columns, "__score"]
    scores = {r["doc_id"]: r["__score"] for r in out.collect()}
    assert min(scores[k] for k in range(60)) > max(scores[k] for k in range(60, 260))
    assert scores[260] == scores[261] == scores[262] < 0.3 < scores[263]


def test_toxicity_likelihoods_by_counting(spark):
    draw = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in np.minimum(draw.zipf(1.4, 60), 40)) for _ in range(40)] + [None, "", "..."]
    classes = [int(c) for c in draw.choice([0, 0, 1, -1], len(texts))]
    rows = spark.createDataFrame(list(zip(texts, classes, strict=True)), "text string, __class int").repartition(5)
    both = toxicity.likelihoods(rows, "text", 10 << 30)

    def hashed(words):
        return toxicity._places(pa.array(words))[0].view(np.int64).tolist() if words else []

    pairs = {c: Counter() for c in (0, 1)}
    every = set()
    for text, c in zip(texts, classes, strict=True):
        words = re.findall("[a-z0-9]+", text or "")
        found = list(zip(["", *words], words, strict=False))
        every.update(found)
        if c >= 0:
            pairs[c].update(found)
    follows = Counter(w for _, w in every)
    back = {w: (follows[w] + 0.5) / (len(every) + 0.5 * len(follows)) for w in follows}

    def models(c):
        def discounted(counts):
            return {k: min(n, toxicity.DISCOUNT) for k, n in counts.items()}

        cont = Counter(w for _, w in pairs[c])
        less, total = discounted(cont), sum(cont.values())
        first = {w: (cont[w] - less.get(w, 0)) / total + sum(less.values()) / total * back[w] for w in follows}
        taken = discounted(pairs[c])

        def second(v, w):
            n = sum(k for (a, _), k in pairs[c].items() if a == v)
            return (pairs[c][v, w] - taken.get((v, w), 0)) / n + sum(d for (a, _), d in taken.items() if a == v) / n * first[w] if n else first[w]

        return first, second, sum(less.values()) / total

    (first0, second0, freed0), (first1, second1, freed1) = models(0), models(1)
    assert sum(first0.values()) == pytest.approx(1) and sum(first1.values()) == pytest.approx(1)
    assert sum(second1("w1", w) for w in follows) == pytest.approx(1)
    assert both.freed == pytest.approx(np.log(freed1 / freed0))
    key = dict(zip(follows, hashed(list(follows)), strict=True)) | {"": 1}
    got = {r["word"]: (r["p0"], r["p1"]) for r in both.words.collect()}
    known = {w for c in (0, 1) for _, w in pairs[c]}
    assert set(got) == {key[w] for w in known}
    assert all(got[key[w]] == pytest.approx((first0[w], first1[w])) for w in known)
    twice = {pair for c in (0, 1) for pair, n in pairs[c].items() if n > 1}
    got = {(r["before"], r["word"]): (r["q0"], r["q1"]) for r in both.pairs.collect()}
    before = {v: k & ((1 << 48) - 1) for v, k in key.items()}
    assert set(got) == {(before[v], key[w]) for v, w in twice} and len(twice) > 50
    assert all(got[before[v], key[w]] == pytest.approx((second0(v, w), second1(v, w))) for v, w in twice)


def counting(monkeypatch, n_bytes):
    """What tasks of the counting run, first before and then after the shuffle."""
    class Rows:
        def __getattr__(self, name):
            return lambda *given, **named: self

    tasks = []
    monkeypatch.setattr(toxicity.shared, "in_batches", lambda df, function, schema: tasks.append(function) or df)
    toxicity._counted(Rows(), "text", n_bytes)
    return tasks


def random_words(draw, n, most):
    texts = [" ".join(f"w{k}" for k in draw.integers(0, most, 2000)) for _ in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(texts), pa.array(draw.integers(-1, 2, n), pa.int32())], names=["text", "__class"])


def merged(merge, rows):
    """The sums of all rows that the tasks after the shuffle make, by word and word before."""
    names = ["bucket", "blob"]
    rows = sorted((row for batch in rows for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True)), key=lambda row: row[0])
    out = merge(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)]))
    return pa.Table.from_batches(out).to_pandas().groupby(["word", "before"], dropna=False).sum().sort_index()


def test_toxicity_counts_the_same_in_small_portions(monkeypatch):
    batch = random_words(np.random.default_rng(5), 12, 300)
    count, merge = counting(monkeypatch, 1 << 30)
    whole = merged(merge, count(iter([batch])))
    monkeypatch.setattr(toxicity, "GATHERED", 500)
    monkeypatch.setattr(toxicity, "PIECE", 2000)
    parted = merged(merge, list(count(iter([batch.slice(0, 5), batch.slice(5)]))))
    pd.testing.assert_frame_equal(whole, parted)
    assert whole.n0.sum() > 0 and whole.every.sum() > 10_000


def test_toxicity_counts_in_little_memory(monkeypatch):
    batch = random_words(np.random.default_rng(6), 150, 1_000_000)  # 300,000 different pairs of 24 bytes
    monkeypatch.setattr(toxicity, "GATHERED", 400_000)
    monkeypatch.setattr(toxicity, "PIECE", 1 << 15, raising=False)
    count, _ = counting(monkeypatch, 1 << 30)
    tracemalloc.start()
    try:
        pairs = sum(batch.num_rows for batch in count(iter([batch])))
        _, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert pairs and most < 3 * 24 * 300_000


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r["__score"] < 1e-9 for r in toxicity.score(docs, model).collect())


def test_language_of_held_out_rows(spark, tables):
    both = truth(spark, tables, "lang").merge(catalog.QUERIES["op9_language_id"](spark, tables).toPandas(), on="doc_id")
    assert (both.held_out.to_numpy() == held(both.doc_id)).all() and both.score.between(0, 1).all()
    assert (both[both.held_out].lang == both[both.held_out].lang_pred).mean() > 0.98


def test_language_of_odd_rows(spark):
    rows = [(1, "the thing with the thing", "en"), (2, "le chat et la souris", "fr"), (3, "the the", None), (4, None, "en"), (5, "", "fr"), (6, "12 ... _", "en"), (None, "la la le", "fr"), (1, "the thing with the thing", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.languages == ["en", "fr"]
    out = [(r["doc_id"], r["__lang"]) for r in language.predict(docs, model).collect()]
    assert out == [(1, "en"), (2, "fr"), (3, "en"), (4, "und"), (5, "und"), (6, "und"), (None, "fr"), (1, "en")]
    nothing = language.fit(docs.where("lang IS NULL"))
    assert {r["__lang"] for r in language.predict(docs, nothing).collect()} == {"und"}


def test_language_features_of_texts():
    for text in ("ab", "éabc", ""):
        parts = [f.tolist() for f, _ in language.features(pa.array([text]))]
        assert [len(p) for p in parts] == [max(0, len(text) - n + 1) for n in language.SIZES]


def grams(text):
    text = "".join(c.lower() if c.isascii() else c for c in text)
    return [text[k : k + n] for n in language.SIZES for k in range(len(text) - n + 1)]


LANGUAGE_ROWS = [
    (1, "abc abd Cab", "x"), (2, "bcd bcd", "y"), (3, "éa 中 bc", "y"), (4, "zz top", "z"), (5, "cab ab", "x"),
    (6, "le mot", "v"), (7, "der zug", "w"), (8, "le zug 7", None), (9, "", "v"),
]


def plain_posteriors(rows, text):
    """P(language | text) by counting n-grams as strings; the rows have too few of them for two to share a feature."""
    by = {}
    for _, t, lang in rows:
        if lang is not None and t is not None:
            by.setdefault(lang, []).append(t)
    logs = {}
    for lang, texts in by.items():
        counts = Counter(g for t in texts for g in grams(t))
        total = sum(counts.values()) + 0.5 * language.FEATURES
        logs[lang] = math.log(len(texts) / sum(map(len, by.values()))) + sum(math.log((counts[g] + 0.5) / total) for g in grams(text))
    high = max(logs.values())
    mass = sum(math.exp(v - high) for v in logs.values())
    return {lang: math.exp(v - high) / mass for lang, v in logs.items()}


@pytest.mark.parametrize("group", [256, 2, 1])
def test_language_posteriors_equal_counting(spark, monkeypatch, group):
    monkeypatch.setattr(language, "GROUP", group)
    docs = spark.createDataFrame(LANGUAGE_ROWS, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert (model.languages, model.groups) == (list("vwxyz"), -(-5 // group))
    asked = [t for _, t, _ in LANGUAGE_ROWS if t] + ["abc zug", "q", "中", "bcd der le top " * 3]
    table = spark.createDataFrame([(k, t) for k, t in enumerate([*asked, None, "", "12 ._"])], "doc_id long, text string")
    got = {r["doc_id"]: (r["__lang"], r["__score"]) for r in language.predict(table, model).collect()}
    for k, text in enumerate(asked):
        expected = plain_posteriors(LANGUAGE_ROWS, text)
        assert got[k][1] == pytest.approx(expected[got[k][0]], rel=1e-3)
        assert expected[got[k][0]] == pytest.approx(max(expected.values()), rel=1e-3)
    assert [got[len(asked) + k] for k in range(3)] == [("und", 0.0)] * 3


@pytest.mark.parametrize("group", [256, 1])
def test_language_ties_go_to_the_first_name(spark, monkeypatch, group):
    monkeypatch.setattr(language, "GROUP", group)
    rows = [(k, "same text", name) for k, name in enumerate(["b", "c", "a"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language.predict(docs.select("doc_id", "text"), language.fit(docs)).collect()
    assert {(r["__lang"], round(r["__score"], 6)) for r in out} == {("a", 0.333333)}


def test_language_columns_that_clash_are_errors(spark):
    docs = spark.createDataFrame([(1, "a b", "en", 0)], "doc_id long, text string, lang string, __Best int")
    with pytest.raises(ValueError, match="added here: __Best"):
        language.predict(docs, language.fit(docs))


def base_plain(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    covered = {i for k, w in enumerate(windows) if windows.count(w) > 1 for i in range(k, k + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words))


def test_quality_counts(spark):
    texts = [t for t in cases.odd_texts() if len(t or "") < 20_000]
    texts += ["# a | b <c> $1 100% & *", "a b c d e a b c d e f g h i j k l m n o p q r s t u v w x y", "same\nsame\n same\n\n \nSame\nsame"]
    rows = [*enumerate(texts), (None, "one two"), (0, "repeated id")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int")
    model = quality.fit(docs, spark.createDataFrame([(8, 1)], "doc_id long, quality int"))
    out = quality.judge(docs, model)
    assert out.columns[:3] == docs.columns
    names = ("__n_words", "__word_chars", "__n_symbols", "__n_dup_lines", "__n_repeat_words", "__base_failed")
    got = [tuple(r[n] for n in names) for r in out.collect()]
    assert got == [base_plain(t) for _, t in rows]
    assert all(r["__kept"] == (not r["__base_failed"]) for r in out.collect())


def test_quality_verdicts(spark, tables):
    both = truth(spark, tables, "quality").merge(catalog.QUERIES["op7_quality_rules"](spark, tables).toPandas(), on="doc_id")
    judged = both[~both.base_failed]
    assert judged[judged.quality == 1].kept.mean() > 0.97
    assert judged[judged.quality == 0].kept.mean() < 0.1
    # Of these, neither the counts of trusted text nor the threshold have seen any; there are some seventy good ones.
    unseen = judged[held(judged.doc_id)]
    assert unseen[unseen.quality == 1].kept.mean() > 0.95
    assert unseen[unseen.quality == 0].kept.mean() < 0.1
    assert not both[both.base_failed].kept.any()


def test_license_templates(spark):
    rows = [(k, text) for k, (_, text) in enumerate(licenses.TEMPLATES)]
    rows += [(100, "unrelated words in a line"), (101, None), (102, "word"), (None, licenses.TEMPLATES[0][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, dice int")
    found = {r["doc_id"]: (r["__license"], r["__dice"], r["__n_matches"]) for r in licenses.scan(docs).collect()}
    for k, (name, _) in enumerate(licenses.TEMPLATES):
        assert found[k] == (name, 1.0, 3)
    assert found[100] == found[101] == found[102] == (None, None, 0)
    assert found[None] == ("Apache-2.0", 1.0, 3)


@pytest.mark.parametrize("least", [0.3, 0.6, 0.9])
def test_license_size_bounds_lose_no_match(least):
    draw = np.random.default_rng(1)
    names = [(f"t{k}", " ".join(draw.choice(list("abcdef"), draw.integers(2, 12)))) for k in range(20)]
    known = licenses.Templates(names, least)
    for _ in range(200):
        unit = np.unique(draw.choice(known.every, draw.integers(1, 12)))
        every = [(2 * len(np.intersect1d(s, unit)) / (len(s) + len(unit)), n) for n, s in known.sets]
        want = min(((-d, n) for d, n in every if d >= least), default=None)
        assert known.best(unit) == (None if want is None else (-want[0], want[1]))


def test_toxicity_learns_phrases_of_ordinary_words(spark):
    def text(k, toxic):
        words = cases.prose(k, 40).split()
        for at in (10, 25):
            words[at : at + 3] = ["plainly", "spoken", words[at]] if toxic else ["plainly", words[at], "spoken"]
        return " ".join(words)

    rows = [(k, text(k, k < 150)) for k in range(450)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 150)) for k in range(450)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, toxicity.not_held_out())
    out = toxicity.score(docs, model).toPandas()
    mine = out[held(out.doc_id)]
    assert area(mine["__score"].to_numpy(), (mine.doc_id < 150).to_numpy()) > 0.95
    # Both signs count, and tables that are too large for a broadcast give the same scores.
    assert model.pairs.where("value < 0").count() and model.pairs.where("value > 0").count()


def test_toxicity_tables_by_shuffle(spark, monkeypatch):
    texts = [f"{cases.prose(k, 25)} vile{k % 3} mean word" for k in range(40)] + [cases.prose(k, 30) for k in range(60, 160)] + [None, "", "vile1 vile1 mean word", "vile1 vile1 mean word"]
    docs = spark.createDataFrame([(k if k % 9 else None, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, `key` int")
    labels = spark.createDataFrame([(k, int(k < 40)) for k in range(140)], "doc_id long, toxic int")

    def scores():
        model = toxicity.fit(docs, labels)
        out = toxicity.score(docs, toxicity.Model(model.words, model.pairs, model.other, (-3.0, 1.0, 0.5)))
        assert out.columns == [*docs.columns, "__score"]
        return model.words.count(), model.pairs.count(), sorted(((str(r["text"]), r["__score"]) for r in out.collect()))

    n_words, n_pairs, few = scores()
    assert n_words and n_pairs
    monkeypatch.setattr(toxicity, "BROADCAST_ROWS", 0)
    many = scores()
    assert many[:2] == (n_words, n_pairs)
    assert [t for t, _ in many[2]] == [t for t, _ in few]
    assert np.allclose([s for _, s in many[2]], [s for _, s in few])


def test_toxicity_long_tables_send_few_keys(spark, monkeypatch):
    """Only keys that stand in a long table and are not among its frequent ones; the scores are those of broadcast tables and labels."""
    draw = np.random.default_rng(9)
    texts = [" ".join([*(f"w{k}" for k in draw.integers(0, 4000, 120)), *(["vile", f"mean{k % 20}", "word"] if k < 80 else ["kind", f"fine{k % 20}", "word"])]) for k in range(240)] + [None, "", "..."]
    texts += texts[:3]
    docs = spark.createDataFrame([(k if k % 9 else None, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(k < 80)) for k in range(240)] + [(5, 0), (None, 1)], "doc_id long, toxic int")

    def scores():
        model = toxicity.fit(docs, labels, toxicity.not_held_out())
        weighed = toxicity.Model(model.words, model.pairs, model.other, (-3.0, 1.0, 0.5))
        return model, sorted((str(r["doc_id"]), str(r["text"]), r["__score"]) for r in toxicity.score(docs, weighed).collect())

    model, few = scores()
    sent, plain = spark.sparkContext.accumulator(0), toxicity.shared.in_batches

    def watched(df, function, schema):
        def task(batches):
            for batch in function(batches):
                if {"__a", "key"} <= set(batch.schema.names):
                    sent.add(batch.num_rows)
                yield batch

        return plain(df, task, schema)

    monkeypatch.setattr(toxicity.shared, "in_batches", watched)
    monkeypatch.setattr(toxicity, "BROADCAST_ROWS", 8)
    monkeypatch.setattr(toxicity, "BROADCAST_LABELS", 0)
    many_model, many = scores()
    assert model.words.count() > 8 and model.pairs.count() > 8
    assert sorted(map(tuple, many_model.words.select("key", "value").collect())) == sorted(map(tuple, model.words.select("key", "value").collect()))
    assert [row[:2] for row in many] == [row[:2] for row in few]
    assert np.allclose([row[2] for row in many], [row[2] for row in few])
    different = sum(len({*t.split()}) + len({*zip(t.split(), t.split()[1:])}) for t in texts if t)
    assert 0 < sent.value < different / 2


@pytest.mark.parametrize("most", [1, 1_000_000])
def test_toxicity_frequent_keys_of_long_tables(spark, monkeypatch, most):
    """A key of more rows than a task joins is dealt out; an overfull filter changes nothing."""
    texts = [f"vile mean word{k % 7} vile" if k < 50 else f"kind fine word{k % 7}" for k in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys, _ = toxicity._keys(pa.array(["vile mean kind fine"]))
    words, pairs = ([(int(k), v, 3) for k, v in zip(x.view(np.int64), (2.0, 1.0, -1.0, -2.0), strict=True)] for x in keys)
    model = toxicity.Model(*(spark.createDataFrame(rows, "key long, value double, seen long") for rows in (words, pairs)), 0.25, (-1.0, 0.5, 0.25))
    want = sorted(tuple(r) for r in toxicity.score(docs, model).collect())
    monkeypatch.setattr(toxicity, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(toxicity, "TARGET_ROWS", most)
    monkeypatch.setattr(lookup, "TARGET_ROWS", most)
    monkeypatch.setattr(toxicity, "FILTER_BITS", toxicity.FILTER_PARTS * 1024)
    got = sorted(tuple(r) for r in toxicity.score(docs, model).collect())
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want])


def test_toxicity_filter_holds_its_keys(spark):
    draw = np.random.default_rng(4)
    keys = draw.integers(0, 1 << 64, 20_000, np.uint64)
    bitmaps = toxicity._filter(spark.createDataFrame([(k,) for k in keys.view(np.int64).tolist()], "key long").repartition(3))
    assert toxicity._may_hold(bitmaps, keys).tolist() == list(range(len(keys)))
    assert len(toxicity._may_hold(bitmaps, draw.integers(0, 1 << 64, 20_000, np.uint64))) < 2_000


def test_labels_by_shuffle(spark, monkeypatch):
    """Rows whose label nobody uses, or without an id, are not shuffled; all rows return."""
    docs = spark.createDataFrame([(k if k % 5 else None, f"t{k}") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(3, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    want = sorted(tuple(r) for r in toxicity.labelled(docs, labels, "doc_id", "text", "toxic").select("text", "__label").fillna(-1).collect())
    monkeypatch.setattr(toxicity, "BROADCAST_LABELS", 0)
    assert sorted(tuple(r) for r in toxicity.labelled(docs, labels, "doc_id", "text", "toxic").select("text", "__label").fillna(-1).collect()) == want
    got = toxicity.labelled(docs, labels, "doc_id", "text", "toxic", F.col("__id") > 20).select("text", "__label", "__id").collect()
    assert sorted((r["text"], -1 if r["__label"] is None else r["__label"]) for r in got) == [(t, n if int(t[1:]) > 20 else -1) for t, n in want]


def test_kept_tables_leave_no_shuffle_files(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}

    before = shuffled()
    table = spark.range(1000).repartition(7, "id").groupBy("id").count()
    kept = shared.kept(table, "counts")
    assert not shuffled() - before
    assert kept.count() == table.count() == 1000 and spark.conf.get(shared._CLEANUP) == "false"


def test_license_short_notices_and_whole_texts(spark):
    whole = {name: text for name, text in licenses.TEMPLATES if len(text) > 600}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "MIT"} <= set(whole)
    short = [("MIT", "Released under the MIT License."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("BSD-3-Clause", "// SPDX-License-Identifier: BSD-3-Clause")]
    rows = [(name, f"some words before\n{text}\nand some words after it") for name, text in short]
    rows += [(name, "Copyright (c) 2020 Somebody\n\n" + text.replace(". ", ".\n\n")) for name, text in whole.items()]
    docs = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(rows)], "doc_id long, text string")
    found = {r["doc_id"]: r["__license"] for r in licenses.scan(docs).collect()}
    assert [found[k] for k in range(len(rows))] == [name for name, _ in rows]
