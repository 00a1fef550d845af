import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from annoframe.llm import decontam
from tests.llm import cases

WORD = st.integers(1, 4)


@given(st.lists(st.lists(WORD, max_size=9), max_size=5), st.lists(st.lists(WORD, max_size=20), min_size=1, max_size=4), st.integers(1, 5))
def test_automaton_equals_search(items, texts, window):
    named = [(k, np.array(x, np.uint64)) for k, x in enumerate(items)]
    automaton = decontam.Automaton.of(named, window).seal()
    firsts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    hashes = np.array([w for t in texts for w in t], np.uint64)
    hit, found = np.zeros(len(hashes), bool), [set() for _ in texts]
    for a, b in automaton.stretches(hashes, firsts):
        for end, size, names in automaton.hits(hashes, a, b):
            hit[end - size : end] = True
            found[int(np.searchsorted(firsts, end - 1, "right")) - 1] |= names
    for k, text in enumerate(texts):
        want, names = np.zeros(len(text), bool), set()
        for name, item in enumerate(items):
            size = min(window, len(item))
            for i in range(len(item) - size + 1 if item else 0):
                for j in range(len(text) - size + 1):
                    if text[j : j + size] == item[i : i + size]:
                        want[j : j + size] = True
                        names.add(name)
        assert (hit[firsts[k] : firsts[k + 1]] == want).all()
        assert found[k] == names


def test_odd_rows_and_several_automata(spark, monkeypatch):
    monkeypatch.setattr(decontam.automata, "__defaults__", ("item_id", "text", 10, 20))
    rows = [*enumerate(cases.odd_texts()), (None, cases.odd_texts()[20]), (3, cases.odd_texts()[20])]
    items = [*cases.odd_items(), (None, cases.prose(61, 12)), (9, cases.prose(70, 30_000))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, `__n` int")
    out = decontam.find_items(df, spark.createDataFrame(items, "item_id long, text string"))
    got = [(r["doc_id"], r["__n_words"], r["__n_hit"], r["__items"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(cases.hits_plain(rows, items), key=str)


def test_cleaned_texts_hold_no_window(spark):
    rows = [(k, t) for k, t in enumerate(cases.odd_texts())]
    items = spark.createDataFrame(cases.odd_items()[:3], "item_id long, text string")
    df = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, `__items` string")
    out = decontam.decontaminate(df, items)
    assert out.columns == df.columns
    left = {r["doc_id"]: r["text"] for r in out.collect()}
    found = {doc: (n, hit) for doc, n, hit, _ in cases.hits_plain(rows, cases.odd_items()[:3])}
    for doc, text in rows:
        n, hit = found[doc]
        assert (doc in left) == (hit <= 0.5 * n)
        if doc in left and not hit:
            assert left[doc] == text
        elif doc in left:
            assert cases.hits_plain([(doc, left[doc])], cases.odd_items()[:3])[0][2] == 0


def test_what_closes_up_is_scanned_again(spark):
    words = cases.prose(50, 25).split()
    text = " ".join([*"a b c d e f g h i j k l m n".split(), *words[:5], *words[3:15], *words[5:12], "z"])
    automaton = decontam.Automaton.of([("x", decontam.words_in(__import__("pyarrow").array([" ".join(words)]))[2])]).seal()
    cleaned, _ = decontam.without_spans(text.encode(), automaton, 1)
    assert cases.hits_plain([(0, cleaned.decode())], [("x", " ".join(words))])[0][2] == 0


def test_no_items(spark):
    df = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert sorted(decontam.decontaminate(df, none).collect()) == sorted(df.collect(), key=str)


def test_cleaning_does_not_depend_on_the_number_of_automata(spark, monkeypatch):
    a, b, own = (cases.prose(seed, 40).split() for seed in (50, 51, 52))
    items = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "item_id long, text string")
    texts = [
        " ".join([*a, *own[:15], *b[:30], *own[15:30]]),  # 70 of 100 words, 40 and 30 for themselves
        " ".join([*own, *a[:5], *b[:12], *a[5:15], *own]),  # the last cut closes a window of the first item
        " ".join([*own, *b[:5], *a[:12], *b[5:15], *own]),
        " ".join(own), None, "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def cleaned():
        return {r["doc_id"]: r["text"] for r in decontam.decontaminate(docs, items).collect()}

    one = cleaned()
    assert set(one) == {1, 2, 3, 4, 5}
    monkeypatch.setattr(decontam.automata, "__defaults__", ("item_id", "text", 10, 20))
    assert len(list(decontam.automata(items))) >= 2
    several = cleaned()
    assert several == one
    rows = [(k, t) for k, t in several.items()]
    assert not any(hit for _, _, hit, _ in cases.hits_plain(rows, [(1, " ".join(a)), (2, " ".join(b))]))
