import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from annoframe.functions import draw
from annoframe.functions import text as T
from annoframe.functions import vocabulary as V
from annoframe.operators import columns, lookup, phonemes, prompts


def test_keyword_filter(spark):
    df = spark.createDataFrame([("a <SIL> b",), ("a <sil> b",), ("x",), (None,), ("<OTHER>",)], "text string")
    assert {row["text"] for row in columns.without_keywords(df, "text").collect()} == {"a <sil> b", "x"}
    assert {row["text"] for row in columns.without_keywords(df, "text", keep_null=True).collect()} == {"a <sil> b", "x", None}


def test_tokens_are_cut_in_one_sweep(spark):
    texts = ["YES <COMMA> NO <PERIOD>", "<COM<PERIOD>MA>", "<QUESTIONMARK>", "a<EXCLAMATIONPOINT>b", ""]
    df = spark.createDataFrame([(text,) for text in texts], "text string")
    pattern = "|".join(re.escape(token) for token in V.PUNCTUATION_MARKERS)
    got = [row["text"] for row in columns.without_tokens(df, "text").collect()]
    assert got == [re.sub(pattern, "", text) for text in texts]


def test_template_values_are_literal(spark):
    df = spark.createDataFrame([(r"$1 \n [b]", "x", None)], "a string, b string, c string")
    filled = T.fill_template(F.lit("<[a]|[b]|[c]|[d]>"), {key: F.col(key) for key in "abc"})
    assert df.select(filled.alias("t")).first()["t"] == r"<$1 \n x|x|None|[d]>"


def test_strip_prefix(spark):
    df = spark.createDataFrame([("pröm", "prömpt…"), ("ab", "ab"), ("abc", "a")], "p string, g string")
    got = [row["t"] for row in df.select(T.strip_prefix(F.col("g"), F.col("p")).alias("t")).collect()]
    assert got == ["pt…", "", ""]


def test_draws_are_distinct_repeatable_and_even(spark):
    df = spark.range(4000)
    positions = F.array(*draw.draw_distinct(F.col("id"), "s", 3, 7))
    first = [tuple(row["p"]) for row in df.select(positions.alias("p")).collect()]
    again = [tuple(row["p"]) for row in df.repartition(5).select("id", positions.alias("p")).orderBy("id").collect()]
    assert first == again
    assert all(len(set(pick)) == 3 and set(pick) <= set(range(7)) for pick in first)
    assert len(set(first)) == 7 * 6 * 5
    for turn in range(3):
        for position in range(7):
            assert 450 < sum(pick[turn] == position for pick in first) < 700
    with pytest.raises(ValueError, match="cannot draw"):
        draw.draw_distinct(F.col("id"), "s", 4, 3)


def labelled(spark):
    values = {key: f"<{key}>" for key in V.PROMPT_KEYS}
    return spark.createDataFrame([{"segment_id": f"s{i}", **values} for i in range(20)])


def test_prompts(spark):
    parts = prompts.PromptParts("Front [age].\n", tuple(f"example {i}.\n" for i in range(20)))
    rows = prompts.build_prompts(labelled(spark), parts).collect()
    for row in rows:
        assert row["prompt"].startswith("Front <age>.\nExamples:\n1. example ")
        assert row["prompt"].endswith("'<gender>', '<age>', '<reverberation>', '<noise>', '<speech_monotony>', '<pitch>', "
                                      "'<speaking_rate>', '<background>'\nThe corresponding description is:\n\n")
        picked = re.findall(r"\d\. example (\d+)", row["prompt"])
        assert len(set(picked)) == 3
    assert len({row["prompt"] for row in rows}) > 15
    with pytest.raises(ValueError, match="missing columns"):
        prompts.build_prompts(labelled(spark).drop("noise"), parts)


def test_variants(spark):
    df = spark.createDataFrame([("a",), ("b",)], "segment_id string")
    make = lambda k: F.concat(F.col("segment_id"), F.lit(str(k)))
    wide = prompts.variant_columns(df, make)
    rows = prompts.variant_rows(df, make, "text")
    assert rows.count() == 10
    back = prompts.variants_to_columns(rows, "text")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, wide.collect()))
    assert wide.columns == ["segment_id", *[f"text_description{k}" for k in range(1, 6)]]


def test_variants_are_sorted_only_after_they_are_dealt_out(spark):
    rows = prompts.variant_rows(spark.range(50).select(F.col("id").cast("string").alias("segment_id")), lambda k: F.lit(str(k)), "text")
    plan = prompts.variants_to_columns(rows, "text")._jdf.queryExecution().sparkPlan().toString()
    executed = prompts.variants_to_columns(rows, "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate") == 2  # maxima of strings
    assert executed.count("Exchange") == 1 and "Sort" not in executed[executed.index("Exchange"):]


TEXTS = {
    "a": "Hello, WORLD! it's  fine", "b": "  ...lead", "c": "", "d": None, "e": "123 ?", "f": "été hello\nhello",
}


@pytest.mark.parametrize("limit", [10**9, 0])
def test_transcription(spark, monkeypatch, limit):
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", limit)
    df = spark.createDataFrame(list(TEXTS.items()), "segment_id string, text string")
    lexicon = spark.createDataFrame([("hello", "həloʊ"), ("World", "wɜːld"), ("it's", "ɪts"), ("hello", "zzz")], "word string, phonemes string")
    rows = {row["segment_id"]: row["phonemes"] for row in phonemes.transcribe(df, lexicon).collect()}
    assert rows == {
        "a": "həloʊ, wɜːld! ɪts  fine", "b": "  ...lead", "c": "", "d": None, "e": "123 ?", "f": "été həloʊ\nhəloʊ",
    }


def test_long_tables_are_transcribed_by_more_tasks(spark, monkeypatch):
    df = spark.createDataFrame([(str(k), "one two " * 20) for k in range(64)], "segment_id string, text string")
    lexicon = spark.createDataFrame([("one", "1")], "word string, phonemes string")
    monkeypatch.setattr(phonemes, "TASK_BYTES", 1024)
    whole = phonemes.transcribe(df, lexicon)
    assert whole.rdd.getNumPartitions() == 64 * (160 + lookup.ROW_BYTES) / 1024
    assert {row["phonemes"] for row in whole.collect()} == {"1 two " * 20}
    assert phonemes.transcribe(df.limit(0), lexicon).collect() == []


def test_transcription_rejects_two_texts_for_an_id(spark):
    df = spark.createDataFrame([("a", "x y"), ("a", "z")], "segment_id string, text string")
    lexicon = spark.createDataFrame([("x", "y")], "word string, phonemes string")
    with pytest.raises(PySparkException, match="more than one text for id a"):
        phonemes.transcribe(df, lexicon).collect()


def test_columns(spark):
    df = spark.createDataFrame([(1, 2, "noisy"), (2, 9, "clean"), (3, 5, None)], "segment_id int, n int, noise string")
    assert columns.drop_columns(df, "n+noise").columns == ["segment_id"]
    with pytest.raises(ValueError, match="missing columns"):
        columns.drop_columns(df, ["absent"])
    with pytest.raises(ValueError, match="duplicate"):
        columns.rename_columns(df, {"n": "noise"})
    assert [row["segment_id"] for row in columns.ids_with_label(df).collect()] == [1]
    assert [row["segment_id"] for row in columns.first_rows(df, 2, ["n"]).collect()] == [1, 3]
    kept = columns.at_least_seconds(df, "segment_id", "n", 3).collect()
    assert [row["segment_id"] for row in kept] == [2]
