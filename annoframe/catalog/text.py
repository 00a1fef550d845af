"""Transcripts, prompts, variants and model batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annoframe.functions import signal as S
from annoframe.functions import text as T
from annoframe.functions import vocabulary as V
from annoframe.operators import batches, columns, phonemes, prompts

from .registry import Tables, query, words


@query("SELECT p_partkey, p_name FROM part WHERE NOT (contains(p_name, 'ring') OR contains(p_name, 'red'))")
def filter_keywords(t: Tables) -> DataFrame:
    return columns.without_keywords(t.part.select("p_partkey", "p_name"), "p_name", ("ring", "red"))


@query("SELECT doc_id, regexp_replace(text, ' the|[.]|é|[(]', '', 'g') AS text FROM documents")
def strip_tokens(t: Tables) -> DataFrame:
    return columns.without_tokens(t.documents.select("doc_id", "text"), "text", (" the", ".", "é", "("))


@query(
    """
    SELECT doc_id, round(length(text) / CASE WHEN n_chars % 7 <> 0 THEN (n_chars % 7)::DOUBLE ELSE 0.01::DOUBLE END, 6)
      AS speaking_rate_value FROM documents
    """
)
def speaking_rate(t: Tables) -> DataFrame:
    rate = S.speaking_rate(F.col("text"), F.col("n_chars") % 7)
    return t.documents.select("doc_id", F.round(rate, 6).alias("speaking_rate_value"))


@query(
    """
    WITH lex AS (SELECT DISTINCT lower(w) AS word, reverse(lower(w)) AS sounds
                 FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z'']+')) AS w FROM benchmark)),
    found AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z'']+[^A-Za-z'']*|^[^A-Za-z'']+') AS ps FROM documents),
    p AS (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS pos FROM found),
    w AS (SELECT doc_id, pos, regexp_extract(piece, '^[A-Za-z'']+') AS written, piece FROM p),
    s AS (SELECT doc_id, pos, coalesce(sounds, written) || substr(piece, length(written) + 1) AS spoken
          FROM w LEFT JOIN lex ON lower(written) = word AND written <> '')
    SELECT doc_id, string_agg(spoken, '' ORDER BY pos) AS phonemes FROM s GROUP BY doc_id
    UNION ALL SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE '' END FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM s)
    """
)
def lexicon_transcribe(t: Tables) -> DataFrame:
    seen = t.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit(phonemes.WORD), F.lit(0))).alias("word"))
    lexicon = seen.select(F.lower("word").alias("word")).distinct().withColumn("phonemes", F.reverse("word"))
    return phonemes.transcribe(t.documents.select("doc_id", "text"), lexicon, "doc_id")


# Worded for this catalog; a user brings own examples.
EXAMPLES = tuple(
    f"Keywords: 'voice {i}', 'room {i % 4}'. Description: \"Voice {i} speaks in room {i % 4}.\"\n" for i in range(20)
)
PARTS = prompts.PromptParts("Describe the [age] speech sample in one sentence.\n\n", EXAMPLES)
PROMPT_SOURCES = {
    "gender": "c_mktsegment", "age": "c_nationkey", "reverberation": "c_custkey", "noise": "c_name",
    "speech_monotony": "c_mktsegment", "pitch": "c_nationkey", "speaking_rate": "c_name", "background": "c_mktsegment",
}


def draws_sql(seed: str) -> str:
    """Three different positions out of twenty per customer."""
    number = "(('0x' || substr(md5('{seed}|' || c_custkey || '|{turn}'), 1, 8))::BIGINT % {below})"
    a, b, c = (number.format(seed=seed, turn=turn, below=20 - turn) for turn in range(3))
    return f"""
    WITH r AS (SELECT *, {a} AS a, {b} AS b0, {c} AS c0 FROM customer),
    q AS (SELECT *, b0 + (CASE WHEN b0 >= a THEN 1 ELSE 0 END) AS b FROM r),
    h AS (SELECT *, c0 + (CASE WHEN c0 >= least(a, b) THEN 1 ELSE 0 END) AS c1 FROM q),
    d AS (SELECT *, c1 + (CASE WHEN c1 >= greatest(a, b) THEN 1 ELSE 0 END) AS c, [{words(EXAMPLES)}] AS ex FROM h)
    """


@query(draws_sql("7") + "SELECT c_custkey, ex[a + 1] AS example1, ex[b + 1] AS example2, ex[c + 1] AS example3 FROM d")
def sample_examples(t: Tables) -> DataFrame:
    picked = prompts.sampled_examples(F.col("c_custkey"), EXAMPLES, "7")
    return t.customer.select("c_custkey", picked.alias("picked")).select(
        "c_custkey", *[F.col("picked")[i].alias(f"example{i + 1}") for i in range(3)]
    )


def prompt_sql() -> str:
    text = (
        f"{words([PARTS.front + V.PROMPT_EXAMPLES_HEADING])} || '1. ' || ex[a + 1] || '2. ' || ex[b + 1] "
        f"|| '3. ' || ex[c + 1] || {words([PARTS.end])}"
    )
    for key in V.PROMPT_KEYS:
        text = f"replace({text}, '[{key}]', coalesce({PROMPT_SOURCES[key]}::VARCHAR, 'None'))"
    return text


@query(draws_sql("1") + f"SELECT c_custkey, {prompt_sql()} AS prompt FROM d")
def build_prompt(t: Tables) -> DataFrame:
    labelled = t.customer.select("c_custkey", *[F.col(source).alias(key) for key, source in PROMPT_SOURCES.items()])
    return prompts.build_prompts(labelled, PARTS, "c_custkey", "1").select("c_custkey", "prompt")


@query(
    """
    SELECT a.conv_id, a.turn, b.text AS text_description
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn
    """
)
def strip_prompt_prefix(t: Tables) -> DataFrame:
    prompt = t.conversations.select("conv_id", "turn", F.col("text").alias("prompt"))
    reply = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    generated = prompt.join(reply, ["conv_id", "turn"]).withColumn("generated", F.concat("prompt", "reply"))
    return generated.select(
        "conv_id", "turn", T.strip_prefix(F.col("generated"), F.col("prompt")).alias("text_description")
    )


FANOUT_SQL = "SELECT c_custkey, " + ", ".join(
    f"md5(c_name || '{k}') AS text_description{k}" for k in range(1, V.VARIANTS + 1)
) + " FROM customer"


def one_variant(k: int):
    return F.md5(F.concat(F.col("c_name"), F.lit(str(k))))


@query(FANOUT_SQL)
def variant_fanout(t: Tables) -> DataFrame:
    return prompts.variant_columns(t.customer.select("c_custkey", "c_name"), one_variant).drop("c_name")


@query(FANOUT_SQL)
def variant_rows_to_columns(t: Tables) -> DataFrame:
    rows = prompts.variant_rows(t.customer.select("c_custkey", "c_name"), one_variant, "text")
    return prompts.variants_to_columns(rows, "text", "c_custkey")


@query("SELECT doc_id, (length(text) % 10)::BIGINT AS score FROM documents")
def map_batches_scorer(t: Tables) -> DataFrame:
    def load():
        def score(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"doc_id": frame["doc_id"], "score": frame["text"].str.len() % 10})

        return score

    return batches.map_batches(t.documents, load, "doc_id long, score long", ["doc_id", "text"])
