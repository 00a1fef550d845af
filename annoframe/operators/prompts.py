"""Prompts from labels and examples, and variants of the same row."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annoframe.functions import text as T
from annoframe.functions import vocabulary as V
from annoframe.functions.draw import draw_distinct

from .columns import require_columns


@dataclass(frozen=True)
class PromptParts:
    """Text before the examples, text after them, and the keys replaced in both.

    ``front`` and ``examples`` are the user's own wording, read from a settings file
    (``sidefiles.read_prompt_parts``) or given in code; the layout around them is fixed.
    """

    front: str
    examples: tuple[str, ...]
    end: str = V.PROMPT_END
    keys: tuple[str, ...] = V.PROMPT_KEYS


def sampled_examples(row_key: Column, examples: Sequence[str], seed: str, picks: int = V.EXAMPLES_PER_PROMPT) -> Column:
    """``picks`` different examples for a row as an array, the same for the same row and seed."""
    all_examples = F.array(*[F.lit(example) for example in examples])
    return F.array(*[F.get(all_examples, position) for position in draw_distinct(row_key, seed, picks, len(examples))])


def prompt_text(parts: PromptParts, row_key: Column, seed: str, columns: dict[str, Column]) -> Column:
    """The whole prompt of a row."""
    picked = sampled_examples(row_key, parts.examples, seed)
    numbered = F.concat(*[F.concat(F.lit(f"{i + 1}. "), picked[i]) for i in range(V.EXAMPLES_PER_PROMPT)])
    template = F.concat(F.lit(parts.front + V.PROMPT_EXAMPLES_HEADING), numbered, F.lit(parts.end))
    return T.fill_template(template, columns)


def build_prompts(
    df: DataFrame, parts: PromptParts, on: str = "segment_id", seed: str = "0", output: str = "prompt"
) -> DataFrame:
    """Add the prompt column; every key of the template must be a column."""
    require_columns(df, [*parts.keys, on])
    columns = {key: F.col(key) for key in parts.keys}
    return df.withColumn(output, prompt_text(parts, F.col(on), seed, columns))


def variant_columns(
    df: DataFrame, make: Callable[[int], Column], variants: int = V.VARIANTS, name: str = "text_description"
) -> DataFrame:
    """One column per variant in a single projection, ``name1`` to ``nameN``."""
    return df.withColumns({f"{name}{k}": make(k) for k in range(1, variants + 1)})


def variant_rows(
    df: DataFrame, make: Callable[[int], Column], output: str, variants: int = V.VARIANTS, number: str = "variant"
) -> DataFrame:
    """One row per variant, for models that take one input at a time and for restart by variant."""
    made = F.array(*[F.struct(F.lit(k).alias(number), make(k).alias(output)) for k in range(1, variants + 1)])
    return df.withColumn("__made", F.explode(made)).withColumns(
        {number: F.col(f"__made.{number}"), output: F.col(f"__made.{output}")}
    ).drop("__made")


def variants_to_columns(
    rows: DataFrame, value: str, on: str = "segment_id", variants: int = V.VARIANTS, number: str = "variant",
    name: str = "text_description",
) -> DataFrame:
    """Variant rows back to one row per key, with one column per variant.

    Maxima of strings are found in sorted rows. The rows are dealt out by key before, so that
    a task sorts its part of the keys and not all the variants of what it has read.
    """
    return rows.repartition(on).groupBy(on).agg(
        *[F.max(F.when(F.col(number) == k, F.col(value))).alias(f"{name}{k}") for k in range(1, variants + 1)]
    )
