"""Transcript and prompt expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """True where ``text`` holds one of ``words`` as a case-sensitive substring."""
    return reduce(lambda found, word: found | text.contains(word), words, F.lit(False))


def strip_tokens(text: Column, tokens: Sequence[str] = V.PUNCTUATION_MARKERS) -> Column:
    """Cut every token out in one pass; the blanks around a token stay."""
    return F.regexp_replace(text, "|".join(re.escape(token) for token in tokens), "")


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replace each ``[key]`` by its value, literally and in the order given; a missing value reads "None"."""
    return reduce(
        lambda text, item: F.replace(
            text, F.lit(f"[{item[0]}]"), F.coalesce(item[1].cast("string"), F.lit(V.MISSING_LABEL))
        ),
        values.items(),
        template,
    )


def strip_prefix(generated: Column, prompt: Column) -> Column:
    """What a generator added after its prompt: the text from position ``length(prompt)`` on."""
    return F.substr(generated, F.length(prompt) + 1)
