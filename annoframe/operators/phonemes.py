"""Transcription of text by a pronunciation lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookup import measured_bytes, small_or_lookup_join

# The signs a word is made of, and those between words.
WORD = "[A-Za-z']+"
# The latter are listed as ranges: the same class written as a negation takes ten times the processor time
# as soon as several threads of an executor match it.
BETWEEN = r"[\x00-&(-@\[-`{-\x{10FFFF}]+"

# Text that one task takes apart, in bytes: its words are sorted in memory, at some 30 bytes for each of the text.
TASK_BYTES = 4 * 1024 * 1024


def word_pieces(df: DataFrame, on: str, text: str) -> DataFrame:
    """One row per word of the whole text: position, word as written and in lower case, signs after it.

    The text is split once at its words and once between them; both lists line up,
    with an empty word for the signs before the first. A row without text gives
    one piece without position.
    """
    words = F.concat(F.array(F.lit("")), F.array_remove(F.split(F.col(text), BETWEEN, -1), ""))
    signs = F.split(F.col(text), WORD, -1)
    pieces = df.select(
        on, F.posexplode_outer(F.arrays_zip(words.alias("written"), signs.alias("tail"))).alias("pos", "piece")
    )
    return pieces.select(on, "pos", "piece.written", F.lower("piece.written").alias("word"), "piece.tail")


def transcribe(
    df: DataFrame, lexicon: DataFrame, on: str = "segment_id", text: str = "text", output: str = "phonemes",
    word: str = "word", sounds: str = "phonemes",
) -> DataFrame:
    """Key and transcription of every row: known words become their sounds, all else stays as written.

    The texts are dealt out by key before they are taken apart, to as many tasks as their
    measured size asks for, at least one a core, so that no task has more words than it can sort in memory. With a lexicon
    that measures small enough to be broadcast, splitting, lookup and putting
    together then stay in one task per text, and the only thing shuffled is the
    plain text; the result is already partitioned for joins on the key. A larger
    lexicon is joined by word, with frequent words split. Rows without text have
    no transcription.
    """
    entries = lexicon.groupBy(F.lower(F.col(word)).alias("word")).agg(F.min(F.col(sounds)).alias("sounds"))
    texts = df.select(on, text)
    tasks = max(-(-measured_bytes(texts.select(text)) // TASK_BYTES), df.sparkSession.sparkContext.defaultParallelism)
    pieces = word_pieces(texts.repartition(tasks, on), on, text)
    found = small_or_lookup_join(pieces, entries, ["word"], [on, "pos"])
    spoken = F.concat(F.coalesce("sounds", "written"), F.col("tail"))
    own = F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", spoken.alias("spoken"))))
    whole = found.groupBy(on).agg(F.sort_array(own).alias("pieces"), F.max("pos").alias("last"))
    twice = F.raise_error(F.concat(F.lit("more than one text for id "), F.col(on).cast("string")))
    return whole.select(
        on,
        F.when(F.size("pieces") > F.col("last") + 1, twice)
        .when(F.col("last").isNotNull(), F.array_join("pieces.spoken", ""))
        .alias(output),
    )
