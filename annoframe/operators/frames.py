"""Aggregates over frame tables: one row per segment and frame, or per stem sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annoframe.functions import vocabulary as V

WORD = 64
RUN = 4096

# Samples of a signal that are columns of one row while stems are added up.
CHUNK = 32


def mean_and_std(frames: DataFrame, value: str, output: str, on: str = "segment_id") -> DataFrame:
    """Mean and sample standard deviation of a frame value per segment."""
    return frames.groupBy(on).agg(F.avg(value).alias(f"{output}_mean"), F.stddev_samp(value).alias(f"{output}_std"))


def speech_words(
    segments: DataFrame, on: str = "segment_id", start: str = "start", end: str = "end",
    rate: float = V.VAD_FRAMES_PER_SECOND,
) -> DataFrame:
    """Voice activity as bit words: bit b of word w is set where frame ``64 w + b`` is speech.

    A time range covers the frames from ``int(start * rate)`` up to, not
    including, ``int(end * rate)``. Overlapping ranges meet in a bitwise OR, which
    combines before the shuffle; no pair of frame and range is ever formed.
    """
    begin = F.greatest((F.col(start) * rate).cast("long"), F.lit(0))
    covered = segments.select(F.col(on), begin.alias("begin"), (F.col(end) * rate).cast("long").alias("stop")).where(
        F.col("stop") > F.col("begin")
    )
    words = covered.select(
        on, "begin", "stop",
        F.explode(F.expr(f"sequence(begin div {WORD}, (stop - 1) div {WORD})")).alias("word"),
    )
    low = F.greatest(F.col("begin") - F.col("word") * WORD, F.lit(0)).cast("int")
    high = F.least(F.col("stop") - F.col("word") * WORD, F.lit(WORD)).cast("int")
    ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), WORD - (high - low))
    bits = F.call_function("shiftleft", ones, low)
    return words.groupBy(on, "word").agg(F.bit_or(bits).alias("bits"))


def masked_means(
    frames: DataFrame, segments: DataFrame, values: Sequence[str] = ("snr", "c50"), on: str = "segment_id",
    frame: str = "frame_idx", start: str = "start", end: str = "end", rate: float = V.VAD_FRAMES_PER_SECOND,
) -> DataFrame:
    """Per segment: mean of each value over its speech frames, leaving out frames where all values are zero.

    Frames meet the mask by an equality join on segment and word: a key has at most 64
    frames, so a very long segment is spread over many tasks. Segments without such a frame have NULL means.
    """
    placed = frames.select(
        on, *values,
        F.expr(f"`{frame}` div {WORD}").alias("word"),
        F.pmod(F.col(frame), F.lit(WORD)).cast("int").alias("bit"),
    )
    masked = placed.join(speech_words(segments, on, start, end, rate), [on, "word"], "left")
    speech = F.call_function("shiftright", F.col("bits"), F.col("bit")).bitwiseAND(F.lit(1)) == 1
    silent = F.lit(True)
    for value in values:
        silent = silent & (F.col(value) == 0.0)
    return masked.groupBy(on).agg(*[F.avg(F.when(speech & ~silent, F.col(value))).alias(value) for value in values])


def speech_duration(
    table: DataFrame, segments: DataFrame, on: str = "segment_id", start: str = "start", end: str = "end",
    output: str = "speech_duration",
) -> DataFrame:
    """Add the summed length of a segment's time ranges; overlaps count twice, none gives 0."""
    spoken = segments.groupBy(on).agg(F.sum(F.col(end) - F.col(start)).alias(output))
    return table.join(spoken, on, "left").withColumn(output, F.coalesce(F.col(output), F.lit(0.0)))


def _levels(frames: DataFrame, frame: str, longest: int | None) -> int:
    """How many times runs are gathered in runs, so that the last ones are no more than ``RUN``."""
    if longest is None:
        low, high = frames.agg(F.min(frame), F.max(frame)).first()
        longest = 0 if low is None else int(high - low) + 1
    levels = 1
    while longest > RUN ** (levels + 1):
        levels += 1
    return levels


def _carried(ends: DataFrame, on: str, levels: int) -> DataFrame:
    """For each run: the last voiced frame of the runs before it and the first of those after it.

    ``ends`` has the first and last voiced frame of every run. Marks are carried inside
    groups of ``RUN`` runs; what none of them has comes from the ends of the groups, which
    are carried in the same way.
    """
    grouped = ends.withColumn("__up", F.floor(F.col("__run") / RUN) if levels > 1 else F.lit(0))
    own = [on, "__up"] if levels > 1 else [on]
    # The next mark is the last one of the reversed order: a frame that only grows costs one step per row.
    earlier = Window.partitionBy(*own).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*own).orderBy(F.col("__run").desc()).rowsBetween(Window.unboundedPreceding, -1)
    marks = {
        "prev_at": F.last("last_at", ignorenulls=True).over(earlier), "prev": F.last("last_level", ignorenulls=True).over(earlier),
        "next_at": F.last("first_at", ignorenulls=True).over(later), "next": F.last("first_level", ignorenulls=True).over(later),
    }
    inside = grouped.select(on, "__up", "__run", *(mark.alias(name) for name, mark in marks.items()))
    if levels == 1:
        return inside.drop("__up")
    upper = grouped.groupBy(on, F.col("__up").alias("__run")).agg(
        F.min("first_at").alias("first_at"), F.min_by("first_level", "first_at").alias("first_level"),
        F.max("last_at").alias("last_at"), F.max_by("last_level", "last_at").alias("last_level"),
    )
    above = _carried(upper, on, levels - 1).select(on, F.col("__run").alias("__up"), *(F.col(name).alias(f"up_{name}") for name in marks))
    return inside.join(above, [on, "__up"], "left").select(on, "__run", *(F.coalesce(name, f"up_{name}").alias(name) for name in marks))


def interpolate_unvoiced(
    frames: DataFrame, value: str, periodicity: str, on: str = "segment_id", frame: str = "frame_idx",
    threshold: float = V.PERIODICITY_THRESHOLD, space: str = "linear", output: str | None = None,
    longest: int | None = None,
) -> DataFrame:
    """Replace values of unvoiced frames by a straight line between the nearest voiced frames.

    Frames before the first or after the last voiced one take its value; a segment
    without voiced frames keeps its values. ``space="log2"`` draws the line between
    logarithms.

    Frames are numbers that grow by steps of similar size. Each run of ``RUN`` frame numbers
    is a window of its own; only the first and last voiced frame of every run are carried on,
    along runs of ``RUN`` runs, and so forth until one of them holds the longest segment. No
    window grows with a segment. ``longest`` is the span of frame numbers, if it is known;
    otherwise one pass over the frame column finds it when the plan is built.
    """
    if space not in ("linear", "log2"):
        raise ValueError("space is linear or log2")
    levels = _levels(frames, frame, longest)
    level = F.col(value).cast("double") if space == "linear" else F.log2(F.col(value))
    voiced = F.when(F.col(periodicity) >= threshold, level)
    runs = frames.withColumns({"__run": F.floor(F.col(frame) / RUN), "__level": voiced}).withColumn(
        "__at", F.when(F.col("__level").isNotNull(), F.col(frame))
    )

    ends = runs.groupBy(on, "__run").agg(
        F.min("__at").alias("first_at"), F.min_by("__level", "__at").alias("first_level"),
        F.max("__at").alias("last_at"), F.max_by("__level", "__at").alias("last_level"),
    )
    carried = _carried(ends, on, levels).withColumnsRenamed(
        {"prev_at": "__carried_prev_at", "prev": "__carried_prev", "next_at": "__carried_next_at", "next": "__carried_next"}
    )

    so_far = Window.unboundedPreceding, Window.currentRow
    forward = Window.partitionBy(on, "__run").orderBy(frame).rowsBetween(*so_far)
    backward = Window.partitionBy(on, "__run").orderBy(F.col(frame).desc()).rowsBetween(*so_far)
    marked = runs.withColumns(
        {
            "__prev_at": F.last("__at", ignorenulls=True).over(forward),
            "__prev": F.last("__level", ignorenulls=True).over(forward),
            "__next_at": F.last("__at", ignorenulls=True).over(backward),
            "__next": F.last("__level", ignorenulls=True).over(backward),
        }
    ).join(carried, [on, "__run"], "left")
    prev_at, prev = F.coalesce("__prev_at", "__carried_prev_at"), F.coalesce("__prev", "__carried_prev")
    next_at, following = F.coalesce("__next_at", "__carried_next_at"), F.coalesce("__next", "__carried_next")
    share = (F.col(frame) - prev_at) / (next_at - prev_at)
    filled = (
        F.when(prev.isNull(), following)
        .when(following.isNull() | (next_at == prev_at), prev)
        .otherwise(prev + (following - prev) * share)
    )
    if space == "log2":
        filled = F.pow(F.lit(2.0), filled)
    keep = (F.col(periodicity) >= threshold) | filled.isNull()
    result = F.when(keep, F.col(value).cast("double")).otherwise(filled)
    return marked.withColumn(output or value, result).drop(*[name for name in marked.columns if name.startswith("__")])


def stem_mixdown(
    stems: DataFrame, last_stem: int, on: str = "segment_id", stem: str = "stem", channel: str = "channel",
    sample: str = "t", amplitude: str = "amp", length: str | None = None,
) -> DataFrame:
    """Per segment and sample: ``vocals`` (the last stem) and ``others`` (the sum of the rest), mean over channels.

    Sums per channel come first, then the mean over the channels that a part is heard in;
    both aggregations combine before their shuffle. ``length`` names a column with the
    true number of samples; padding beyond it is cut.
    """
    if length is not None:
        stems = stems.where(F.col(sample) < F.col(length))
    vocals = F.col(stem) == last_stem
    by_channel = stems.groupBy(on, sample, channel).agg(
        F.sum(F.when(vocals, F.col(amplitude))).alias("vocals"), F.sum(F.when(~vocals, F.col(amplitude))).alias("others")
    )
    return by_channel.groupBy(on, sample).agg(F.avg("vocals").alias("vocals"), F.avg("others").alias("others"))


def stem_mixdown_arrays(
    stems: DataFrame, vocals: Column, on: str = "segment_id", channel: str = "channel", samples: str = "samples",
    length: str | None = None,
) -> DataFrame:
    """As :func:`stem_mixdown` for signals as arrays: one row a segment with the arrays ``vocals`` and ``others``.

    ``vocals`` tells the rows of the last stem. Arrays are cut into chunks of ``CHUNK``
    samples, whose columns are summed and averaged in compiled code and combine before
    each shuffle, so there is no row a sample, and a segment of any number of stems
    never stands in one task. A sample that a part lacks is NULL there; a segment without
    samples has no row.
    """
    size = F.size(F.coalesce(F.col(samples), F.array()))
    if length is not None:
        size = F.least(size, F.col(length))
    sized = stems.select(F.col(on), F.col(channel).alias("__channel"), vocals.alias("__vocals"), F.col(samples).alias("__x"), size.alias("__size"))
    numbers = F.when(F.col("__size") > 0, F.sequence(F.lit(0), F.floor((F.col("__size") - 1) / CHUNK).cast("int")))

    def chunk(number: Column) -> Column:
        at = number * CHUNK
        inside = F.sequence(F.lit(0), F.lit(CHUNK - 1))
        cut = F.transform(inside, lambda k: F.when(at + k < F.col("__size"), F.get("__x", at + k)).cast("double"))
        return F.struct(number.alias("chunk"), F.least(F.lit(CHUNK), F.col("__size") - at).alias("size"), cut.alias("x"))

    cells = sized.select(on, "__channel", "__vocals", F.explode(F.transform(numbers, chunk)).alias("c"))
    places = range(CHUNK)
    by_channel = cells.groupBy(on, "c.chunk", "__channel", "__vocals").agg(
        F.max("c.size").alias("size"), *[F.sum(F.col("c.x")[k]).alias(f"x{k}") for k in places]
    )
    heard = F.col("__vocals")
    mixed = by_channel.groupBy(on, "chunk").agg(
        F.max("size").alias("size"),
        *[F.avg(F.when(heard, F.col(f"x{k}"))).alias(f"v{k}") for k in places],
        *[F.avg(F.when(~heard, F.col(f"x{k}"))).alias(f"o{k}") for k in places],
    )
    rows = mixed.select(on, F.struct(
        "chunk", *[F.slice(F.array(*[F.col(f"{part}{k}") for k in places]), F.lit(1), F.col("size")).alias(part) for part in "vo"]
    ).alias("c"))
    whole = rows.groupBy(on).agg(F.array_sort(F.collect_list("c")).alias("c"))
    return whole.select(on, F.flatten("c.v").alias("vocals"), F.flatten("c.o").alias("others"))
