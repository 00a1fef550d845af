"""Expressions over signals and the rates derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V


def speaking_rate(phonemes: Column, speech_seconds: Column) -> Column:
    """Characters of transcription per second of speech; no speech at all counts as a hundredth of a second."""
    seconds = F.when(speech_seconds != 0, speech_seconds.cast("double"))
    return F.length(phonemes) / F.when(speech_seconds.isNotNull(), F.coalesce(seconds, F.lit(V.EMPTY_SPEECH_SECONDS)))


def sample_seconds(samples: Column, sampling_rate: Column) -> Column:
    """Length of a flat sample array in seconds; NULL where the sampling rate is zero."""
    count = F.when(samples.isNotNull(), F.size(samples))
    return F.try_divide(count.cast("double"), sampling_rate.cast("double"))


def first_seconds(samples: Column, sampling_rate: Column, seconds: int = V.QUALITY_SECONDS) -> Column:
    """The leading ``seconds`` of a sample array."""
    return F.slice(samples, F.lit(1), (sampling_rate * F.lit(seconds)).cast("int"))


def array_mean(samples: Column) -> Column:
    """Mean of an array, without leaving the row."""
    total = F.aggregate(samples, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.try_divide(total, F.size(samples).cast("double"))


def array_sample_std(samples: Column) -> Column:
    """Sample standard deviation of an array, without leaving the row; NULL below two elements.

    Two sweeps over the row: the second sums squared distances from the mean.
    """
    def spread(state: Column) -> Column:
        mean = state["total"] / F.size(samples)
        squares = F.aggregate(
            samples, F.lit(0.0), lambda acc, x: acc + (x.cast("double") - mean) * (x.cast("double") - mean)
        )
        return F.sqrt(squares / (F.size(samples) - 1))

    summed = F.aggregate(
        samples,
        F.struct(F.lit(0.0).alias("total")),
        lambda acc, x: F.struct((acc["total"] + x.cast("double")).alias("total")),
        spread,
    )
    return F.when(F.size(samples) > 1, summed)


def flat_samples(samples: Column, nested: bool) -> Column:
    """A single-channel signal stored as one inner array becomes the flat array."""
    return F.flatten(samples) if nested else samples
