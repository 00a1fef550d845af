"""The stages from raw segments to captioned segments, composed from the operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from annoframe.functions import signal as S
from annoframe.functions import text as T
from annoframe.functions import vocabulary as V
from annoframe.operators import batches, bins, columns, frames, lookup, ordering, phonemes, prompts, speakers


def clean_transcripts(segments: DataFrame, text: str = "text") -> DataFrame:
    """Speech only, without punctuation markers."""
    return columns.without_tokens(columns.without_keywords(segments, text), text)


def measure(
    segments: DataFrame, pitch_frames: DataFrame, voice_frames: DataFrame, voice_ranges: DataFrame,
    lexicon: DataFrame, quality: DataFrame | None = None, duration: str = "speech", pitch_space: str = "linear",
    keep_audio: bool = False,
) -> DataFrame:
    """Add pitch, noise, reverberation, speech duration, phonemes and speaking rate to clean segments.

    Frame tables come from the user's models (``batches.map_batches``). Every
    branch is aggregated by ``segment_id`` and joined on it, so the wide table is
    partitioned by id once. ``duration`` chooses seconds of speech or of audio for
    the speaking rate. A segment without a branch result has NULL there. The
    signals never enter a shuffle: only their length is taken along, and the result
    can be merged with the audio table by id; ``keep_audio`` carries them along.
    """
    if duration not in ("speech", "audio"):
        raise ValueError("duration is speech or audio")
    clean = clean_transcripts(segments)
    pitch = frames.mean_and_std(
        frames.interpolate_unvoiced(pitch_frames, "f0", "periodicity", space=pitch_space), "f0", "utterance_pitch"
    )
    table = clean
    if duration == "audio":
        nested = segments.schema["audio"].dataType["array"].dataType.simpleString().startswith("array<array")
        samples = S.flat_samples(F.col("audio.array"), nested)
        table = table.withColumn("__seconds", S.sample_seconds(samples, F.col("audio.sampling_rate")))
    if not keep_audio and "audio" in table.columns:
        table = table.drop("audio")
    for branch in (
        pitch,
        frames.masked_means(voice_frames, voice_ranges),
        phonemes.transcribe(clean, lexicon),
    ):
        table = table.join(branch, "segment_id", "left")
    table = frames.speech_duration(table, voice_ranges)
    if duration == "speech":
        rate = S.speaking_rate(F.col("phonemes"), F.col("speech_duration"))
    else:
        rate = F.try_divide(F.length("phonemes").cast("double"), F.col("__seconds"))
    table = table.withColumn("speaking_rate_value", rate).drop("__seconds")
    if quality is not None:
        scores = columns.rename_columns(quality.select("segment_id", "stoi", "sdr", "pesq"), {"sdr": "si-sdr"})
        table = table.join(scores, "segment_id", "left")
    return table


def annotate(
    measured: DataFrame, sides: Mapping[str, DataFrame], confidence: float = V.CONFIDENCE, strict: bool = False
) -> DataFrame:
    """Add the thresholded side attributes and a running speaker name.

    ``segment_id`` must identify a row. The names are given to the bare ids, so the
    wide table and its joins are not read again for the numbering.
    """
    names = ordering.sequential_ids(measured.select("segment_id"), ["segment_id"])
    labelled = lookup.annotate(measured.drop("speaker"), sides, "segment_id", confidence, strict)
    same = F.col("segment_id").eqNullSafe(F.col("__id"))
    return labelled.join(names.select(F.col("segment_id").alias("__id"), "speaker"), same, "left").drop("__id")


def described_edges(
    annotated: DataFrame, specs: Sequence[bins.BinSpec] = bins.DEFAULT_SPECS, pitch: bool = True,
    speaker: str = "speaker", category: str = "gender_ori",
) -> DataFrame:
    """All fitted edges as one row, in the layout of an edge file: the statistics without labels."""
    edges = bins.fit_bin_edges(annotated, specs)
    if not pitch:
        return edges
    table = speakers.speaker_table(annotated, speaker, category, "utterance_pitch_mean", "segment_id")
    own = speakers.fit_category_edges(table, len(V.PITCH_LABELS))
    named = {V.PITCH_EDGE_KEY.format(category=name): F.col("__own")[name] for name in V.GENDERS}
    return bins.bound(edges, "__own", own).withColumns(named).drop("__own")


def describe(
    annotated: DataFrame, specs: Sequence[bins.BinSpec] = bins.DEFAULT_SPECS,
    edges: Mapping[str, Sequence[float]] | None = None, pitch: bool = True, fit_on: DataFrame | None = None,
    vocabularies: Mapping[str, Sequence[str]] | None = None, speaker: str = "speaker", category: str = "gender_ori",
    noise_lower_range: float | None = None,
) -> DataFrame:
    """Turn measurements into words.

    ``edges`` and ``vocabularies`` are the contents of settings files; what they do
    not name is fitted on ``fit_on`` (by default the table itself) or taken from
    the fixed vocabularies.
    """
    words = vocabularies or {}
    given = edges or {}
    chosen = [
        bins.BinSpec(
            spec.value, spec.label, tuple(words.get(V.VOCABULARY_KEYS.get(spec.label, ""), spec.labels)),
            spec.tolerance,
            noise_lower_range if spec.label == "noise" and noise_lower_range is not None else spec.lower_range,
        )
        for spec in specs
    ]
    table = annotated
    if pitch:
        own = {name: given.get(V.PITCH_EDGE_KEY.format(category=name)) for name in V.GENDERS}
        table = speakers.label_by_speaker(
            table.drop("pitch"), speaker, category, labels=tuple(words.get(V.VOCABULARY_KEYS["pitch"], V.PITCH_LABELS)),
            edges=own if all(own.values()) else None, order_by="segment_id", spread=["segment_id"],
        )
    return bins.label_columns(table, chosen, given, annotated if fit_on is None else fit_on)


def background(described: DataFrame, tags: DataFrame) -> DataFrame:
    """Add the background tag of every segment."""
    return lookup.add_tag(described, tags)


def noisy_ids(described: DataFrame) -> DataFrame:
    """Ids of the noisy segments, for an external tagger."""
    return columns.ids_with_label(described)


def caption(
    table: DataFrame, parts: prompts.PromptParts, generator: Callable[[], batches.BatchFunction], path: str,
    variants: int = V.VARIANTS, batch_size: int = 64, rounds: int = 1, name: str = "text_description",
) -> DataFrame:
    """Write ``variants`` captions per segment and return the table with one column per variant.

    The generator gets batches with a ``prompt`` column and returns the same rows
    with ``generated``, prompt included. Captions are kept as (segment, variant)
    rows under ``path``, so a stopped run goes on with what is missing.
    """
    columns.require_columns(table, [*parts.keys, "segment_id"])
    values = {key: F.col(key) for key in parts.keys}
    todo = prompts.variant_rows(
        table.select("segment_id", *parts.keys),
        lambda k: prompts.prompt_text(parts, F.col("segment_id"), str(k), values), "prompt", variants,
    ).select("segment_id", "variant", "prompt")
    made = StructType([todo.schema["segment_id"], todo.schema["variant"]]).add("prompt", "string").add("generated", "string")

    def generate(rows: DataFrame) -> DataFrame:
        answers = batches.map_batches(rows, generator, made, ["segment_id", "variant", "prompt"], batch_size)
        text = T.strip_prefix(F.col("generated"), F.col("prompt"))
        return answers.select("segment_id", "variant", text.alias("text"))

    kept = StructType([todo.schema["segment_id"], todo.schema["variant"]]).add("text", "string")
    rows = batches.run_resumable(todo, generate, path, kept, ["segment_id", "variant"], rounds)
    return table.join(prompts.variants_to_columns(rows, "text", variants=variants, name=name), "segment_id", "left")
