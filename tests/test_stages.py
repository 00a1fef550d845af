import numpy as np
import pandas as pd
import pytest

from annoframe.functions import vocabulary as V
from annoframe.operators import columns, prompts
from annoframe.plans import stages
from annoframe.sources import sidefiles
from annoframe.streaming import shards

COUNT = 60
RANDOM = np.random.default_rng(2)


@pytest.fixture(scope="module")
def segments(spark):
    rows = []
    for i in range(COUNT):
        text = "HELLO <COMMA> WORLD <PERIOD>" if i % 10 else "<MUSIC>"
        rows.append((f"s{i:02d}", f"raw{i % 7}", text, ([0.0] * (16 * (i + 1)), 16), float(i), float(i + 4), "u", "c"))
    return spark.createDataFrame(
        rows,
        "segment_id string, speaker string, text string, audio struct<array:array<float>,sampling_rate:int>, "
        "begin_time double, end_time double, url string, category string",
    )


@pytest.fixture(scope="module")
def measured(spark, segments):
    pitch = [(f"s{i:02d}", t, float(100 + i + t), 0.01 if t == 3 else 0.9) for i in range(COUNT) for t in range(8)]
    voice = [(f"s{i:02d}", t, float(i + t), float(50 - i)) for i in range(COUNT) for t in range(100)]
    ranges = [(f"s{i:02d}", 0.0, 0.5 + i / 100) for i in range(COUNT) if i != 5]
    lexicon = spark.createDataFrame([("hello", "həloʊ"), ("world", "wɜːld")], "word string, phonemes string")
    quality = spark.createDataFrame([(f"s{i:02d}", 0.9, 10.0, 3.0) for i in range(COUNT)], "segment_id string, stoi double, sdr double, pesq double")
    return stages.measure(
        segments,
        spark.createDataFrame(pitch, "segment_id string, frame_idx int, f0 double, periodicity double"),
        spark.createDataFrame(voice, "segment_id string, frame_idx int, snr double, c50 double"),
        spark.createDataFrame(ranges, "segment_id string, start double, end double"),
        lexicon,
        quality,
        keep_audio=True,
    )


@pytest.fixture(scope="module")
def annotated(spark, measured, tmp_path_factory):
    folder = tmp_path_factory.mktemp("csv")
    sides = {}
    for name in V.ATTRIBUTES:
        label = [("male" if i % 2 else "female") if name == "gender" else f"{name}{i % 3}" for i in range(COUNT)]
        frame = pd.DataFrame({"segment_id": [f"s{i:02d}" for i in range(COUNT)], name: label, f"{name}_value": 0.96})
        frame.iloc[: COUNT - 4].to_csv(folder / f"{name}.csv", index=False)
        sides[name] = sidefiles.read_attribute_csv(spark, str(folder / f"{name}.csv"), name)
    return stages.annotate(measured, sides).cache()


def test_measure(measured):
    rows = {row["segment_id"]: row for row in measured.collect()}
    assert len(rows) == COUNT - COUNT // 10
    row = rows["s04"]
    assert row["text"] == "HELLO  WORLD "
    assert row["phonemes"] == "həloʊ  wɜːld "
    assert row["utterance_pitch_mean"] == pytest.approx(107.5)
    assert row["utterance_pitch_std"] == pytest.approx(np.std(range(8), ddof=1))
    assert row["snr"] == pytest.approx(4 + np.mean(range(int(0.54 * V.VAD_FRAMES_PER_SECOND))))
    assert row["speech_duration"] == pytest.approx(0.54)
    assert row["speaking_rate_value"] == pytest.approx(13 / 0.54)
    assert row["si-sdr"] == 10.0
    assert (rows["s05"]["speech_duration"], rows["s05"]["snr"]) == (0.0, None)
    assert rows["s05"]["speaking_rate_value"] == pytest.approx(1300)


def test_rate_by_audio_length(spark, segments):
    none = "segment_id string, frame_idx int, f0 double, periodicity double, snr double, c50 double"
    frames = spark.createDataFrame([], none)
    ranges = spark.createDataFrame([], "segment_id string, start double, end double")
    lexicon = spark.createDataFrame([], "word string, phonemes string")
    table = stages.measure(segments, frames, frames, ranges, lexicon, duration="audio", keep_audio=False)
    assert "audio" not in table.columns
    rows = {row["segment_id"]: row["speaking_rate_value"] for row in table.collect()}
    assert rows["s04"] == pytest.approx(len("HELLO  WORLD ") / 5)


def test_describe_and_caption(spark, annotated, tmp_path):
    rows = annotated.orderBy("segment_id").collect()
    assert [row["speaker"] for row in rows] == [f"TmpSpeaker_{i + 1}" for i in range(len(rows))]
    assert rows[0]["gender"] == "male" and rows[-1]["gender"] == "None"

    described = stages.describe(annotated)
    labels = {"speaking_rate": V.SPEAKING_RATE_LABELS, "noise": V.NOISE_LABELS, "pitch": V.PITCH_LABELS}
    for row in described.collect():
        for name, words in labels.items():
            assert row[name] in words or (row[name] is None and (name == "pitch" or row["segment_id"] == "s05"))

    edges = stages.described_edges(annotated)
    sidefiles.write_bin_edges(edges, str(tmp_path / "edges"))
    given = sidefiles.read_number_lists(spark, str(tmp_path / "edges"))
    assert set(given) == set(V.PUBLISHED_EDGES) - {"si-sdr", "pesq"}
    keys = ["segment_id", "pitch", "noise", "reverberation", "speaking_rate", "speech_monotony"]
    assert described.select(keys).exceptAll(stages.describe(annotated, edges=given).select(keys)).isEmpty()

    (tmp_path / "tags.txt").write_text("s01\tMusic, Opera\ns02\ns01\tFire\n")
    table = stages.background(described, sidefiles.read_tag_lines(spark, str(tmp_path / "tags.txt")))
    assert {row["segment_id"]: row["background"] for row in table.where("background != 'None'").collect()} == {"s01": "Fire"}

    def generator():
        def apply(frame):
            return frame.assign(generated=frame["prompt"] + "caption " + frame["variant"].astype(str))

        return apply

    parts = prompts.PromptParts("Describe.\n", tuple(f"example {i}\n" for i in range(20)))
    captioned = stages.caption(table, parts, generator, str(tmp_path / "captions"), rounds=2).collect()
    assert len(captioned) == len(rows)
    assert all(row[f"text_description{k}"] == f"caption {k}" for row in captioned for k in range(1, 6))
    with pytest.raises(ValueError, match="background"):
        stages.caption(described, parts, generator, str(tmp_path / "other"))


def test_own_words_and_lower_range(annotated):
    rows = stages.describe(
        annotated, vocabularies={"snr_bins": ("noisy", "clean")}, noise_lower_range=-1000.0, pitch=False
    ).collect()
    assert {row["noise"] for row in rows} == {"clean", None}
    assert "pitch" not in rows[0].asDict()


def test_noisy_ids_and_background_columns(annotated):
    described = stages.describe(annotated)
    ids = {row["segment_id"] for row in stages.noisy_ids(described).collect()}
    assert ids == {row["segment_id"] for row in described.collect() if row["noise"] in V.NOISY_LABELS}
    slim = columns.drop_columns(described, V.BACKGROUND_UNUSED)
    assert not set(V.BACKGROUND_UNUSED) & set(slim.columns)


def test_new_shards_are_processed_once(spark, segments, tmp_path):
    source, target, checkpoint = (str(tmp_path / name) for name in ("in", "out", "state"))
    plain = segments.select("segment_id", "text")
    plain.where("segment_id < 's30'").write.parquet(source)

    def run():
        shards.process_new_shards(spark, source, plain.schema, stages.clean_transcripts, target, checkpoint).awaitTermination()
        return spark.read.schema(plain.schema).parquet(target)

    assert run().count() == 27
    plain.where("segment_id >= 's30'").write.mode("append").parquet(source)
    assert run().count() == 54
    assert run().exceptAll(stages.clean_transcripts(plain)).isEmpty()
