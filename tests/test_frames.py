import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from annoframe.functions import signal as S
from annoframe.functions import vocabulary as V
from annoframe.operators import frames

RANDOM = np.random.default_rng(11)
RATE = V.VAD_FRAMES_PER_SECOND


def voice(spark):
    """Frames and time ranges of a few segments, with their expected means by brute force."""
    frame_rows, range_rows, expected, seconds = [], [], {}, {}
    for name, count, ranges in (
        ("long", 700, [(0.0, 1.0), (0.5, 4.2), (9.0, 11.0)]),
        ("word", 200, [(64 / RATE, 128 / RATE + 1e-6)]),
        ("past", 50, [(0.5, 90.0)]),
        ("none", 30, []),
        ("empty", 30, [(0.1, 0.1), (0.3001, 0.3002)]),
        ("zeros", 10, [(0.0, 1.0)]),
    ):
        snr = RANDOM.normal(30, 10, count) * (RANDOM.random(count) > 0.2) * (name != "zeros")
        c50 = RANDOM.normal(50, 10, count) * (RANDOM.random(count) > 0.2) * (name != "zeros")
        frame_rows += [(name, i, float(snr[i]), float(c50[i])) for i in range(count)]
        range_rows += [(name, float(a), float(b)) for a, b in ranges]
        mask = np.zeros(count, bool)
        for a, b in ranges:
            mask[int(a * RATE) : int(b * RATE)] = True
        mask &= ~((snr == 0.0) & (c50 == 0.0))
        expected[name] = (snr[mask].mean(), c50[mask].mean()) if mask.any() else (None, None)
        seconds[name] = sum(b - a for a, b in ranges)
    return (
        spark.createDataFrame(frame_rows, "segment_id string, frame_idx int, snr double, c50 double"),
        spark.createDataFrame(range_rows, "segment_id string, start double, end double"),
        expected,
        seconds,
    )


def test_masked_means(spark):
    table, ranges, expected, _ = voice(spark)
    rows = {row["segment_id"]: (row["snr"], row["c50"]) for row in frames.masked_means(table, ranges).collect()}
    assert rows.keys() == expected.keys()
    for name, pair in expected.items():
        assert rows[name] == (pytest.approx(pair) if pair[0] is not None else pair)


def test_speech_duration(spark):
    table, ranges, _, seconds = voice(spark)
    ids = table.select("segment_id").distinct()
    rows = {row["segment_id"]: row["speech_duration"] for row in frames.speech_duration(ids, ranges).collect()}
    assert rows == pytest.approx(seconds)


def test_mean_and_std(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 3.0)], "segment_id string, f0 double")
    rows = {row["segment_id"]: row for row in frames.mean_and_std(df, "f0", "p").collect()}
    assert rows["a"]["p_std"] == pytest.approx(np.std([1, 2, 4], ddof=1))
    assert (rows["b"]["p_mean"], rows["b"]["p_std"]) == (3.0, None)


def test_array_statistics(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0],), ([3.0],), ([],)], "x array<float>")
    rows = df.select(S.array_mean(F.col("x")).alias("m"), S.array_sample_std(F.col("x")).alias("s")).collect()
    assert rows[0]["m"] == pytest.approx(7 / 3)
    assert rows[0]["s"] == pytest.approx(np.std([1, 2, 4], ddof=1))
    assert (rows[1]["m"], rows[1]["s"]) == (3.0, None)
    assert (rows[2]["m"], rows[2]["s"]) == (None, None)


@pytest.mark.parametrize("run", [4096, 8, 4])
@pytest.mark.parametrize("space", ["linear", "log2"])
def test_interpolation(spark, monkeypatch, run, space):
    monkeypatch.setattr(frames, "RUN", run)
    rows, expected = [], {}
    for name, count, share in (("a", 150, 0.3), ("b", 40, 0.9), ("gap", 100, 0.02), ("none", 12, 0.0), ("one", 1, 1.0)):
        f0 = RANDOM.uniform(80, 300, count)
        voiced = RANDOM.random(count) < share
        if name == "gap":
            voiced[:] = False
            voiced[[37, 81]] = True
        rows += [(name, i, float(f0[i]), 0.065 if voiced[i] else 0.0649) for i in range(count)]
        where = np.flatnonzero(voiced)
        level = f0 if space == "linear" else np.log2(f0)
        line = np.interp(np.arange(count), where, level[where]) if len(where) else level
        expected[name] = np.where(voiced, f0, line if space == "linear" else 2.0**line)
    df = spark.createDataFrame(rows, "segment_id string, frame_idx int, f0 double, periodicity double")
    result = frames.interpolate_unvoiced(df, "f0", "periodicity", space=space).toPandas()
    assert len(result) == len(rows)
    for name, values in expected.items():
        own = result[result.segment_id == name].sort_values("frame_idx")
        np.testing.assert_allclose(own.f0.to_numpy(), values, rtol=1e-9)


def test_interpolation_rejects_other_spaces(spark):
    with pytest.raises(ValueError, match="linear or log2"):
        frames.interpolate_unvoiced(spark.range(1), "id", "id", "id", "id", space="mel")


def test_stems(spark):
    stems = RANDOM.normal(0, 1, (4, 2, 20))
    rows = [("a", s, c, t, float(stems[s, c, t])) for s in range(4) for c in range(2) for t in range(20)]
    df = spark.createDataFrame(rows, "segment_id string, stem int, channel int, t int, amp double")
    mixed = frames.stem_mixdown(df.withColumn("n", F.lit(15)), 3, length="n").toPandas().sort_values("t")
    assert len(mixed) == 15
    np.testing.assert_allclose(mixed.vocals, stems[-1].mean(0)[:15])
    np.testing.assert_allclose(mixed.others, stems[:-1].sum(0).mean(0)[:15])


def test_mixdown_of_many_channels(spark):
    rows = [("s", stem, channel * 1000, t, float(stem * 100 + channel + t)) for stem in range(2) for channel in range(100) for t in range(3)]
    df = spark.createDataFrame(rows, "segment_id string, stem int, channel int, t int, amp double")
    for row in frames.stem_mixdown(df, 1).collect():
        assert (row["others"], row["vocals"]) == (49.5 + row["t"], 149.5 + row["t"])


@pytest.mark.parametrize("chunk", [32, 3, 1])
def test_stems_as_arrays(spark, monkeypatch, chunk):
    monkeypatch.setattr(frames, "CHUNK", chunk)
    rows, expected = [], {}
    for name, stems, channels, samples in (("a", 4, 2, 70), ("b", 2, 1, 32), ("one", 1, 3, 1), ("long", 3, 2, 200)):
        x = RANDOM.normal(0, 1, (stems, channels, samples))
        rows += [(name, s, c, x[s, c].tolist(), min(samples, 90)) for s in range(stems) for c in range(channels)]
        others = x[:-1].sum(0).mean(0) if stems > 1 else np.full(samples, np.nan)
        expected[name] = x[-1].mean(0)[:90], others[:90]
        rows = [row if row[0] != name else (*row[:4], row[4]) for row in rows]
    last = {"a": 3, "b": 1, "one": 0, "long": 2}
    df = spark.createDataFrame([(*row, row[1] == last[row[0]]) for row in rows] + [("empty", 0, 0, [], 9, True), ("none", 0, 0, None, 9, True)],
                               "segment_id string, stem int, channel int, samples array<double>, n int, voice boolean")
    mixed = {row["segment_id"]: row for row in frames.stem_mixdown_arrays(df.repartition(5), F.col("voice"), length="n").collect()}
    assert mixed.keys() == expected.keys()
    for name, (vocals, others) in expected.items():
        np.testing.assert_allclose(np.array(mixed[name]["vocals"], float), vocals)
        np.testing.assert_allclose(np.array(mixed[name]["others"], float), others)


def test_stems_as_arrays_of_different_lengths_equal_the_long_form(spark):
    rows = [("s", s, c, RANDOM.normal(0, 1, 5 + 31 * s + 7 * c).tolist()) for s in range(3) for c in range(2)]
    df = spark.createDataFrame(rows, "segment_id string, stem int, channel int, samples array<double>")
    long = df.select("segment_id", "stem", "channel", F.posexplode("samples").alias("t", "amp"))
    plain = frames.stem_mixdown(long, 2).toPandas().sort_values("t")
    row = frames.stem_mixdown_arrays(df, F.col("stem") == 2).first()
    np.testing.assert_allclose(np.array(row["vocals"], float), plain.vocals)
    np.testing.assert_allclose(np.array(row["others"], float), plain.others)


def test_rates_and_durations(spark):
    df = spark.createDataFrame(
        [("hɛloʊ", 2.0, [0.0] * 32, 16), ("abc", 0.0, [0.0] * 8, 0), ("", 3.0, [], 16), (None, None, None, 16)],
        "phonemes string, d double, x array<float>, sr int",
    )
    rows = df.select(
        S.speaking_rate(F.col("phonemes"), F.col("d")).alias("r"),
        S.sample_seconds(F.col("x"), F.col("sr")).alias("s"),
        F.size(S.first_seconds(F.col("x"), F.col("sr"), 1)).alias("cut"),
    ).collect()
    assert [row["r"] for row in rows] == [2.5, pytest.approx(300.0), 0.0, None]
    assert [row["s"] for row in rows] == [2.0, None, 0.0, None]
    assert [row["cut"] for row in rows[:3]] == [16, 0, 0]


def test_flat_samples(spark):
    df = spark.createDataFrame([([[1.0, 2.0, 3.0]],)], "x array<array<double>>")
    assert df.select(S.flat_samples(F.col("x"), True).alias("y")).first()["y"] == [1.0, 2.0, 3.0]


def test_hot_segment_is_spread_over_words(spark):
    table = spark.range(64 * 50).select(F.lit("hot").alias("segment_id"), F.col("id").alias("frame_idx"))
    ranges = spark.createDataFrame([("hot", 0.0, 10.0)], "segment_id string, start double, end double")
    words = frames.speech_words(ranges).toPandas()
    assert len(words) == int(10.0 * RATE - 1) // 64 + 1
    total = sum(bin(int(bits) & (2**64 - 1)).count("1") for bits in words.bits)
    assert total == int(10.0 * RATE)
    assert pd.Series(words.word).is_unique
    assert table.count() == 3200
