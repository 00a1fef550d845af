import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException

from annoframe.functions import vocabulary as V
from annoframe.operators import speakers

SCHEMA = "segment_id int, speaker string, gender_ori string, utterance_pitch_mean double"


def corpus(hot=0):
    random = np.random.default_rng(5)
    rows = []
    for i in range(1200):
        number = int(random.integers(0, 90))
        gender = [None, "male", "female", "other"][number % 4] if random.random() < 0.8 else None
        rows.append((i, f"s{number}", gender, float(random.normal(100 + number, 20))))
    rows += [(2000 + i, "s1", "male", 100.0 + i % 7) for i in range(hot)]
    return rows + [(9000, None, "male", 55.0), (9001, "alone", "female", 200.0), (9002, "mute", "male", None)]


def expected(rows):
    frame = pd.DataFrame(rows, columns=["segment_id", "speaker", "gender", "pitch"])
    table = frame.groupby("speaker").agg({"pitch": "mean", "gender": "first"})
    edges = {}
    for gender in ("male", "female"):
        means = table[table.gender == gender].pitch.dropna().to_numpy()
        means = means[np.abs(means - means.mean()) < 2 * means.std()]
        edges[gender] = np.histogram(means, 7)[1]
    labels = {}
    for speaker, row in table.iterrows():
        if row.gender in edges and not np.isnan(row.pitch):
            position = int(np.searchsorted(edges[row.gender], row.pitch))
            labels[speaker] = V.PITCH_LABELS[min(max(position - 1, 0), 6)]
    return {row[0]: labels.get(row[1]) for row in rows}


@pytest.mark.parametrize("hot", [0, 700])
def test_equals_pandas(spark, hot):
    rows = corpus(hot)
    df = spark.createDataFrame(rows, SCHEMA)
    result = speakers.label_by_speaker(df, order_by="segment_id", spread=["segment_id"])
    assert {row["segment_id"]: row["pitch"] for row in result.collect()} == expected(rows)
    assert result.count() == len(rows)


def test_given_edges(spark):
    df = spark.createDataFrame([(1, "a", "male", 100.0), (2, "b", "female", 100.0)], SCHEMA)
    edges = {name: V.PUBLISHED_EDGES[f"pitch_bins_{name}"] for name in V.GENDERS}
    rows = {r["segment_id"]: r["pitch"] for r in speakers.label_by_speaker(df, edges=edges).collect()}
    assert rows == {1: "slightly low-pitch", 2: "very low-pitch"}


def test_strict_rejects_unknown_category(spark):
    df = spark.createDataFrame([(1, "a", "male", 100.0), (2, "b", "None", 90.0)], SCHEMA)
    assert speakers.label_by_speaker(df).where("speaker = 'b'").first()["pitch"] is None
    with pytest.raises(PySparkException, match="no edges for the category of speaker b"):
        speakers.label_by_speaker(df, strict=True).collect()
