import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from annoframe.functions import binning as B
from annoframe.functions import vocabulary as V
from annoframe.operators import bins


def numbers(spark, values):
    return spark.createDataFrame([(float(v) if v is not None else None,) for v in values], "v double")


def numpy_edges(values, labels, tolerance=None, lower_range=None):
    values = np.array([v for v in values if v is not None and not math.isnan(v)], dtype=float)
    if tolerance is not None and len(values):
        values = values[np.abs(values - values.mean()) < tolerance * values.std()]
    span = None if lower_range is None or not len(values) else (lower_range, values.max())
    return np.histogram(values, bins=labels, range=span)[1]


def fitted(spark, values, labels=7, tolerance=None, lower_range=None):
    spec = bins.BinSpec("v", "out", tuple(f"l{i}" for i in range(labels)), tolerance, lower_range)
    return bins.fit_bin_edges(numbers(spark, values), [spec]).first()["out"]


RANDOM = np.random.default_rng(3)


@pytest.mark.parametrize(
    ("values", "tolerance", "lower_range"),
    [
        (RANDOM.normal(5, 2, 500).tolist(), None, None),
        (RANDOM.normal(5, 2, 500).tolist() + [900.0], 4, None),
        (RANDOM.lognormal(1, 1, 500).tolist(), 2, None),
        (RANDOM.lognormal(1, 1, 500).tolist(), 3.5, -1.5),
        (RANDOM.lognormal(1, 1, 500).tolist(), 3.5, 0.0),
        ([4.0] * 30, None, None),
        ([1.0] * 30 + [1000.0], 3, None),
        ([7.0], None, None),
        ([], None, None),
        ([], 4, None),
        ([2.0, None, math.nan, 9.0], None, None),
    ],
)
def test_edges_equal_numpy(spark, values, tolerance, lower_range):
    expected = numpy_edges(values, 7, tolerance, lower_range)
    actual = fitted(spark, values, 7, tolerance, lower_range)
    np.testing.assert_allclose(actual, expected, rtol=1e-12, atol=1e-12)
    assert actual == sorted(actual)


def test_constant_column_with_tolerance_keeps_nothing(spark):
    assert fitted(spark, [4.0] * 30, 5, 2) == pytest.approx([0.0, 0.2, 0.4, 0.6, 0.8, 1.0])


def test_lower_range_above_every_value_fails(spark):
    with pytest.raises(PySparkException, match="lower range"):
        fitted(spark, [1.0, 2.0], 3, None, 5.0)


def numpy_label(value, edges, labels):
    position = int(np.searchsorted(edges, value, side="left"))
    return labels[min(max(position - 1, 0), len(labels) - 1)]


@pytest.mark.parametrize("edge_count", [4, 5, 6, 8])
def test_labels_equal_searchsorted(spark, edge_count):
    labels = ["a", "b", "c", "d", "e"]
    edges = [0.0, 5.0, 10.0, 20.0, 21.5, 30.0, 40.0, 41.0][:edge_count]
    values = [-3, 0, 0.1, 5, 5.1, 10, 15, 20, 21.5, 21.6, 30, 35, 40, 41, 99, math.nan]
    rows = numbers(spark, values).select("v", B.interval_label(F.col("v"), edges, labels).alias("label")).collect()
    assert [row["label"] for row in rows] == [numpy_label(v, edges, labels) for v in values]


def test_null_has_no_label(spark):
    row = numbers(spark, [None]).select(B.interval_label(F.col("v"), [0, 1, 2], ["a", "b"]).alias("l")).first()
    assert row["l"] is None


def test_fitted_labels_equal_numpy(spark):
    values = RANDOM.normal(50, 20, 3000).tolist() + [1e6, -1e6, None]
    spec = bins.BinSpec("v", "noise", V.NOISE_LABELS, 3.5)
    rows = bins.label_columns(numbers(spark, values), [spec]).collect()
    edges = numpy_edges(values, 7, 3.5)
    for row in rows:
        expected = None if row["v"] is None else numpy_label(row["v"], edges, V.NOISE_LABELS)
        assert row["noise"] == expected
    assert {row["noise"] for row in rows} == {*V.NOISE_LABELS, None}


def test_given_edges_and_fitted_edges_together(spark):
    df = spark.createDataFrame([(float(i), float(i * i)) for i in range(100)], "a double, `si-sdr` double")
    specs = [bins.BinSpec("a", "x", ("lo", "hi"), None), bins.BinSpec("si-sdr", "y", ("lo", "hi"), None)]
    rows = bins.label_columns(df, specs, {"x": [0.0, 10.0, 99.0]}).collect()
    assert sum(row["x"] == "lo" for row in rows) == 11
    assert sum(row["y"] == "lo" for row in rows) == sum(i * i <= 99 * 99 / 2 for i in range(100))


def test_fit_on_a_part_and_label_all(spark):
    df = spark.createDataFrame([(float(i), "train" if i < 10 else "test") for i in range(40)], "v double, split string")
    spec = bins.BinSpec("v", "label", ("lo", "hi"), None)
    rows = bins.label_columns(df, [spec], fit_on=df.where("split = 'train'")).collect()
    assert sum(row["label"] == "lo" for row in rows) == 5


def test_outliers(spark):
    values = RANDOM.normal(0, 1, 200).tolist() + [50.0, None, math.nan]
    kept = [row["v"] for row in bins.without_outliers(numbers(spark, values), "v", 3).collect()]
    clean = np.array(values[:201])
    assert sorted(kept) == pytest.approx(sorted(clean[np.abs(clean - clean.mean()) < 3 * clean.std()]))


def test_histograms_equal_numpy(spark):
    values = RANDOM.normal(10, 3, 2000).round(1).tolist() + [60.0]
    rows = bins.histogram_before_after(numbers(spark, values), "v", 4, 50).collect()
    clean = np.array(values)
    near = clean[np.abs(clean - clean.mean()) < 4 * clean.std()]
    for series, part in (("before", clean), ("after", near)):
        counts, edges = np.histogram(part, bins=50)
        own = sorted((row for row in rows if row["series"] == series), key=lambda row: row["slot"])
        assert [row["rows"] for row in own] == counts.tolist()
        assert [row["slot_from"] for row in own] == pytest.approx(edges[:-1].tolist())


def test_histogram_per_category_lists_empty_series(spark):
    df = spark.createDataFrame([("m", 1.0), ("m", 2.0), ("f", 5.0), ("x", 9.0)], "g string, v double")
    rows = bins.histogram_by(df, "g", "v", ("m", "f", "none"), 4).collect()
    filled = {(row["series"], row["slot"]): row["rows"] for row in rows if row["rows"]}
    assert filled == {("m", 0): 1, ("m", 3): 1, ("f", 2): 1}
    assert len(rows) == 12


def test_histograms_of_all_columns_equal_numpy(spark):
    columns = {
        "a": RANDOM.normal(10, 3, 1500).round(1).tolist() + [90.0],
        "b": [None, math.nan] + RANDOM.uniform(-5, 5, 1499).tolist(),
        "c": [4.0] * 1501,
        "d": [None] * 1501,
    }
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{name} double" for name in columns))
    tolerances = {"a": 4.0, "b": 1.0, "c": None, "d": 2.0}
    specs = [bins.BinSpec(name, f"{name} label", ("x", "y", "z"), tolerances[name]) for name in columns]
    rows = bins.histogram_all(df, specs, 20).collect()
    assert len(rows) == 4 * 2 * 20
    for name, values in columns.items():
        clean = np.array([value for value in values if value is not None and not math.isnan(value)])
        near = clean if tolerances[name] is None else clean[np.abs(clean - clean.mean()) < tolerances[name] * clean.std()] if len(clean) else clean
        for series, part in (("before", clean), ("after", near)):
            own = sorted((row for row in rows if (row["label"], row["series"]) == (f"{name} label", series)), key=lambda row: row["slot"])
            counts, edges = np.histogram(part, bins=20)
            assert [row["rows"] for row in own] == counts.tolist()
            assert [row["slot_from"] for row in own] + [own[-1]["slot_to"]] == pytest.approx(edges.tolist())
            assert all(row["edges"] == pytest.approx(np.histogram_bin_edges(part, 3).tolist()) for row in own)
