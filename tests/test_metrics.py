"""Aggregates over predictions: golden values, zero denominators, ties, empty tables."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.operators import metrics as m

# Published predictions on 16 field photos (true, predicted, confidence).
FIELD = [
    ("Cotton___bacterial_blight", "Cotton___bacterial_blight", 0.999918),
    ("Cotton___bacterial_blight", "Cotton___bacterial_blight", 1.0),
    ("Rice___healthy", "Rice___healthy", 0.99988),
    ("Rice___healthy", "Rice___healthy", 0.999909),
    ("Wheat___healthy", "Wheat___healthy", 0.598646),
    ("Wheat___healthy", "Wheat___leaf_blight", 0.275867),
    ("Rice___Bacterial_leaf_blight", "Rice___Sheath_blight", 0.760647),
    ("Rice___Bacterial_leaf_blight", "Rice___Sheath_blight", 0.890921),
    ("Rice___Brown_spot", "Wheat___leaf_blight", 0.624619),
    ("Rice___Brown_spot", "Wheat___blast", 0.749357),
    ("Tomato___Early_blight", "Wheat___tan_spot", 0.309992),
    ("Tomato___Early_blight", "Cotton___bacterial_blight", 0.923007),
    ("Wheat___mildew", "Wheat___mildew", 0.991876),
    ("Wheat___mildew", "Wheat___mildew", 0.999237),
    ("Wheat___yellow_rust", "Wheat___brown_rust", 0.597271),
    ("Wheat___yellow_rust", "Wheat___brown_rust", 0.703516),
]
# The published sweep over them (threshold, shown, correct).
SWEEP = [(0.0, 16, 7), (0.5, 14, 7), (0.6, 12, 6), (0.65, 11, 6), (0.7, 11, 6), (0.75, 9, 6), (0.8, 8, 6), (0.85, 8, 6), (0.9, 7, 6), (0.95, 6, 6)]


@pytest.fixture
def field(spark):
    return spark.createDataFrame(FIELD, "truth string, pred string, conf double")


def test_gate_sweep_golden(field):
    got = m.gate_sweep(field, [t for t, _, _ in SWEEP]).orderBy("threshold").collect()
    assert [(r.threshold, r.shown, r.correct) for r in got] == SWEEP
    assert got[-1].precision == 1.0 and got[-1].recall == 6 / 16 and got[-1].coverage == 6 / 16
    assert m.pick_gate(m.gate_sweep(field, [t for t, _, _ in SWEEP])).first().threshold == 0.95


def test_gate_that_shows_nothing_has_null_precision(spark):
    rows = spark.createDataFrame([("a", "a", 0.1)], "truth string, pred string, conf double")
    r = m.gate_sweep(rows, [0.5]).first()
    assert (r.shown, r.correct, r.precision, r.recall) == (0, 0, None, 0.0)


def test_group_accuracy_golden(field):
    rolled = m.group_rollup(field, lambda c: F.split(c, "___")[0]).collect()
    assert {r.group: (r.correct, r.n) for r in rolled} == {"Cotton": (2, 2), "Wheat": (3, 6), "Rice": (2, 6), "Tomato": (0, 2)}


def test_class_scores_without_support_or_predictions(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "a")], "truth string, pred string")
    classes = m.class_table(spark, ["a", "b", "c"])
    got = {r.name: r for r in m.class_scores(rows, classes).collect()}
    assert (got["a"].precision, got["a"].recall, got["a"].f1) == (0.5, 0.5, 0.5)
    assert (got["b"].precision, got["b"].recall, got["b"].f1) == (0.0, 0.0, None)
    assert (got["c"].support, got["c"].precision, got["c"].recall) == (0, None, None)
    zero = {r.name: r for r in m.class_scores(rows, classes, zero_division=0.0).collect()}
    assert zero["c"].f1 == 0.0
    mean = m.averages(m.class_scores(rows, classes)).first()
    assert mean.macro_precision == pytest.approx(0.25) and mean.weighted_recall == pytest.approx(1 / 3)


def test_confusion_wide_is_dense(spark):
    rows = spark.createDataFrame([("a", "b")], "truth string, pred string")
    got = {r.truth: (r.a, r.b) for r in m.confusion_wide(rows, ["a", "b"]).collect()}
    assert got == {"a": (0, 1), "b": (0, 0)}


def test_mispairs_order(spark):
    rows = spark.createDataFrame([("a", "b", 0.5)] * 2 + [("b", "a", 0.7)] * 2 + [("a", "c", 0.1)], "truth string, pred string, conf double")
    got = [(r.truth, r.pred, r.n) for r in m.mispairs(rows, 2).collect()]
    assert got == [("a", "b", 2), ("b", "a", 2)]


def test_empty_tables(spark):
    rows = spark.createDataFrame([], "id int, truth string, pred string, conf double, family int")
    assert m.accuracy(rows).first().top1 is None
    assert m.gate_sweep(rows, [0.5]).count() == 0
    assert m.family_accuracy(rows).first().families == 0
    assert m.bootstrap_interval(rows).first().n == 0


def test_bootstrap_brackets_accuracy(spark):
    rows = spark.range(4000).select("id", F.lit("a").alias("truth"), F.when(F.col("id") % 10 < 9, "a").otherwise("b").alias("pred"))
    r = m.bootstrap_interval(rows).first()
    assert r.accuracy == 0.9 and 0.88 < r.low < 0.9 < r.high < 0.92


def test_bootstrap_against_loops(spark):
    """Drawn by loops from the same counters; and a Poisson(1) number of the right mean and spread."""
    bits = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
    number = lambda u: sum(u >= x for x in m.POISSON_STEPS)
    rows, accuracies = [(i, "a", "a" if i % 3 else "b") for i in range(200)] + [(None, "a", None)], []
    for replicate in range(50):
        times = [number(bits(f"7:{replicate}:{bits('' if i is None else str(i)) % 20}")) for i, _, _ in rows]
        accuracies.append(sum(t * (a == b) for t, (_, a, b) in zip(times, rows)) / sum(times))
    got = m.bootstrap_interval(spark.createDataFrame(rows, "id long, truth string, pred string"), replicates=50, blocks=20, seed=7).first()
    want = np.percentile(accuracies, [2.5, 97.5])
    assert (got.n, got.low, got.high) == (201, pytest.approx(want[0]), pytest.approx(want[1]))
    drawn = [number(bits(f"1:{i}")) for i in range(20_000)]
    assert np.mean(drawn) == pytest.approx(1, abs=0.03) and np.var(drawn) == pytest.approx(1, abs=0.05)


def test_histogram_keeps_empty_bins(spark):
    rows = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (None,)], "x double")
    assert [r.n for r in m.histogram(rows, F.col("x"), [0.0, 0.5, 0.75, 1.0]).orderBy("bin").collect()] == [1, 1, 0]
