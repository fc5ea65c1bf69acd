"""Splits and samples: families stay whole, cutoffs, promotion against a plain loop."""

import random

from pyspark.sql import functions as F

from auditloom.operators import integrity, splits


def rows_of(spark, sizes):
    """sizes: {label: {family: rows}}"""
    data = [(label, fam, i) for label, fams in sizes.items() for fam, n in fams.items() for i in range(n)]
    return spark.createDataFrame(data, "label string, family string, i int")


def test_cutoff(spark):
    got = spark.range(0, 12).select(splits.cutoff(F.col("id"), 0.8).alias("c")).collect()
    assert [r.c for r in got] == [0, 1, *[max(1, min(int(n * 0.8), n - 1)) for n in range(2, 12)]]


def test_families_stay_whole_and_promotion_follows_the_loop(spark):
    rng = random.Random(7)
    sizes = {f"c{k}": {f"f{j}": rng.randint(1, 5) for j in range(rng.randint(1, 14))} for k in range(12)}
    rows = rows_of(spark, sizes)
    first = {(r.label, r.family): r.side for r in splits.split_families(rows).collect()}
    for least in (0, 6, 1000):
        got = {(r.label, r.family): r.side for r in splits.split_families(rows, least_val=least).collect()}
        assert set(got) == {(c, f) for c in sizes for f in sizes[c]}
        for c, fams in sizes.items():
            import hashlib

            order = sorted(fams, key=lambda f: (hashlib.md5(f"42:{f}".encode()).hexdigest(), f))
            train = [f for f in order if first[c, f] == "train"]
            val = [f for f in order if first[c, f] == "val"]
            assert order[: len(train)] == train
            while sum(fams[f] for f in val) < least and len(train) > 1:
                val.append(train.pop())
            assert {f for f in fams if got[c, f] == "val"} == set(val)


def test_compat_split_is_pythons_shuffle(spark):
    sizes = {"a": {f"f{j}": 1 for j in range(11)}, "b": {"only": 3}}
    got = {(r.label, r.family): r.side for r in splits.compat_split(rows_of(spark, sizes)).collect()}
    keys = sorted(sizes["a"])
    random.Random(42).shuffle(keys)
    assert {k for k in keys if got["a", k] == "train"} == set(keys[:8]) and got["b", "only"] == "train"


def test_sample_even(spark):
    rows = spark.range(25).select(F.lit("a").alias("label"), "id").union(spark.range(3).select(F.lit("b"), "id"))
    got = splits.sample_even(rows, ["label"], ["id"], 10)
    assert sorted(r.id for r in got.filter("label = 'a'").collect()) == list(range(0, 20, 2))
    assert got.filter("label = 'b'").count() == 3


def test_quota_is_not_made_up_for(spark):
    rows = spark.range(100).select(F.when(F.col("id") < 2, "a").when(F.col("id") < 50, "b").otherwise("c").alias("label"), "id")
    got = {r.label: r["count"] for r in splits.sample_quota(rows, "label", "id", 11).groupBy("label").count().collect()}
    assert got == {"a": 2, "b": 4, "c": 3}


def test_collisions(spark):
    rows = spark.createDataFrame([("t", "x.png", 1), ("t", "x.png", 2), ("t", "y", 3), ("t", "y", 4), ("v", "x.png", 5)], "split string, name string, i int")
    got = [r.destination for r in splits.rename_collisions(rows, ["split"], "name", ["i"]).orderBy("i").collect()]
    assert got == ["x.png", "x__dup1.png", "y", "y__dup1", "x.png"]


def test_quarantine_precedence(spark):
    data = [
        ("b/2", "d1", "b", "val"), ("a/1", "d1", "a", "train"),  # one content, two labels
        ("a/Z", "d2", "a", "val"), ("a/y", "d2", "a", "train"), ("a/x", "d2", "a", "train"),  # copies
        ("a/w", "d3", "a", "val"), ("a/v", "d4", "a", "train"),
    ]
    files = spark.createDataFrame(data, "path string, digest string, label string, split string")
    got = {r.path: r.reason for r in integrity.quarantine_plan(files, F.col("split") == "val").collect()}
    assert got == {
        "b/2": "cross_class_duplicate", "a/1": "cross_class_duplicate", "a/x": None, "a/y": "same_class_duplicate",
        "a/Z": "same_class_duplicate", "a/w": "mislabelled", "a/v": None,
    }


def test_all_of_a_class_quarantined(spark):
    files = spark.createDataFrame([("p", "d", "a", "val")], "path string, digest string, label string, split string")
    assert integrity.quarantine_plan(files, F.lit(True)).first().reason == "mislabelled"
    assert integrity.quarantine_plan(files.limit(0)).count() == 0


def test_verify_split(spark):
    files = spark.createDataFrame([("a", "train", "d1", "f1"), ("a", "val", "d1", "f2"), ("b", "train", "d3", "f3"), ("c", "train", "d4", "f4"), ("c", "val", "d5", "f5")], "label string, split string, digest string, family string")
    got = {r.label: (r.shared_digests, r.shared_families, r.ok) for r in integrity.verify_split(files).collect()}
    assert got == {"a": (1, 0, False), "b": (0, 0, False), "c": (0, 0, True)}
