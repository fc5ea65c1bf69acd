"""Column expressions, readers and writers, lookups, checks."""

import json
import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from auditloom.functions import labels as lb
from auditloom.functions import rules
from auditloom.operators import contract, lookup, metrics
from auditloom.sources import files, sinks


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r.y for r in df.select(expression(F.col("x")).alias("y")).collect()]


def test_keys_and_names(spark):
    uuid = "00075aa8-d81a-4184-8541-b692b78d398a"
    names = [f"{uuid}___FREC_Scab 3335_270deg.JPG", f"X{uuid.upper()}Y___a.jpg", "Leaf_1_flip.png", "Leaf__2.png", "a____b.png", ".hidden"]
    assert column(spark, names, lb.family_of_photo) == [uuid, uuid, "leaf_1", "leaf", "a", ".hidden"]
    assert column(spark, names[2:4], lb.family_of_file) == ["leaf_1_flip", "leaf__2"]
    assert column(spark, ["Ab___c___d.jpg", "none.jpg"], lb.family_of_leaf) == ["Ab", "none"]
    assert column(spark, ["cotton_bacterial_blight_2.jpg", "_X-12.png"], lb.label_from_file) == ["cotton_bacterial_blight", "x"]


def test_parsed_name(spark):
    got = column(spark, ["u1___RS_HL 1234 copy 3_90deg.JPG", "plain.jpg", "u2___Leaf copy_new.png"], lb.parsed_name)
    assert [tuple(r) for r in got] == [("u1", "rs_hl 1234", 1234, "90deg", "3"), ("plain", "plain", None, "", "1"), ("u2", "leaf", None, "new", "2")]


def test_canonical_labels(spark):
    assert column(spark, ["Corn_(maize)___healthy", "Pepper,_bell___Healthy", "Apple___scab", "plain"], lb.merged_class) == ["Corn___healthy", "Pepper___healthy", "Apple___scab", "plain"]
    assert column(spark, ["Rust_train_TEST", "x_valid"], lb.without_split_endings) == ["Rust", "x"]
    assert column(spark, ["Leaf-Blight  spot", "A_b"], lb.snake) == ["leaf_blight_spot", "a_b"]
    assert column(spark, ["brown-spot X"], lb.capital_snake) == ["Brown_spot_x"]
    assert column(spark, ["Leaf Rust_val_test"], lb.count_key) == ["leafrust"]
    assert column(spark, ["1", "No", "TRUE", "maybe", None], lb.read_boolean) == [True, False, True, None, None]


def test_naming_pattern(spark):
    for names, want in ((["1", "2_train"], "numeric_class_ids"), (["1", "b"], "plain_label_names"), (["1", "2"], "numeric_class_ids"), (["a___b"], "crop___disease"), (["a___b", "c"], "mixed (crop___disease + other)"), ([], "unknown")):
        df = spark.createDataFrame([(n,) for n in names], "x string")
        assert df.agg(lb.naming_pattern(F.col("x")).alias("p")).first().p == want


def test_rules(spark):
    df = spark.createDataFrame([("x___healthy", 0.1), ("a", 0.59), ("a", 0.6), ("a", 0.85), ("a", 0.86)], "name string, conf double")
    assert [r.s.percent for r in df.select(rules.severity(F.col("name"), F.col("conf")).alias("s")).collect()] == [0, 15, 40, 40, 75]
    w = spark.createDataFrame([("Late blight", 80.0, 2), ("Late blight", 80.0, 1), ("scab", 80.0, 9), ("scab", 81.0, 0), ("rust", None, 1)], "d string, h double, r int")
    assert [r.x for r in w.select(rules.weather_risk(F.col("d"), F.col("h"), F.col("r")).alias("x")).collect()] == ["HIGH", "MODERATE", "MODERATE", "HIGH", "UNKNOWN"]
    assert [[s.step for s in x] for x in column(spark, ["- One. Two\n-Three.\n\n", ""], rules.steps)] == [["One.", "Two", "Three."], []]
    assert column(spark, ["2024-03-01 06:00:00", "bad text"], rules.day_label) == ["Fri", "bad"]


def test_resolve_labels(spark):
    classes = metrics.class_table(spark, ["Rice___Brown_spot", "Wheat___mildew", "Wheat___yellow_rust"])
    said = spark.createDataFrame([(x,) for x in ("rice_brown_spots", "Rice brown-spot", "wheat_powdery_mildew", "corn_rust", "rice")], "label string")
    got = {r.label: (r.name, r.how) for r in lookup.resolve_labels(said, classes, aliases={"wheat_powdery_mildew": "Wheat___mildew", "rice": "Oat___rust"}).collect()}
    assert got["wheat_powdery_mildew"] == ("Wheat___mildew", "alias") and got["Rice brown-spot"] == ("Rice___Brown_spot", "exact")
    assert got["rice_brown_spots"] == ("Rice___Brown_spot", "fuzzy(0.95)")
    assert got["corn_rust"] == got["rice"] == (None, "unmatched")


def test_fuzzy_labels_against_all_pairs(spark):
    """The same answers as from the ratios of all pairs of a crop, with few of them computed."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    classes = [f"{crop}___{rng.choice(words)}_{rng.choice(words)}" for crop in ("Rice", "Wheat") for _ in range(150)] + ["Rice___", "Rice___ab"]
    said = set()
    for name in classes + classes[:60]:
        crop, rest = name.split("___")
        t = list(rest)
        for _ in range(rng.randrange(4)):
            t.insert(rng.randrange(len(t) + 1), rng.choice("aeiou_"))
        said.add(f"{crop.lower()}_{''.join(t)}")
    said |= {"rice_", "rice_zzzz", "rice_ba", "corn_leaf"}
    norm = lambda x: re.sub("[^a-z0-9]", "", x.lower())
    want = {}
    for label in said:
        crop, mine = label.split("_", 1)
        if any(norm(label) == norm(c) for c in classes):
            continue
        best = max(((SequenceMatcher(None, norm(mine), norm(c.split("___")[1])).ratio(), -i) for i, c in enumerate(classes) if norm(c.split("___")[0]) == norm(crop)), default=(0, 0))
        want[label] = classes[-best[1]] if best[0] >= 0.5 else None
    labels = spark.createDataFrame([(x,) for x in sorted(said)], "label string")
    table = metrics.class_table(spark, classes)
    got = {r.label: r.name for r in lookup.resolve_labels(labels, table).collect()}
    assert {k: got[k] for k in want} == want
    open_ = spark.createDataFrame([(x, norm(x.split("_", 1)[0]), norm(x.split("_", 1)[1])) for x in want], "label string, crop string, mine string")
    named = spark.createDataFrame([(i, c, norm(c.split("___")[0]), norm(c.split("___")[1])) for i, c in enumerate(classes)], "idx int, name string, crop string, rest string")
    first, rest = lookup.likely_pairs(open_, named, 0.5)
    assert first.count() + rest.count() < 0.05 * open_.join(named, "crop").count()


def test_lookup_fallback_with_nulls(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "key string")
    one, two = spark.createDataFrame([("a", "1")], "key string, value string"), spark.createDataFrame([("a", "9"), ("b", "2")], "key string, value string")
    got = {r.key: (r.value, r.source) for r in lookup.lookup_with_fallback(rows, "key", [one, two], "value", F.lit("none")).collect()}
    assert got == {"a": ("1", 1), "b": ("2", 2), "z": ("none", 0), None: ("none", 0)}


def test_contract_report(spark):
    classes = metrics.class_table(spark, ["a", "b", "b", " c"])
    got = {r.name: r.ok for r in contract.report(contract.class_list_checks(classes, 4)).collect()}
    assert got == {"no blank names": True, "no padded names": False, "unique names": False, "class count": True, "sorted names": False}
    doc = json.loads(contract.as_json(contract.report(contract.class_list_checks(classes, 4))).first().json)
    assert doc["ok"] is False and len(doc["checks"]) == 5


def test_file_sources_and_memo(spark, tmp_path):
    for split, label, name, body in (("train", "A", "x.JPG", b"1"), ("train", "A", "n.txt", b"2"), ("val", "b", "y.png", b"1")):
        (tmp_path / split / label).mkdir(parents=True, exist_ok=True)
        (tmp_path / split / label / name).write_bytes(body)
    found = files.list_images(spark, str(tmp_path), content=True)
    assert sorted((r.split, r.label, r.name) for r in found.collect()) == [("train", "A", "x.JPG"), ("val", "b", "y.png")]
    assert files.with_digests(found).select("digest").distinct().count() == 1
    assert [r.split for r in files.missing_splits(found).collect()] == ["test"]
    counts = files.count_images(files.list_images(spark, str(tmp_path)), metrics.class_table(spark, ["A", "b", "c"]))
    assert {r.name: r.n for r in counts.collect()} == {"A": 1, "b": 1, "c": 0}


def test_csv_json_text_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿name,conf,ok\nx,0.5,yes\ny,,False\n".encode())
    got = files.read_csv(spark, str(tmp_path / "a.csv"), "name string, conf double, ok string", ("ok",)).collect()
    assert [tuple(r) for r in got] == [("x", 0.5, True), ("y", None, False)]
    (tmp_path / "l.json").write_text('["b", "a"]')
    (tmp_path / "m.json").write_text('{"10": "k", "9": "j"}')
    assert [r.name for r in files.read_json_list(spark, str(tmp_path / "l.json")).orderBy("idx").collect()] == ["b", "a"]
    assert [r.name for r in files.read_json_list(spark, str(tmp_path / "m.json")).orderBy("idx").collect()] == ["j", "k"]
    (tmp_path / "r.json").write_text('{"x": {"title": "T"}, "y": {"title": "U", "urgency": "high"}}')
    recs = files.read_keyed_records(spark, str(tmp_path / "r.json"), "title:string,urgency:string", {"urgency": "medium"})
    assert {r.key: r.urgency for r in recs.collect()} == {"x": "medium", "y": "high"}
    (tmp_path / "n.txt").write_text("12 leaf rust\nplain name\n\n")
    assert [tuple(r) for r in files.read_numbered_list(spark, str(tmp_path / "n.txt")).collect()] == [(12, "leaf rust"), (None, "plain name")]


def test_forecast(spark):
    doc = json.dumps({"list": [{"dt": 1, "main": {"temp": 10.0, "humidity": 80}, "weather": [{"main": "Rain", "description": "r"}], "dt_txt": "2024-01-01 00:00:00"}, {"dt": 2, "main": {"temp": 20.0}, "weather": []}], "city": {"name": "X"}})
    r = files.forecast_summary(files.forecast_slots(spark.createDataFrame([(doc,)], "value string"))).first()
    assert (r.city, r.humidity, r.temp, r.rain_slots) == ("X", 40.0, 15.0, 1)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.5, True)], "f string, confidence double, correct boolean").withColumn("in_top5", F.lit(False))
    sinks.write_predictions(rows, str(tmp_path / "p"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "p"), header=True).collect()] == [("a", "0.500000", "1", "0")]
    plan = spark.createDataFrame([("p1", "train", "a")], "path string, action string, label string")
    data = spark.createDataFrame([("p1", "body")], "path string, content string")
    sinks.write_plan(plan, data, str(tmp_path / "out"), ok=True)
    assert not (tmp_path / "out").exists()
    sinks.write_plan(plan, data, str(tmp_path / "out"), ok=True, apply=True)
    assert spark.read.parquet(str(tmp_path / "out")).first().action == "train"


def test_dates_after_the_year_9999_have_no_sign(spark):
    days = spark.createDataFrame([(0,), (2932896,), (2932897,), (5999999,), (None,)], "day long")
    got = [r[0] for r in days.select(rules.date_label(F.col("day") * 86_400_000)).collect()]
    assert got == ["01 Jan 1970", "31 Dec 9999", "01 Jan 10000", "10 Jun 18397", None]
