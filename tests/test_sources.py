"""Trees of files, text sources, and the streaming count, against what was written."""

import pytest
from pyspark.sql import functions as F

from auditloom.operators import curation, similarity, splits
from auditloom.sources import files as src
from auditloom.sources import sinks
from auditloom.streaming import live


def tree(tmp_path):
    for path in ("train/a/1.JPG", "train/a/2.png", "train/b/3.jpeg", "valid/a/4.webp", "valid/a/notes.txt", "deep/x/y/z/train/a/5.bmp"):
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(path.encode())
    return str(tmp_path)


def test_list_and_count_images(spark, tmp_path):
    root = tree(tmp_path)
    held = src.list_images(spark, root)
    assert sorted((r.split, r.label, r.name, r.length) for r in held.collect()) == [
        ("train", "a", "1.JPG", 13), ("train", "a", "2.png", 13), ("train", "a", "5.bmp", 24), ("train", "b", "3.jpeg", 14), ("valid", "a", "4.webp", 14),
    ]
    assert [r.split for r in src.missing_splits(held, ("train", "val", "valid")).collect()] == ["val"]
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    assert {r.name: r.n for r in src.count_images(held, names).collect()} == {"a": 4, "b": 1, "c": 0}
    assert src.with_digests(src.list_images(spark, root, scope="b", content=True)).select("digest").first()[0] == __import__("hashlib").sha256(b"train/b/3.jpeg").hexdigest()


def test_folder_profile_counts_depth_from_its_root(spark, tmp_path):
    root = tree(tmp_path)
    for above in (root, f"file:{root}"):
        held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
        got = {r.parent.rpartition("/")[2]: (r.folders, r.files, r.is_split_root) for r in src.folder_profile(held, above, deepest=2).collect()}
        assert got == {tmp_path.name: (2, 5, True)}
    assert src.folder_profile(held, root).count() == 2


def test_text_sources(spark, tmp_path):
    (tmp_path / "list.txt").write_text("1 Rice\n\n 12  Wheat rust \nCorn\n")
    assert sorted([(r.idx, r.name) for r in src.read_numbered_list(spark, str(tmp_path / "list.txt")).collect()], key=repr) == [(1, "Rice"), (12, "Wheat rust"), (None, "Corn")]
    (tmp_path / "db.json").write_text('{"a": {"x": "1"}, "b": {"x": "2", "y": "3"}}')
    assert sorted((r.key, r.x, r.y) for r in src.read_keyed_records(spark, str(tmp_path / "db.json"), "x string, y string", {"y": "none"}).collect()) == [("a", "1", "none"), ("b", "2", "3")]
    (tmp_path / "keyed.json").write_text('{"1": "b", "0": "a"}')
    assert sorted((r.idx, r.name) for r in src.read_json_list(spark, str(tmp_path / "keyed.json")).collect()) == [(0, "a"), (1, "b")]
    (tmp_path / "report.txt").write_text("model flatbuffer\n 1,234 bytes\n sha " + "ab" * 8 + "\n60 classes\n")
    assert tuple(src.scrape_report(spark, str(tmp_path / "report.txt")).first()) == (1234, "ab" * 8, 60)
    (tmp_path / "rows.tsv").write_text("a\tb\n1\tyes\n\n2\tFALSE\n")
    assert [(r.a, r.b) for r in src.read_csv(spark, str(tmp_path / "rows.tsv"), "a int, b string", booleans=("b",), separator="\t").collect()] == [(1, True), (2, False)]


def test_forecast(spark):
    doc = '{"city": {"name": "X"}, "list": [{"dt": 1, "main": {"temp": 2.0, "humidity": 50}, "weather": [{"main": "Rain"}], "dt_txt": "t"}, {"dt": 2, "main": {"temp": 4.0}, "weather": []}]}'
    slots = src.forecast_slots(spark.createDataFrame([(doc,)], "value string"))
    assert [(r.slot, r.temp, r.humidity, r.weather) for r in slots.collect()] == [(0, 2.0, 50.0, "Rain"), (1, 4.0, None, None)]
    assert tuple(src.forecast_summary(slots).first()) == ("X", 25.0, 3.0, 1)
    assert src.forecast_slots(spark.createDataFrame([(doc,)], "value string"), most=1).count() == 1


def test_live_history(spark, tmp_path):
    spark.createDataFrame([("a",), ("a",), ("b",)], "label string").write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("label string").json(f"{tmp_path}/in")
    q = live.live_history(stream, "label").writeStream.format("memory").queryName("history").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.label: r.n for r in spark.table("history").collect()} == {"a": 2, "b": 1}


def test_bands_find_every_close_pair(spark):
    """Each band's close values, by counting: no pair within the limit escapes all bands."""
    for limit in range(20):
        bands = similarity.bands_for(limit)
        assert sum(w for _, w, _ in bands) == 64 and sum(r + 1 for *_, r in bands) == limit + 1
    assert sum(len(similarity._close(w, r)) / 2**w for _, w, r in similarity.bands_for(14)) < 0.1


def test_splits_of_one_class_do_not_depend_on_the_partitioning(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, "a").alias("label"))  # a null label, too
    for n in (1, 7):
        dealt = rows.repartition(n)
        assert {(r.label, r.side): r.n for r in splits.split_rows(dealt, ["label"], "id").groupBy("label", "side").agg(F.count("*").alias("n")).collect()} == {("a", "train"): 2666, ("a", "val"): 667, (None, "train"): 1333, (None, "val"): 334}
        assert [r["count"] for r in splits.halves(dealt, ["label"], "id").groupBy("label", "half").count().orderBy("label", "half").collect()] == [834, 833, 1667, 1666]
        best = splits.running_best(dealt.select("id", ((F.col("id") * 37) % 1009).alias("v")), "id", "v", 3).orderBy("id").limit(60).collect()
        top, at = -1, None
        for r in best:
            if r.v > top:
                top, at = r.v, r.id
            assert (r.best, r.best_at, r.since, r.stop) == (top, at, r.id - at, r.id - at >= 3)


def test_curation_of_empty_tables(spark):
    empty = spark.createDataFrame([], "path string, label string, split string, name string")
    assert curation.union_sources({"x": empty, "y": empty}).count() == 0
    assert curation.canonical_spelling(empty, "name", F.lit(True), "path").count() == 0
    assert [r.n for r in curation.three_bands(spark.createDataFrame([], "v double"), "v", 1, 2).collect()] == [0, 0, 0]


def test_plans_are_published_whole_or_not_at_all(spark, tmp_path):
    plan = spark.range(100).select("id", (F.col("id") % 3).alias("label"))
    rules = {"negative": F.count_if(F.col("id") < 0), "late": F.count_if(F.col("id") >= 98)}
    path = str(tmp_path / "plan")
    got = {r.check: tuple(r[1:]) for r in sinks.publish_plan(plan, path, rules, ["label"], apply=True).collect()}
    assert got == {"negative": (0, True, False), "late": (2, False, False)} and not list(tmp_path.iterdir())
    assert not [r.written for r in sinks.publish_plan(plan.limit(0), path, rules).collect() if not r.ok or r.written]
    good = plan.filter("id < 98")
    assert all(r.ok and r.written for r in sinks.publish_plan(good, path, rules, ["label"], apply=True).collect())
    assert spark.read.parquet(path).count() == 98 and [p.name for p in tmp_path.iterdir()] == ["plan"]
    with pytest.raises(ValueError, match="exists"):
        sinks.publish_plan(good, path, rules, apply=True)
    assert [r.violations for r in sinks.publish_plan(plan, f"{path}2", rules, apply=True, force=True).collect()] == [0, 2] and spark.read.parquet(f"{path}2").count() == 100
    with pytest.raises(Exception, match="no such thing"):  # a task that fails leaves nothing either
        sinks.publish_plan(good.withColumn("x", F.raise_error(F.lit("no such thing")).cast("int")), f"{path}3", rules, apply=True)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["plan", "plan2"]


def test_results_are_computed_once_for_a_state_of_their_input(spark, tmp_path):
    source, path, times = str(tmp_path / "in"), str(tmp_path / "out"), []
    spark.range(10).write.parquet(source)

    def compute():
        times.append(1)
        return spark.read.parquet(source).agg(F.sum("id").alias("s"))

    def empty():
        times.append(1)
        return spark.range(0)

    assert [sinks.cached(spark, [source], path, compute)[1] for _ in range(3)] == [False, True, True] and len(times) == 1
    assert [sinks.cached(spark, [source], path, compute, "v2")[1] for _ in range(2)] == [False, True]
    spark.range(5).write.parquet(source, mode="append")
    result, reused = sinks.cached(spark, [source], path, compute)
    assert (result.first().s, reused, len(times)) == (55, False, 3)
    assert [sinks.cached(spark, [source], str(tmp_path / "none"), empty)[1] for _ in range(2)] == [False, False]


def test_folders_of_a_written_tree(spark, tmp_path):
    root = tree(tmp_path)
    for path in ("odd/train/Train/c/1.png", "odd/val/c/2.png", "odd/twice/TWICE/3.JPG"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"x")
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    folders = src.tree_folders(listing, f"file:{root}")
    got = {r.folder: r for r in folders.collect()}
    for folder in [tmp_path, *[p for p in tmp_path.rglob("*") if p.is_dir()]]:
        r, inside = got.pop("" if folder == tmp_path else str(folder.relative_to(tmp_path))), list(folder.iterdir())
        image = lambda p: p.is_file() and p.suffix.lower()[1:] in src.FIVE
        assert (r.images, r.all_images) == (sum(map(image, inside)), sum(map(image, folder.rglob("*"))))
        assert (r.folders, r.files) == (sum(p.is_dir() for p in inside), sum(p.is_file() for p in inside))
        assert (r.name, r.depth) == (folder.name, len(folder.relative_to(tmp_path).parts))
        assert r.split_root == ({p.name.lower() for p in inside if p.is_dir()} >= {"train"} and bool({p.name.lower() for p in inside if p.is_dir()} & {"val", "valid"}))
    assert not got
    assert sorted(map(tuple, src.nesting_anomalies(folders).collect())) == [
        ("deep/x/y/z", "depth>3"), ("deep/x/y/z/train", "depth>3"), ("deep/x/y/z/train/a", "depth>3"), ("odd/train", "nested split folder"), ("odd/train", "repeated folder name"), ("odd/train/Train/c", "depth>3"), ("odd/twice", "repeated folder name"),
    ]
    assert src.tree_folders(listing, f"file:{root}", deepest=3).filter("depth > 3").isEmpty()
    assert src.tree_folders(listing.limit(0), root).count() == 0


def test_each_scan_once_after_a_killed_batch(spark, tmp_path):
    spark.range(40).repartitionByRange(4, "id").write.parquet(str(tmp_path / "in"))
    for kill in (True, False):
        def stop(number, kill=kill):
            if kill and number == 2:
                raise RuntimeError("killed")

        query = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).writeStream
        query = query.foreachBatch(live.save_once(str(tmp_path / "out"), after=stop)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        if kill:
            with pytest.raises(Exception, match="killed"):
                query.awaitTermination()
        else:
            query.awaitTermination()
    held = spark.read.parquet(str(tmp_path / "out"))
    assert held.count() == held.select("id").distinct().count() == 40 and held.select("batch").distinct().count() == 4
