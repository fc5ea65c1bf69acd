"""Trees of class folders and the text files beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.labels import read_boolean

FIVE = ("jpg", "jpeg", "png", "bmp", "webp")


def list_images(spark: SparkSession, root: str, endings: tuple[str, ...] = FIVE, scope: str = "", content: bool = False) -> DataFrame:
    """(path, name, label, split, length, modified[, content]) of root/<split>/<label>/<file>.

    Endings count in any case. scope keeps labels whose lower-cased name contains it. Without
    content only the files' metadata is read: the binary column is pruned."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = F.split("path", "/")
    held = files.select(
        "path", F.element_at(parts, -1).alias("name"), F.element_at(parts, -2).alias("label"), F.element_at(parts, -3).alias("split"),
        "length", F.col("modificationTime").alias("modified"), *["content"] * content,
    )
    return held.filter(F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)).isin(*endings) & F.contains(F.lower("label"), F.lit(scope)))


def missing_splits(files: DataFrame, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """Splits without a file; a table of as many rows as there are splits."""
    wanted = files.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    return wanted.join(files.select("split").distinct(), "split", "left_anti")


def with_digests(files: DataFrame, algorithm: str = "sha256") -> DataFrame:
    return files.withColumn("digest", F.sha2("content", 256) if algorithm == "sha256" else F.md5("content")).drop("content")


def count_images(files: DataFrame, classes: DataFrame) -> DataFrame:
    """Number of files of each class (name), 0 included, from metadata only."""
    counts = files.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n"))
    return classes.select("name").join(counts, "name", "left").select("name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def folder_profile(files: DataFrame, root: str, deepest: int = 8) -> DataFrame:
    """Folders that hold files, down to a depth below the root: parent, folders, files;
    is_split_root where the folders include train and val or valid."""
    parts, above = F.split("path", "/"), len(root.rstrip("/").split("/"))
    held = files.filter(F.size(parts) <= above + deepest + 1).select(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 3), "/").alias("parent"), F.element_at(parts, -3).alias("folder"))
    g = held.groupBy("parent").agg(F.count_distinct("folder").alias("folders"), F.count("*").alias("files"), F.collect_set("folder").alias("_names"))
    split = F.array_contains("_names", "train") & (F.array_contains("_names", "val") | F.array_contains("_names", "valid"))
    return g.select("parent", "folders", "files", split.alias("is_split_root"))


#: Names of folders that hold one side of a split each; fixed values.
SPLITS = ("train", "val", "valid", "test")


def tree_folders(files: DataFrame, root: str, endings: tuple[str, ...] = FIVE, deepest: int | None = None, path: str = "path") -> DataFrame:
    """Every folder of a tree, the root too, from the paths of its files: folder (relative, '' for the root), name, depth,
    parent, images (in it), all_images (below it), folders (in it), files, split_root.

    Paths are counted by folder first; then each folder's counts go to all its ancestors at
    once, so a level costs no pass of its own. deepest leaves out folders further down,
    whose images still count above. split_root: its folders include train and val or valid, in
    any case. Paths outside the root are left out. Folders without a file are not in a listing.
    """
    base = root.rstrip("/") + "/"
    inside = files.select(F.col(path).alias("p")).filter(F.startswith("p", F.lit(base))).select(F.substring("p", len(base) + 1, 1 << 30).alias("p"))
    image = F.lower(F.regexp_extract("p", r"\.([^./]*)$", 1)).isin(*endings)
    held = inside.groupBy(F.regexp_replace("p", "/?[^/]*$", "").alias("folder")).agg(F.count_if(image).alias("images"), F.count("*").alias("files"))
    parts = F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(F.split("folder", "/"))
    up = held.select("folder", "images", "files", parts.alias("parts")).select("folder", "images", "files", "parts", F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("depth"))
    up = up.select(F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("a"), "depth", F.when(F.size("parts") > F.col("depth"), F.get("parts", F.col("depth"))).alias("child"), "images", "files")
    own = F.col("child").isNull()
    by_child = up.groupBy("a", "depth", "child").agg(F.sum("images").alias("images"), F.sum("files").alias("files"))
    has = lambda *names: F.bool_or(F.coalesce(F.lower("child").isin(*names), F.lit(False)))
    out = by_child.groupBy(F.col("a").alias("folder"), "depth").agg(
        F.coalesce(F.sum(F.when(own, F.col("images"))), F.lit(0)).alias("images"), F.sum("images").alias("all_images"), F.count("child").alias("folders"), F.coalesce(F.sum(F.when(own, F.col("files"))), F.lit(0)).alias("files"), (has("train") & has("val", "valid")).alias("split_root"),
        F.max("child").alias("_only"),
    )
    name, parent = F.regexp_extract("folder", "([^/]*)$", 1), F.when(F.col("depth") > 0, F.regexp_replace("folder", "/?[^/]*$", ""))
    out = out.withColumns({"name": F.when(F.col("depth") > 0, name).otherwise(root.rstrip("/").rpartition("/")[2]), "parent": parent})
    out = out.withColumn("only_child", F.when(F.col("folders") == 1, F.col("_only"))).drop("_only")
    return out if deepest is None else out.filter(F.col("depth") <= deepest)


def nesting_anomalies(folders: DataFrame, deepest: int = 3) -> DataFrame:
    """(folder, anomaly) of tree_folders(): `depth>3` (or as deep as is allowed), `0 images` (none in it and no folder either), `nested
    split folder` and `repeated folder name` (its only folder has its name, in any case)."""
    same = F.lower("only_child") == F.lower("name")
    rules = [(F.col("depth") > deepest, f"depth>{deepest}"), ((F.col("images") == 0) & (F.col("folders") == 0), "0 images"), (same & F.lower("name").isin(*SPLITS), "nested split folder"), (same, "repeated folder name")]
    found = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules]))
    return folders.select("folder", F.explode(found).alias("anomaly"))


def decoded_images(spark: SparkSession, root: str) -> DataFrame:
    """(path, width, height, ok) by Spark's image source; files that don't decode are not ok."""
    images = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(root)
    return images.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), (F.col("image.width") > 0).alias("ok"))


def read_csv(spark: SparkSession, path: str, schema: str, booleans: tuple[str, ...] = (), separator: str = ",") -> DataFrame:
    """A CSV or TSV file with header and given schema. A byte order mark is dropped by Spark's
    reader; empty texts are null; boolean columns, declared as strings, are read in any of
    their spellings."""
    rows = spark.read.csv(path, schema=schema, header=True, sep=separator, enforceSchema=True, ignoreLeadingWhiteSpace=True)
    return rows.withColumns({b: read_boolean(F.col(b)) for b in booleans})


def read_json_list(spark: SparkSession, path: str) -> DataFrame:
    """(idx, name) of a JSON list of names, or of an object whose keys are numbers, in their order."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("value"))
    listed = whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("idx", "name"))
    keyed = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "name")).select(F.col("k").cast("int").alias("idx"), "name")
    is_list = F.substring(F.ltrim("value"), 1, 1) == "["
    return listed if whole.filter(is_list).count() else keyed


def read_keyed_records(spark: SparkSession, path: str, record: str, defaults: dict[str, str]) -> DataFrame:
    """(key, fields...) of a JSON object of records; missing fields take their defaults."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.explode(F.from_json("value", f"map<string,struct<{record}>>")).alias("key", "r")).select("key", "r.*")
    return rows.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in defaults.items()})


def read_numbered_list(spark: SparkSession, path: str) -> DataFrame:
    """(idx, name) of lines `12 name`; a line whose first word is no number is a name without one."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    number = F.regexp_extract("value", r"^\s*(\d+)\s+(.*)$", 1)
    return lines.select(number.try_cast("int").alias("idx"), F.trim(F.when(number != "", F.regexp_extract("value", r"^\s*(\d+)\s+(.*)$", 2)).otherwise(F.col("value"))).alias("name"))


def scrape_report(spark: SparkSession, path: str) -> DataFrame:
    """One row of facts of a text report: bytes, sha256 (of the line of its model file or of the
    two after it) and classes. A report is one small file, read whole."""
    whole = spark.read.text(path, wholetext=True)
    block = F.regexp_extract("value", r"(?m)(^.*flatbuffer.*(?:\n.*){0,2})", 1)
    return whole.select(
        F.regexp_replace(F.regexp_extract(block, r"([\d,]+) bytes", 1), ",", "").try_cast("long").alias("bytes"),
        F.nullif(F.regexp_extract(block, r"\b([0-9a-f]{12,64})\b", 1), F.lit("")).alias("sha256"),
        F.regexp_extract("value", r"(\d+) classes", 1).try_cast("int").alias("classes"),
    )


FORECAST = "list array<struct<dt:bigint,main:struct<temp:double,humidity:double>,weather:array<struct<main:string,description:string>>,dt_txt:string>>, city struct<name:string>"


def forecast_slots(documents: DataFrame, column: str = "value", most: int | None = None) -> DataFrame:
    """(city, slot, dt, temp, humidity, weather, dt_txt) of forecast documents in JSON."""
    doc = documents.select(F.from_json(column, FORECAST).alias("d")).select("d.city.name", "d.list")
    rows = doc.select(F.col("name").alias("city"), F.posexplode("list").alias("slot", "s"))
    rows = rows.select("city", "slot", "s.dt", "s.main.temp", "s.main.humidity", F.get("s.weather", F.lit(0))["main"].alias("weather"), "s.dt_txt")
    return rows if most is None else rows.filter(F.col("slot") < most)


def forecast_summary(slots: DataFrame) -> DataFrame:
    """city, mean humidity and temperature to one decimal (a missing value counts 0), rainy slots."""
    return slots.groupBy("city").agg(
        F.round(F.avg(F.coalesce("humidity", F.lit(0.0))), 1).alias("humidity"), F.round(F.avg(F.coalesce("temp", F.lit(0.0))), 1).alias("temp"), F.count_if(F.col("weather") == "Rain").cast("long").alias("rain_slots")
    )
