"""Results as files. Side effects on data need apply=True; a plan is a table until then."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_predictions(rows: DataFrame, path: str, booleans: tuple[str, ...] = ("correct", "in_top5"), reals: tuple[str, ...] = ("confidence",)) -> None:
    """CSV with header: confidences with six decimals, booleans as 1 and 0."""
    shown = {b: F.col(b).cast("int") for b in booleans} | {r: F.format_string("%.6f", r) for r in reals}
    rows.withColumns(shown).write.csv(path, header=True, mode="overwrite")


def write_table(rows: DataFrame, path: str, columns: list[str], order: list[str] | None = None) -> None:
    """CSV with header and a fixed order of columns; sorted by range where an order is given."""
    out = rows.select(*columns)
    (out.orderBy(*order) if order else out).write.csv(path, header=True, mode="overwrite")


def conflict_rows(conflicts: DataFrame) -> DataFrame:
    """A row for each pair of labels of a conflict group: kind, digest, label_a, label_b."""
    a = conflicts.select("digest", "labels", F.posexplode("labels").alias("i", "label_a"))
    return a.select(F.lit("cross_class").alias("kind"), "digest", "label_a", F.explode(F.slice("labels", F.col("i") + 2, F.size("labels"))).alias("label_b"))


def member_rows(files: DataFrame, groups: DataFrame, digest: str = "digest") -> DataFrame:
    """A row for each file of a duplicate group; Spark splits a digest of very many files."""
    return files.join(groups.select("digest", "kind"), files[digest] == groups["digest"]).drop(groups["digest"])


def class_names_json(labels: DataFrame, label: str) -> DataFrame:
    """One row, json: the sorted distinct names. A class list has a bounded length."""
    return labels.select(label).distinct().agg(F.to_json(F.array_sort(F.collect_set(label))).alias("json"))


def write_plan(plan: DataFrame, files: DataFrame, path: str, ok: bool, apply: bool = False, force: bool = False) -> DataFrame:
    """Write the files of a plan (path, action, label) to path/<action>/<label>. Returns the plan;
    nothing is written unless apply, nor if the plan's checks failed, unless force."""
    if apply and not (ok or force):
        raise ValueError("the plan's checks failed; force=True writes it all the same")
    if apply:
        plan.join(files, "path").write.partitionBy("action", "label").parquet(path, mode="errorifexists")
    return plan


def append_history(rows: DataFrame, path: str) -> None:
    """Append scans, each with an id of its own, rows that are alike too: a random UUID."""
    rows.withColumn("id", F.expr("uuid()")).write.parquet(path, mode="append")


def without_ids(history: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """The history without some ids, to be written anew: deletes are rewrites."""
    return history.join(gone.select(key), key, "left_anti")


# --------------------------------------------------------------------------- written whole or not at all


def _file_system(spark: SparkSession, path: str):
    """(file system of a path, path) as Hadoop sees them."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    system, found = _file_system(spark, path)
    return system.exists(found)


def publish_plan(plan: DataFrame, path: str, violations: dict[str, Column], partition_by: list[str] | None = None, apply: bool = False, force: bool = False) -> DataFrame:
    """Write a plan if its checks hold: (check, violations, ok, written), a row for each check.

    violations are aggregates of the plan, each the number of rows against one rule. They are
    observed while the plan is written, in the same pass, to a staging folder beside path, which
    becomes path by one rename if all are 0, or with force; else it is deleted, and nothing is
    left. A path that exists is an error. Without apply nothing is written, and the plan is
    only aggregated. Of an empty plan all counts are 0.
    """
    spark = plan.sparkSession
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(f"c{i}") for i, c in enumerate(violations.values())]
    if apply:
        if exists(spark, path):
            raise ValueError(f"{path} exists")
        staging, seen = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}", Observation()
        observed = plan.observe(seen, *counts)
        try:
            (observed.write.partitionBy(*partition_by) if partition_by else observed.write).parquet(staging)
            found = [seen.get[f"c{i}"] for i in range(len(counts))]
            written = force or not any(found)
            system, folder = _file_system(spark, staging)
            if written and not system.rename(folder, _file_system(spark, path)[1]):
                raise OSError(f"{staging} could not become {path}")
        finally:
            system, folder = _file_system(spark, staging)
            system.delete(folder, True)  # nothing, where it was renamed
    else:
        found, written = list(plan.agg(*counts).first()), False
    rows = [(name, int(n or 0), not n, written) for name, n in zip(violations, found)]
    return spark.createDataFrame(rows, "check string, violations long, ok boolean, written boolean")


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """What tells one state of some files and folders from another: names, sizes and times of
    all files, from their listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length", F.unix_millis("modificationTime").alias("time"))
    facts = files.agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), *[F.bit_xor(F.xxhash64(F.lit(i), "path", "length", "time")).alias(f"x{i}") for i in range(2)])
    return facts.select(F.sha2(F.concat_ws(",", *[F.col(c).cast("string") for c in facts.columns]), 256)).first()[0]


def cached(spark: SparkSession, inputs: list[str], path: str, compute: Callable[[], DataFrame], version: str = "") -> tuple[DataFrame, bool]:
    """(the result of compute, whether it was there already): results lie below path in folders named by the
    fingerprint of the inputs and the version of the computation.

    A result counts if it was written to its end and has a row; an empty one is computed anew.
    With a stored result no input file is opened. Results of earlier states stay.
    """
    folder = f"{path.rstrip('/')}/{fingerprint(spark, inputs)[:32]}{'-' + version if version else ''}"
    if exists(spark, f"{folder}/_SUCCESS"):
        held = spark.read.parquet(folder)
        if not held.isEmpty():
            return held, True
    compute().write.parquet(folder, mode="overwrite")
    return spark.read.parquet(folder), False
