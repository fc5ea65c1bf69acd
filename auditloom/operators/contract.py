"""Checks of a dataset against its class list: each is a query, its result one row."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(name: str, violations: DataFrame, column: str) -> DataFrame:
    """(name, ok, detail): ok if there are no violations; detail counts them and names the first."""
    return violations.agg(F.count("*").alias("n"), F.min(F.col(column).cast("string")).alias("first")).select(
        F.lit(name).alias("name"), (F.col("n") == 0).alias("ok"), F.when(F.col("n") == 0, "none").otherwise(F.concat_ws(" ", F.col("n").cast("string"), F.lit("first:"), F.coalesce("first", F.lit("null")))).alias("detail")
    )


def holds(name: str, facts: DataFrame, ok: Column, detail: Column) -> DataFrame:
    """(name, ok, detail) of a one-row table of facts."""
    return facts.select(F.lit(name).alias("name"), F.coalesce(ok, F.lit(False)).alias("ok"), detail.cast("string").alias("detail"))


def class_list_checks(classes: DataFrame, expected: int) -> list[DataFrame]:
    """Of a class list (idx, name): no blanks, no padding, no duplicates, the count, the order."""
    pairs = classes.select("idx", "name").join(classes.select((F.col("idx") + 1).alias("idx"), F.col("name").alias("before")), "idx")
    return [
        check("no blank names", classes.filter(F.coalesce(F.trim("name"), F.lit("")) == ""), "idx"),
        check("no padded names", classes.filter(F.col("name") != F.trim("name")), "name"),
        check("unique names", classes.groupBy("name").count().filter("count > 1"), "name"),
        holds("class count", classes.agg(F.count("*").alias("n")), F.col("n") == expected, F.col("n")),
        check("sorted names", pairs.filter("before >= name"), "name"),
    ]


def folder_checks(classes: DataFrame, files: DataFrame, label: str, split: str, splits: list[str]) -> list[DataFrame]:
    """For each split: folders the same as the class list, no class missing."""
    out = []
    names = classes.select(F.col("name").alias(label))
    for s in splits:
        held = files.filter(F.col(split) == s).select(label).distinct()
        out += [check(f"{s}: no missing class", names.join(held, label, "left_anti"), label), check(f"{s}: no unexpected class", held.join(names, label, "left_anti"), label)]
    return out


def crop_check(classes: DataFrame, crop: Column, expected: int) -> DataFrame:
    """The classes (name) cover `expected` crops; detail counts and names them in order. A class list
    has a bounded length."""
    found = classes.select(crop.alias("c")).distinct().agg(F.array_sort(F.collect_set("c")).alias("crops"))
    return holds("crop coverage", found, F.size("crops") == expected, F.concat(F.size("crops").cast("string"), F.lit(": "), F.array_join("crops", ", ")))


def advice_checks(classes: DataFrame, advice: DataFrame, key: str, fields: list[str]) -> list[DataFrame]:
    """Every class (name) has an entry of advice (key, fields), in which none of the fields is blank; entries of no
    class are told, but allowed."""
    names = classes.select(F.col("name").alias(key))
    known = advice.join(names, key, "left_semi")
    extra = advice.join(names, key, "left_anti").agg(F.count("*").alias("n"))
    blank = [check(f"{f} not blank", known.filter(F.coalesce(F.trim(f), F.lit("")) == ""), key) for f in fields]
    return [check("every class has advice", names.join(advice, key, "left_anti"), key), holds("entries beyond the classes", extra, F.lit(True), F.col("n")), *blank]


def same_fingerprint(name: str, a: DataFrame, b: DataFrame, value: str, order: str) -> DataFrame:
    """Two lists are the same, element by element."""
    both = a.select(order, F.col(value).alias("_a")).join(b.select(order, F.col(value).alias("_b")), order, "full")
    return check(name, both.filter(~F.col("_a").eqNullSafe(F.col("_b"))), order)


def report(checks: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, checks)


def as_json(checks: DataFrame) -> DataFrame:
    """One row: json of all checks by name, and whether all hold. There are as many checks as
    the contract has, a fixed number."""
    every = F.array_sort(F.collect_list(F.struct("name", "ok", "detail")))
    return checks.agg(F.bool_and("ok").alias("ok"), every.alias("checks")).select(F.to_json(F.struct("ok", "checks")).alias("json"))
