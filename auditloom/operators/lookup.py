"""Lookups with fallbacks, coverage, and labels resolved to class names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from auditloom.functions.labels import normalised, split_class
from auditloom.operators.scratch import stored


def lookup_with_fallback(rows: DataFrame, key: str, tables: list[DataFrame], value: str, default) -> DataFrame:
    """The value of the first table (key, value) that has the key, the least of several, else the
    default column; source says which table it was, from 1, or 0."""
    out, found = rows, []
    for i, t in enumerate(tables):
        out = out.join(t.select(F.col(key).alias(f"_k{i}"), F.col(value).alias(f"_v{i}")).groupBy(f"_k{i}").agg(F.min(f"_v{i}").alias(f"_v{i}")), F.col(key) == F.col(f"_k{i}"), "left")
        found.append((F.col(f"_k{i}").isNotNull(), F.col(f"_v{i}")))
    chosen, source = default, F.lit(0)
    for i, (has, v) in reversed(list(enumerate(found))):
        chosen, source = F.when(has, v).otherwise(chosen), F.when(has, F.lit(i + 1)).otherwise(source)
    return out.withColumn(value, chosen).withColumn("source", source).drop(*[f"_k{i}" for i in range(len(tables))], *[f"_v{i}" for i in range(len(tables))])


def coverage_counts(rows: DataFrame, contract: DataFrame, name: str) -> DataFrame:
    """Every name of the contract with its number of rows, 0 included."""
    counts = rows.groupBy(name).agg(F.count("*").alias("n"))
    return contract.select(name).join(counts, name, "left").select(name, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def uncovered(rows: DataFrame, contract: DataFrame, name: str) -> DataFrame:
    """Names of rows that the contract lacks."""
    return rows.select(name).distinct().join(contract.select(name), name, "left_anti")


def label_of_index(rows: DataFrame, idx: str, classes: DataFrame, offset: int = 0) -> DataFrame:
    """name by position in the class list (idx, name), class_<i> beyond it."""
    dim = classes.select((F.col("idx") + offset).alias("_i"), F.col("name").alias("_n"))
    return rows.join(dim, F.col(idx) == F.col("_i"), "left").withColumn("name", F.coalesce("_n", F.concat(F.lit("class_"), F.col(idx).cast("string")))).drop("_i", "_n")


def resolve_labels(labels: DataFrame, classes: DataFrame, label: str = "label", aliases: dict[str, str] | None = None, least: float = 0.5) -> DataFrame:
    """(label, name, how) for each distinct label: by alias, where its target is a class; by
    equal normalised spelling, the first class of several; by likeness of the second part,
    among classes of the same first part, if at least `least` (the first of equals); or null.

    Spark broadcasts the class list (idx, name) where it is small. Likeness is the ratio of matching
    blocks, which no built-in function gives, so an Arrow UDF compares the (label, class) pairs of one
    first part that neither alias nor spelling settles, as far as likely_pairs() leaves any.
    """
    spark = labels.sparkSession
    distinct = labels.select(F.col(label).alias("label")).distinct()
    named = classes.select("idx", "name", normalised(F.col("name")).alias("norm"), normalised(split_class(F.col("name"))["crop"]).alias("crop"), normalised(split_class(F.col("name"))["rest"]).alias("rest"))
    alias = spark.createDataFrame(sorted((aliases or {}).items()) or [("", "")], "label string, target string")
    by_alias = alias.join(named, alias["target"] == named["name"], "left_semi").select("label", F.col("target").alias("a"))
    first = named.groupBy("norm").agg(F.min_by("name", "idx").alias("e"))
    staged = distinct.join(by_alias, "label", "left").withColumn("norm", normalised(F.col("label"))).join(first, "norm", "left")

    parts = F.split("label", "_", 2)
    open_ = staged.filter("a is null and e is null and instr(label, '_') > 0").select("label", normalised(parts[0]).alias("crop"), normalised(parts[1]).alias("mine"))
    first, rest = likely_pairs(open_, named, least)
    scored = first.unionByName(rest.select("label", "idx", "name", likeness("mine", "rest").alias("score"))).filter(F.col("score") >= least)
    best = scored.groupBy("label").agg(F.max_by("name", F.struct("score", -F.col("idx"))).alias("f"), F.max("score").alias("score"))
    out = staged.join(best, "label", "left")
    how = F.when(F.col("a").isNotNull(), "alias").when(F.col("e").isNotNull(), "exact").when(F.col("f").isNotNull(), F.format_string("fuzzy(%.2f)", "score")).otherwise("unmatched")
    return out.select("label", F.coalesce("a", "e", "f").alias("name"), how.alias("how"))


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of matching blocks of two texts."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def _counted(text: str) -> Column:
    """The characters of a text, each with how often it has come up so far: a set that stands for a multiset."""
    chars = F.split(text, "")
    return F.when(F.length(text) > 0, F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i), lambda x: x == c)).cast("string")))).otherwise(F.array().cast("array<string>"))


def likeness_bound(a: str, b: str, counted_a: str, counted_b: str) -> Column:
    """No less than the likeness of two texts of lengths n and m, by built-in functions. Matching blocks are a common
    subsequence: they have no more characters than both texts share, nor than (n + m - edits) / 2."""
    both = F.length(a) + F.length(b)
    shared = 2 * F.size(F.array_intersect(counted_a, counted_b)) / both
    return F.when(both == 0, F.lit(1.0)).otherwise(F.least(shared, 1 - F.levenshtein(a, b) / both))


def likely_pairs(labels: DataFrame, classes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """((label, idx, name, score), (label, idx, name, mine, rest)): of labels (label, crop, mine) and
    classes (idx, name, crop, rest) with one crop, for each label the class with the highest bound and
    its likeness; and the pairs that may still be as alike, the only others to be compared."""
    mine, rest = labels.withColumn("_a", _counted("mine")), classes.withColumn("_b", _counted("rest"))
    pairs = mine.join(rest, "crop").withColumn("bound", likeness_bound("mine", "rest", "_a", "_b")).select("label", "idx", "name", "mine", "rest", "bound")
    pairs = stored(pairs.filter(F.col("bound") >= least), labels.sparkSession)
    first = pairs.groupBy("label").agg(F.min_by(F.struct("idx", "name", "mine", "rest"), F.struct(-F.col("bound"), "idx")).alias("x"))
    first = stored(first.select("label", "x.idx", "x.name", likeness("x.mine", "x.rest").alias("score")), labels.sparkSession)
    known = first.select("label", F.col("idx").alias("_i"), F.col("score").alias("_s"))
    return first, pairs.join(known, "label").filter((F.col("idx") != F.col("_i")) & (F.col("bound") >= F.col("_s") - 1e-12)).select("label", "idx", "name", "mine", "rest")
