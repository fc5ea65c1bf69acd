"""Building and comparing datasets: sources put together, classes renamed, rows routed and ranked."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.labels import normalised
from auditloom.operators.metrics import hits, ratio


def union_sources(sources: dict[str, DataFrame], split_names: dict[str, str] | None = None) -> DataFrame:
    """(source, path, label, split) of several labelled tables (path, label, split), with each
    source's split names brought to those of the result; unknown ones stay as they are."""
    parts = [df.select(F.lit(name).alias("source"), "path", "label", "split") for name, df in sources.items()]
    every = functools.reduce(DataFrame.unionByName, parts)
    name = F.col("split")
    for old, new in sorted((split_names or {}).items()):
        name = F.when(F.col("split") == old, new).otherwise(name)
    return every.withColumn("split", name)


def canonical_spelling(rows: DataFrame, name: str, is_train: Column, order: str) -> DataFrame:
    """(key, canonical, spellings): of the names with one normalised key the last of train, and
    where train has none, the first of all, in the given order."""
    last, first = F.max_by(F.when(is_train, F.col(name)), F.when(is_train, F.col(order))), F.min_by(name, order)
    return rows.groupBy(normalised(F.col(name)).alias("key")).agg(F.coalesce(last, first).alias("canonical"), F.count_distinct(name).alias("spellings"))


def rename_classes(rows: DataFrame, mapping: DataFrame, key: str, slug: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the slug that the mapping (key, slug) has for their key, keys of the mapping
    that no row has). Of a key that is mapped more than once the first slug by name counts."""
    one = mapping.groupBy(key).agg(F.min(slug).alias(slug))
    return rows.join(one, key), one.join(rows.select(key).distinct(), key, "left_anti")


def pair_summary(pairs: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """One row on near pairs (id_a, id_b, distance) with the predictions (key, truth, pred) of
    both sides: how many pairs and rows, how they agree, how many are right, how close."""
    a, b = (predictions.select(F.col(key).alias(f"id_{s}"), F.col("truth").alias(f"truth_{s}"), F.col("pred").alias(f"pred_{s}")) for s in "ab")
    both = pairs.join(a, "id_a").join(b, "id_b")
    same, right_a, right_b = F.col("truth_a") == F.col("truth_b"), F.col("truth_a") == F.col("pred_a"), F.col("truth_b") == F.col("pred_b")
    return both.agg(
        F.count("*").alias("pairs"), F.count_distinct("id_a").alias("rows_a"), F.count_distinct("id_b").alias("rows_b"),
        F.count_distinct("truth_a").alias("classes"), hits(same).alias("same_class"), hits(~same).alias("other_class"),
        hits(right_a).alias("right_a"), hits(right_b).alias("right_b"), hits(right_a & right_b).alias("right_both"), hits(F.col("pred_a") == F.col("pred_b")).alias("same_answer"),
        F.count_distinct(F.when(right_a, F.col("id_a"))).alias("right_rows_a"), F.min("distance").alias("closest"), hits(F.col("distance") == 0).alias("identical"),
    )


def accuracy_of_resolved(rows: DataFrame, true: str = "truth", pred: str = "pred") -> tuple[DataFrame, DataFrame]:
    """(label, n, correct, accuracy) over rows whose truth is known, and the rows where it isn't."""
    known = rows.filter(F.col(true).isNotNull()).groupBy(F.col(true).alias("label")).agg(F.count("*").alias("n"), hits(F.col(true) == F.col(pred)).alias("correct"))
    return known.withColumn("accuracy", ratio(F.col("correct"), F.col("n"))), rows.filter(F.col(true).isNull())


def configuration_ranking(rows: DataFrame, dataset: str, config: list[str], right: Column, conf: str, truth_conf: str) -> DataFrame:
    """Each dataset and configuration: n, correct, accuracy, mean confidence, mean confidence of
    the truth (of rows that have one), and its rank by accuracy within the dataset. The
    window runs over the configurations."""
    each = rows.groupBy(dataset, *config).agg(F.count("*").alias("n"), hits(right).alias("correct"), F.avg(conf).alias("mean_conf"), F.avg(truth_conf).alias("mean_truth_conf"))
    scored = each.withColumn("accuracy", ratio(F.col("correct"), F.col("n")))
    return scored.withColumn("rank", F.rank().over(Window.partitionBy(dataset).orderBy(F.desc("accuracy"))))


def configuration_grid(rows: DataFrame, dataset: str, config: list[str], grid: list[tuple], right, conf: str, truth_conf: str) -> DataFrame:
    """configuration_ranking() of rows that every configuration of a grid judges: right(*values) is the
    condition of one. The rows are counted once, by a condition each, and not multiplied."""
    each = rows.groupBy(dataset).agg(F.count("*").alias("n"), F.avg(conf).alias("mean_conf"), F.avg(truth_conf).alias("mean_truth_conf"), *[hits(right(*values)).alias(f"_c{i}") for i, values in enumerate(grid)])
    cells = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(config, values)], F.col(f"_c{i}").alias("correct")) for i, values in enumerate(grid)])
    scored = each.select(dataset, "n", "mean_conf", "mean_truth_conf", F.explode(cells).alias("_x")).select(dataset, *[f"_x.{c}" for c in config], "n", "_x.correct", "mean_conf", "mean_truth_conf")
    scored = scored.withColumn("accuracy", ratio(F.col("correct"), F.col("n")))
    return scored.withColumn("rank", F.rank().over(Window.partitionBy(dataset).orderBy(F.desc("accuracy"))))


def scope(rows: DataFrame, tier: str, tiers: list[str], upto: str) -> DataFrame:
    """Rows of the tiers up to the one named; each tier holds those before it."""
    return rows.filter(F.col(tier).isin(tiers[: tiers.index(upto) + 1]))


def route_folders(rows: DataFrame, label: str, healthy_ending: str, dropped: list[str], prefix: str = "") -> DataFrame:
    """rows with `route`: healthy by the label's ending, disease otherwise; classes of the list
    are left out, and with a prefix all names (column name) that don't start with it in any case."""
    kept = rows.filter(~F.col(label).isin(dropped)) if dropped else rows
    kept = kept.filter(F.lower("name").startswith(prefix)) if prefix else kept
    return kept.withColumn("route", F.when(F.lower(label).endswith(healthy_ending), "healthy").otherwise("disease"))


def missing_rows(listed: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Listed rows that aren't present."""
    return listed.join(present.select(key).distinct(), key, "left_anti")


def disposition(predictions: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """(action, reason, n, correct, accuracy) of predictions (key, truth, pred) by what a plan
    (key, action, reason) did to their files; action is `unmatched` where the plan lacks one."""
    joined = predictions.join(plan.select(key, "action", "reason"), key, "left").withColumn("action", F.coalesce("action", F.lit("unmatched")))
    out = joined.groupBy("action", "reason").agg(F.count("*").alias("n"), hits(F.col("truth") == F.col("pred")).alias("correct"))
    return out.withColumn("accuracy", ratio(F.col("correct"), F.col("n")))


def fingerprint(classes: DataFrame, value: str, order: str, digits: int = 12) -> DataFrame:
    """One row: names, and the first digits of the SHA-256 of the names in order, a line each. A
    class list has a bounded length."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value])
    return classes.agg(F.count("*").alias("names"), F.substring(F.sha2(F.array_join(listed, "\n"), 256), 1, digits).alias("fingerprint"))


def empty_classes(classes: DataFrame, files: DataFrame, label: str, split: str, splits: list[str]) -> DataFrame:
    """(label, split) of the class list (label) and the splits named for which there is no file."""
    wanted = classes.select(label).distinct().select(label, F.explode(F.array(*[F.lit(s) for s in splits])).alias(split))
    return wanted.join(files.select(label, split).distinct(), [label, split], "left_anti")


def three_bands(values: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """(band, n): values up to low, above it up to high, above that; empty bands too."""
    at = F.when(F.col(value) <= low, 0).when(F.col(value) <= high, 1).when(F.col(value) > high, 2)
    names = values.sparkSession.createDataFrame([(0, f"<= {low:g}"), (1, f"<= {high:g}"), (2, f"> {high:g}")], "_b int, band string")
    counts = values.groupBy(at.alias("_b")).agg(F.count("*").alias("n"))
    return names.join(counts, "_b", "left").select("band", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
