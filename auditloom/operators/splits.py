"""Seeded, group-aware splits and samples.

Random order is the order of md5(seed:key): the same in every engine and for every
partitioning. compat_split() gives the order of Python's own generator instead.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.operators.scratch import stored


def draw(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def cutoff(n: Column, share: float) -> Column:
    """floor(n * share) in doubles, at least 1 and at most n - 1; n itself if it is 0 or 1."""
    return F.when(n > 1, F.greatest(F.lit(1), F.least(F.floor(n * F.lit(float(share))), n - 1))).otherwise(n).cast("long")


def _first_drawn(rows: DataFrame, by: list[str], key: str, seed: int, wanted: Column) -> DataFrame:
    """rows with `_in`: whether a row is among the first `wanted` of its class in drawn order;
    `wanted` is an expression of `_n`, the size of the class.

    No class is sorted. Rows are counted by class and the first four digits of their draw, a
    running sum over these counts (65,536 a class at most) finds the digits where the last
    wanted row lies, and only the rows with just these digits are ranked.
    """
    drawn = rows.withColumn("_d", draw(F.col(key), seed)).withColumn("_b", F.substring("_d", 1, 4))
    counts = drawn.groupBy(*by, "_b").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by)
    summed = counts.withColumn("_n", F.sum("_c").over(w)).withColumn("_upto", F.sum("_c").over(w.orderBy("_b"))).withColumn("_want", wanted.cast("long"))
    last = summed.filter((F.col("_want") > F.col("_upto") - F.col("_c")) & (F.col("_want") <= F.col("_upto")))
    last = last.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_b").alias("_last"), (F.col("_want") - F.col("_upto") + F.col("_c")).alias("_left"))
    same = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)])
    placed = drawn.join(last, same, "left").drop(*[f"_k{i}" for i in range(len(by))])
    clear = placed.filter("_last is null or _b <> _last").withColumn("_in", F.coalesce(F.col("_b") < F.col("_last"), F.lit(False)))
    edge = placed.filter("_b = _last").withColumn("_in", F.row_number().over(w.orderBy("_d", key)) <= F.col("_left"))
    return clear.unionByName(edge).drop("_d", "_b", "_last", "_left")


def _places(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with `_r`, the place of a row in its class in the given order, from 0, and `_n`, the
    size of the class.

    Rows are dealt into ranges of (class, order), so that a class of any size is spread over
    tasks, numbered within each and written to the shared folder; what comes before a class's
    rows in earlier ranges is a running sum over a row for each class and range.
    """
    by_order = [*by, *order]
    numbered = rows.repartitionByRange(*by_order).sortWithinPartitions(*by_order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    numbered = stored(numbered, rows.sparkSession)
    w = Window.partitionBy(*by)
    starts = numbered.groupBy(*by, "_p").agg(F.count("*").alias("_c"), F.min("_i").alias("_first"))
    starts = starts.withColumn("_n", F.sum("_c").over(w)).withColumn("_before", F.sum("_c").over(w.orderBy("_p")) - F.col("_c"))
    starts = starts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_p").alias("_q"), "_first", "_n", "_before")
    same = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)], F.col("_p") == F.col("_q"))
    placed = numbered.join(starts, same).withColumn("_r", F.col("_before") + F.col("_i") - F.col("_first"))
    return placed.drop(*[f"_k{i}" for i in range(len(by))], "_p", "_i", "_q", "_first", "_before")


def split_rows(rows: DataFrame, by: list[str], key: str, train_share: float = 0.8, seed: int = 42) -> DataFrame:
    """Row-wise split within each class: the first floor(n * share) in drawn order are train."""
    return _first_drawn(rows, by, key, seed, cutoff(F.col("_n"), train_share)).withColumn("side", F.when(F.col("_in"), "train").otherwise("val")).drop("_in")


def family_sizes(rows: DataFrame, label: str, family: str) -> DataFrame:
    return rows.groupBy(label, family).agg(F.count("*").alias("size"))


def split_families(rows: DataFrame, label: str = "label", family: str = "family", val_share: float = 0.2, seed: int = 42, least_val: int = 0) -> DataFrame:
    """(label, family, size, promoted, side): families are split whole, in drawn order within a label.

    If the val side has fewer than least_val rows, train families move over from the last on,
    until there are enough or one is left: a family moves if val and what moved before it are still
    too few. No label's families are sorted: their sizes are summed by the first four digits of
    their draw, and only the families of the digits where the sum reaches least_val are put in order.
    """
    sided = _first_drawn(family_sizes(rows, label, family), [label], family, seed, cutoff(F.col("_n"), 1.0 - val_share)).drop("_n")
    drawn = sided.withColumn("_d", draw(F.col(family), seed)).withColumn("_b", F.substring("_d", 1, 4))
    w, train = Window.partitionBy("_l"), F.when(F.col("_in"), F.col("size"))
    by_digits = drawn.groupBy(F.col(label).alias("_l"), F.col("_b").alias("_q")).agg(F.coalesce(F.sum(train), F.lit(0)).alias("_c"), F.sum("size").alias("_all"))
    # what is in val, or would move before this: val's own rows, and the train rows of later digits
    val = F.sum(F.col("_all") - F.col("_c")).over(w)
    later = F.coalesce(F.sum("_c").over(w.orderBy(F.desc("_q")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = by_digits.select("_l", "_q", "_c", (val + later).alias("_held"))
    first = drawn.groupBy(F.col(label).alias("_f")).agg(F.min(F.struct("_d", family)).alias("_first"))
    placed = drawn.join(sums, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_q"))).join(first, F.col(label).eqNullSafe(F.col("_f")))
    whole = (F.col("_held") + F.col("_c") < least_val) | (F.col("_held") >= least_val)  # the digits move together, or stay
    own = Window.partitionBy(label, "_b").orderBy(F.desc("_d"), F.desc(family)).rowsBetween(Window.unboundedPreceding, -1)
    clear = placed.filter(whole).withColumn("_moves", F.col("_held") < least_val)
    edge = placed.filter(~whole).withColumn("_moves", F.col("_held") + F.coalesce(F.sum(train).over(own), F.lit(0)) < least_val)
    moved = F.col("_in") & F.col("_moves") & (F.struct("_d", family) != F.col("_first"))
    return clear.unionByName(edge).select(label, family, F.col("size"), moved.alias("promoted"), F.when(F.col("_in") & ~moved, "train").otherwise("val").alias("side"))


def apply_families(rows: DataFrame, sides: DataFrame, label: str = "label", family: str = "family") -> DataFrame:
    return rows.join(sides.select(label, family, "side"), [label, family])


def compat_split(rows: DataFrame, label: str = "label", family: str = "family", val_share: float = 0.2, seed: int = 42) -> DataFrame:
    """(label, family, side) in the order that Python's random.Random(seed).shuffle gives the
    sorted families of each label. One label's families, not its rows, meet in a task."""
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        import random

        keys = sorted(pdf[family])
        random.Random(seed).shuffle(keys)
        n = len(keys)
        cut = max(1, min(int(n * (1.0 - val_share)), n - 1)) if n > 1 else n
        return pd.DataFrame({label: pdf[label].iloc[0], family: keys, "side": ["train"] * cut + ["val"] * (n - cut)})

    names = rows.select(F.col(label).cast("string").alias(label), F.col(family).cast("string").alias(family)).distinct()
    return names.groupBy(label).applyInPandas(one, f"`{label}` string, `{family}` string, side string")


def sample_rows(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows in drawn order; all of a smaller table. A top-n: each task sends n rows at most."""
    return rows.orderBy(draw(F.col(key), seed), key).limit(n)


def sample_even(rows: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """Up to k evenly spaced rows of each class: every max(n // k, 1)-th in order."""
    step = F.greatest(F.floor(F.col("_n") / k), F.lit(1))
    return _places(rows, by, order).filter((F.col("_r") % step == 0) & (F.floor(F.col("_r") / step) < k)).drop("_r", "_n")


def slots_of(rows: DataFrame, by: list[str], order: list[str], value: str, n: int = 8) -> DataFrame:
    """(by, slots, mean): how many rows every n-th of a class makes, from the first on, and the mean of its first n."""
    placed = _places(rows.select(*by, *order, value), by, order)
    return placed.groupBy(*by).agg(F.count_if(F.col("_r") % n == 0).cast("int").alias("slots"), F.avg(F.when(F.col("_r") < n, F.col(value))).alias("mean"))


def first_n(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def sample_quota(rows: DataFrame, label: str, key: str, target: int, seed: int = 42) -> DataFrame:
    """About target rows, the same number of each label: target // n, one more for the first
    target % n labels by name; a label's shortfall is not made up for."""
    labels = rows.select(label).distinct()
    placed = labels.withColumn("_at", F.row_number().over(Window.orderBy(label)) - 1)  # a row for each label
    n = F.count("*").over(Window.partitionBy())
    quota = placed.withColumn("_k", n).select(F.col(label).alias("_l"), (F.floor(F.lit(target) / F.col("_k")) + F.when(F.col("_at") < F.lit(target) % F.col("_k"), 1).otherwise(0)).alias("_quota"))
    with_quota = rows.join(quota, F.col(label).eqNullSafe(F.col("_l"))).drop("_l")
    return _first_drawn(with_quota, [label, "_quota"], key, seed, F.least(F.col("_quota"), F.col("_n"))).filter("_in").drop("_in", "_quota")


def halves(rows: DataFrame, by: list[str], key: str, seed: int = 42) -> DataFrame:
    """half: 1 or 2 in drawn order within each class, the first half larger if the count is odd."""
    return _first_drawn(rows, by, key, seed, F.ceil(F.col("_n") / 2)).withColumn("half", F.when(F.col("_in"), 1).otherwise(2)).drop("_in")


def family_halves(rows: DataFrame, label: str = "label", family: str = "family", seed: int = 42) -> DataFrame:
    """(label, family, size, half): families dealt whole, in drawn order within a label: the first
    half of them, the smaller if their number is odd, is `test`, the others are `selection`."""
    drawn = _first_drawn(family_sizes(rows, label, family), [label], family, seed, F.floor(F.col("_n") / 2))
    return drawn.select(label, family, "size", F.when(F.col("_in"), "test").otherwise("selection").alias("half"))


def dense_index(rows: DataFrame, label: str) -> DataFrame:
    """(label, idx): position of each label among the sorted distinct ones, from 0."""
    return rows.select(label).distinct().withColumn("idx", (F.dense_rank().over(Window.orderBy(label)) - 1).cast("int"))


def rename_collisions(rows: DataFrame, within: list[str], name: str, order: list[str], mark: str = "__dup") -> DataFrame:
    """destination: the name, or stem + mark + number + suffix for the second and later of a
    name within a folder."""
    placed = _places(rows, [*within, name], order)
    stem, suffix = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return placed.withColumn("destination", F.when(F.col("_r") == 0, F.col(name)).otherwise(F.concat(stem, F.lit(mark), F.col("_r").cast("string"), suffix))).drop("_r", "_n")


def running_best(rows: DataFrame, order: str, value: str, patience: int) -> DataFrame:
    """For each step: the best value so far, steps since it, and whether patience has run out.

    Steps are dealt into ranges; windows run within a range, and what the ranges before have as
    their best, and as the last step that was a best, is carried over from a row for each.
    """
    spark = rows.sparkSession
    dealt = stored(rows.select(order, value).repartitionByRange(order).withColumn("_p", F.spark_partition_id()), spark)
    whole, within = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_p").orderBy(order)

    def carried(part: DataFrame, top: Column, name: str) -> DataFrame:
        """part with the largest `top` of the ranges before its own; a row for each range is summed."""
        each = part.groupBy("_p").agg(F.max(top).alias("_top"))
        return part.join(each.select(F.col("_p"), F.max("_top").over(whole).alias(name)), "_p")

    best = carried(dealt, F.col(value), "_carried").withColumn("_before", F.greatest("_carried", F.max(value).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(float("-inf"))))
    fresh = best.withColumn("_at", F.when(F.col(value) > F.col("_before"), F.col(order)))
    marked = carried(fresh, F.col("_at"), "_last").withColumn("best", F.greatest("_carried", F.max(value).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    marked = marked.withColumn("best_at", F.greatest("_last", F.max("_at").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    return marked.select(order, value, "best", "best_at", (F.col(order) - F.col("best_at")).alias("since"), (F.col(order) - F.col("best_at") >= patience).alias("stop"))
