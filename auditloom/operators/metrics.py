"""Evaluation of classifiers: aggregates over prediction rows.

Prediction rows have a true and a predicted label and a confidence; ratios without a base are
null, never NaN. Each function is one or two aggregations with map-side sums; what is sent to
all executors (class lists, thresholds) has a fixed, small size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def hits(condition: Column) -> Column:
    """How many rows meet the condition; a null condition doesn't count."""
    return F.count_if(condition).cast("long")


def class_table(spark: SparkSession, names: list[str]) -> DataFrame:
    """(idx, name) of a class list: position is index."""
    return spark.createDataFrame(list(enumerate(names)), "idx int, name string")


def accuracy(rows: DataFrame, true: str = "truth", pred: str = "pred", top: str | None = None, by: list[str] | None = None) -> DataFrame:
    """n, correct, top1 and, with an array column of ranked names, top_hits and top_rate."""
    aggs = [F.count("*").alias("n"), hits(F.col(true) == F.col(pred)).alias("correct")]
    aggs += [hits(F.array_contains(top, F.col(true))).alias("top_hits")] if top else []
    out = rows.groupBy(*(by or [])).agg(*aggs).withColumn("top1", ratio(F.col("correct"), F.col("n")))
    return out.withColumn("top_rate", ratio(F.col("top_hits"), F.col("n"))) if top else out


def class_scores(rows: DataFrame, classes: DataFrame, true: str = "truth", pred: str = "pred", zero_division: float | None = None) -> DataFrame:
    """name, support, predicted, hit, precision, recall, f1 for every class of the contract.

    Labels and predictions are counted in one pass: each row goes in as its true and as its
    predicted class. zero_division stands in for ratios without a base (null by default).
    """
    right = F.col(true) == F.col(pred)
    sides = rows.select(F.explode(F.array(F.struct(F.col(true).alias("name"), F.lit(1).alias("t"), F.lit(0).alias("p"), F.lit(0).alias("h")), F.struct(F.col(pred).alias("name"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.when(right, 1).otherwise(0).alias("h")))).alias("s")).select("s.*")
    counts = sides.groupBy("name").agg(*[F.sum(c).alias(c) for c in "tph"])
    full = classes.select("name").join(counts, "name", "left").select("name", *[F.coalesce(c, F.lit(0)).cast("long").alias(n) for c, n in (("t", "support"), ("p", "predicted"), ("h", "hit"))])
    none = F.lit(zero_division).cast("double")
    scored = full.withColumn("precision", F.coalesce(ratio(F.col("hit"), F.col("predicted")), none)).withColumn("recall", F.coalesce(ratio(F.col("hit"), F.col("support")), none))
    return scored.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), none))


def averages(scores: DataFrame) -> DataFrame:
    """Macro and support-weighted means over the classes that occur; an undefined one counts 0."""
    held = scores.filter("support > 0")
    out = []
    for c in ("precision", "recall", "f1"):
        v = F.coalesce(c, F.lit(0.0))
        out += [F.avg(v).alias(f"macro_{c}"), F.try_divide(F.sum(v * F.col("support")), F.sum("support").cast("double")).alias(f"weighted_{c}")]
    return held.agg(*out)


def confusion(rows: DataFrame, true: str = "truth", pred: str = "pred") -> DataFrame:
    """Long form: true, pred, n of the pairs that occur."""
    return rows.groupBy(F.col(true).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def confusion_wide(rows: DataFrame, classes: list[str], true: str = "truth", pred: str = "pred") -> DataFrame:
    """Dense matrix: a row for each class, a column for each predicted class, zeros included."""
    spark = rows.sparkSession
    wide = rows.groupBy(F.col(true).alias("name")).pivot(pred, classes).agg(F.count(F.lit(1)))
    full = class_table(spark, classes).join(wide, "name", "left").select("name", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long").alias(c) for c in classes])
    return full.withColumnRenamed("name", "truth")


def mispairs(rows: DataFrame, top: int, true: str = "truth", pred: str = "pred", conf: str = "conf", margin: str | None = None) -> DataFrame:
    """The most frequent wrong pairs with their mean confidence (and margin)."""
    wrong = rows.filter(F.col(true) != F.col(pred))
    aggs = [F.count("*").alias("n"), F.round(F.avg(conf), 6).alias("mean_conf")] + ([F.round(F.avg(margin), 6).alias("mean_margin")] if margin else [])
    return wrong.groupBy(F.col(true).alias("truth"), F.col(pred).alias("pred")).agg(*aggs).orderBy(F.desc("n"), "truth", "pred").limit(top)


def group_rollup(rows: DataFrame, group_of, true: str = "truth", pred: str = "pred") -> DataFrame:
    """By group of classes: n, correct, errors within the group and across groups."""
    a, b = group_of(F.col(true)), group_of(F.col(pred))
    right = F.col(true) == F.col(pred)
    return rows.groupBy(a.alias("group")).agg(
        F.count("*").alias("n"), hits(right).alias("correct"),
        hits(~right & (a == b)).alias("within"), hits(~right & (a != b)).alias("across"),
    )


def healthy_summary(rows: DataFrame, is_healthy, true: str = "truth", pred: str = "pred") -> DataFrame:
    """Six counts that part healthy-or-not from naming."""
    t, p, right = is_healthy(F.col(true)), is_healthy(F.col(pred)), F.col(true) == F.col(pred)
    return rows.agg(
        hits(t).alias("healthy"), hits(t & p).alias("healthy_kept"), hits(t & ~p).alias("false_alarm"),
        hits(~t).alias("diseased"), hits(~t & p).alias("missed"), hits(~t & ~p & ~right).alias("misnamed"),
    )


def family_accuracy(rows: DataFrame, family: str = "family", true: str = "truth", pred: str = "pred") -> DataFrame:
    """Accuracy by (class, family) first, then over families: how many, all right, mean, size."""
    each = rows.groupBy(true, family).agg(F.count("*").alias("n"), F.avg((F.col(true) == F.col(pred)).cast("double")).alias("acc"))
    return each.agg(F.count("*").alias("families"), hits(F.col("acc") == 1.0).alias("all_right"), F.round(F.avg("acc"), 6).alias("mean_accuracy"), F.round(F.avg("n"), 6).alias("mean_size"))


def gate_sweep(rows: DataFrame, thresholds: list[float], by: list[str] | None = None, true: str = "truth", pred: str = "pred", conf: str = "conf") -> DataFrame:
    """For each threshold: shown (conf >= threshold), total, coverage, correct, wrong, precision
    and recall, correct over all rows. The rows are read once: each is counted at the highest
    threshold it passes, and sums over the thresholds above finish the sweep, so nothing is
    multiplied by the number of thresholds."""
    by = by or []
    cuts = sorted(set(thresholds))
    level = sum(((F.col(conf) >= F.lit(t)).cast("int") for t in cuts), F.lit(0))
    right = F.col(true) == F.col(pred)
    counted = rows.groupBy(*by, level.alias("level")).agg(F.count("*").alias("n"), hits(right).alias("c"))
    spread = counted.select(*by, "n", "c", F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), (F.col("level") > i).alias("passes")) for i, t in enumerate(cuts)])).alias("s"))
    out = spread.groupBy(*by, F.col("s.threshold").alias("threshold")).agg(
        F.sum(F.when(F.col("s.passes"), F.col("n")).otherwise(0)).cast("long").alias("shown"),
        F.sum("n").cast("long").alias("total"),
        F.sum(F.when(F.col("s.passes"), F.col("c")).otherwise(0)).cast("long").alias("correct"),
    )
    return out.select(
        *by, "threshold", "shown", "total", ratio(F.col("shown"), F.col("total")).alias("coverage"), "correct", (F.col("shown") - F.col("correct")).alias("wrong"),
        ratio(F.col("correct"), F.col("shown")).alias("precision"), ratio(F.col("correct"), F.col("total")).alias("recall"),
    )


def pick_gate(sweep: DataFrame, least_shown: int = 4, precision: float = 1.0) -> DataFrame:
    """The lowest threshold with the wanted precision and enough rows shown."""
    return sweep.filter((F.col("precision") >= precision) & (F.col("shown") >= least_shown)).orderBy("threshold").limit(1)


def prior_ratio(rows: DataFrame, classes: DataFrame, true: str = "truth", pred: str = "pred", least_ratio: float = 1.25, least: int = 3) -> DataFrame:
    """How often each class is predicted against how often it is true; null where never true
    but predicted counts as infinite for the flag."""
    s = class_scores(rows, classes, true, pred).select("name", "support", "predicted")
    total = F.sum("predicted").over(Window.partitionBy())  # over the contract's classes only
    over = ratio(F.col("predicted"), F.col("support"))
    return s.select("name", "support", "predicted", over.alias("ratio"), ratio(F.col("predicted"), total).alias("share"), ((F.coalesce(over, F.lit(float("inf"))) >= least_ratio) & (F.col("predicted") >= least)).alias("over_predicted"))


def worst_classes(rows: DataFrame, top: int, least_support: int = 20, true: str = "truth", pred: str = "pred") -> DataFrame:
    """Classes by ascending accuracy, each with its most frequent wrong answer (of equals the
    first by name)."""
    pairs = confusion(rows, true, pred)
    wrong = F.when(F.col("truth") != F.col("pred"), F.struct((-F.col("n")).alias("k"), F.col("pred").alias("pred"), F.col("n").alias("n")))
    each = pairs.groupBy("truth").agg(F.sum("n").cast("long").alias("support"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).cast("long").alias("correct"), F.min(wrong).alias("w"))
    return each.filter(F.col("support") >= least_support).select("truth", "support", "correct", ratio(F.col("correct"), F.col("support")).alias("accuracy"), F.col("w.pred").alias("wrong_answer"), F.col("w.n").alias("wrong_n")).orderBy("accuracy", "truth").limit(top)


def class_balance(rows: DataFrame, classes: DataFrame, label: str = "truth", weak: float = 0.5, low: int = 100) -> DataFrame:
    """Count of each contract class, its ratio to the median of the classes that have rows, and
    flags for weak (below half the median) and low (fewer than `low` rows) classes."""
    counts = rows.groupBy(F.col(label).alias("name")).agg(F.count("*").alias("n"))
    full = classes.select("name").join(counts, "name", "left").select("name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    mid = F.median(F.when(F.col("n") > 0, F.col("n"))).over(Window.partitionBy())  # as many rows as classes
    held = full.withColumn("median", mid)
    return held.select("name", "n", ratio(F.col("n"), F.col("median")).alias("ratio"), (F.col("n") < weak * F.col("median")).alias("weak"), (F.col("n") < low).alias("low"))


def exclusion_summary(rows: DataFrame, rules: dict[str, Column], true: str = "truth", pred: str = "pred") -> DataFrame:
    """What accuracy becomes when the rows that a rule flags are left out; one pass for all
    rules: rule, excluded, left, accuracy, delta (points), correct_excluded."""
    right = F.col(true) == F.col(pred)
    flagged = rows.select(right.alias("right"), F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("flag")) for n, c in rules.items()])).alias("s"))
    sums = flagged.groupBy(F.col("s.rule").alias("rule")).agg(
        F.count("*").alias("n"), hits(F.col("right")).alias("c"), hits(F.col("s.flag")).alias("excluded"), hits(F.col("s.flag") & F.col("right")).alias("correct_excluded")
    )
    left, kept = F.col("n") - F.col("excluded"), F.col("c") - F.col("correct_excluded")
    return sums.select("rule", "excluded", left.alias("left"), ratio(kept, left).alias("accuracy"), (100 * (ratio(kept, left) - ratio(F.col("c"), F.col("n")))).alias("delta"), "correct_excluded")


def compare_runs(a: DataFrame, b: DataFrame, key: str, pred: str = "pred", conf: str = "conf") -> DataFrame:
    """Two runs over the same items: key, both answers, whether they agree, confidence change."""
    right = b.select(key, F.col(pred).alias("pred_b"), F.col(conf).alias("conf_b"))
    joined = a.select(key, F.col(pred).alias("pred_a"), F.col(conf).alias("conf_a")).join(right, key)
    return joined.withColumn("agree", F.col("pred_a") == F.col("pred_b")).withColumn("delta", F.round(F.abs(F.col("conf_a") - F.col("conf_b")), 6))


def poisson_one(draw: Column) -> Column:
    """The Poisson(1) number of a uniform draw from 0 to 2 ** 32 - 1, by its inverse distribution."""
    return sum(((draw >= x).cast("int") for x in POISSON_STEPS[1:]), (draw >= POISSON_STEPS[0]).cast("int"))


#: Where the distribution of Poisson(1) steps, in parts of 2 ** 32; beyond the last one it is as good as 1.
POISSON_STEPS = [math.floor(2**32 * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(12)]


def bootstrap_interval(rows: DataFrame, true: str = "truth", pred: str = "pred", key: str = "id", replicates: int = 1000, blocks: int = 1000, seed: int = 42) -> DataFrame:
    """95 % interval of accuracy from Poisson resamples: n, accuracy, low, high.

    Rows are dealt into blocks by md5 of their key, and counted by block in one pass; of fewer
    rows than blocks each is mostly alone. In a replicate a block counts a Poisson(1) number of times.
    That number is drawn by a counter: md5 of seed, replicate and block gives 32 bits, and
    these the number, by the inverse distribution. So the interval is the same for any
    partitioning, any engine, and costs replicates * blocks draws however many rows there are.
    """

    def bits(text: Column) -> Column:
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")

    right = rows.select(F.coalesce(F.col(true) == F.col(pred), F.lit(False)).alias("right"), (bits(F.coalesce(F.col(key).cast("string"), F.lit(""))) % blocks).alias("block"))
    counted = right.groupBy("block").agg(F.count("*").alias("n"), hits(F.col("right")).alias("yes"))
    drawn = counted.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    times = drawn.withColumn("times", poisson_one(bits(F.concat_ws(":", F.lit(seed).cast("string"), F.col("replicate").cast("string"), F.col("block").cast("string")))))
    sums = times.groupBy("replicate").agg(F.sum(F.col("times") * F.col("n")).alias("w"), F.sum(F.col("times") * F.col("yes")).alias("r"))
    spread = sums.agg(F.percentile(ratio(F.col("r"), F.col("w")), F.lit(0.025)).alias("low"), F.percentile(ratio(F.col("r"), F.col("w")), F.lit(0.975)).alias("high"))
    whole = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), ratio(F.sum("yes"), F.sum("n")).alias("accuracy"))
    return whole.join(F.broadcast(spread))  # one row each


def histogram(rows: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """Counts in [edge, next edge), empty bins included; values outside count nowhere."""
    bins = list(zip(edges[:-1], edges[1:]))
    names = rows.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(bins)], "bin int, low double, high double")
    at = F.coalesce(*[F.when((value >= a) & (value < b), F.lit(i)) for i, (a, b) in enumerate(bins)])
    counts = rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return names.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
