"""Duplicates, leaks and conflicts of labelled files, by digest and family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_of(a: Column, b: Column) -> Column:
    """Unordered pair of two labels as text."""
    return F.concat_ws("<->", F.array_sort(F.array(a, b)))


def duplicate_groups(files: DataFrame, digest: str = "digest", label: str = "label", split: str = "split") -> DataFrame:
    """Digests of more than one file: files, redundant, labels, splits, and what kind of group:
    crossing splits (whatever else) or within one. Sums by (digest, label, split) come first,
    so a digest of very many files is a few rows."""
    each = files.groupBy(F.col(digest).alias("digest"), F.col(label).alias("label"), F.col(split).alias("split")).agg(F.count("*").alias("n"))
    g = each.groupBy("digest").agg(F.sum("n").cast("long").alias("files"), F.count_distinct("label").alias("labels"), F.count_distinct("split").alias("splits")).filter("files > 1")
    return g.select("digest", "files", (F.col("files") - 1).alias("redundant"), "labels", "splits", F.when(F.col("splits") > 1, "cross_split").otherwise("within_split").alias("kind"))


def redundant_counts(groups: DataFrame) -> DataFrame:
    return groups.groupBy("kind").agg(F.count("*").alias("groups"), F.sum("files").cast("long").alias("files"), F.sum("redundant").cast("long").alias("redundant"))


def conflict_groups(files: DataFrame, digest: str = "digest", label: str = "label") -> DataFrame:
    """Digests that carry more than one label: digest, files, labels (sorted)."""
    each = files.groupBy(F.col(digest).alias("digest"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return each.groupBy("digest").agg(F.sum("n").cast("long").alias("files"), F.array_sort(F.collect_set("label")).alias("labels")).filter(F.size("labels") > 1)


def conflict_pairs(conflicts: DataFrame) -> DataFrame:
    """In how many groups each unordered pair of labels meets. Labels of a group are distinct,
    so a group gives as many pairs as its labels allow, not its files."""
    a = conflicts.select("digest", "labels", F.posexplode("labels").alias("i", "label_a"))
    pairs = a.select("label_a", F.explode(F.slice("labels", F.col("i") + 2, F.size("labels"))).alias("label_b"))
    return pairs.groupBy("label_a", "label_b").agg(F.count("*").alias("groups"))


def split_pairs(files: DataFrame, digest: str = "digest", split: str = "split") -> DataFrame:
    """In how many digests each unordered pair of splits meets."""
    held = files.select(F.col(digest).alias("digest"), F.col(split).alias("split")).distinct()
    return conflict_pairs(held.groupBy("digest").agg(F.array_sort(F.collect_set("split")).alias("labels")).filter(F.size("labels") > 1)).select(F.concat_ws("<->", "label_a", "label_b").alias("pair"), "groups")


def name_conflicts(files: DataFrame, name: str = "name", digest: str = "digest", split: str = "split") -> DataFrame:
    """Names found in more than one split with more than one content."""
    each = files.groupBy(F.col(name).alias("name")).agg(F.count_distinct(split).alias("splits"), F.count_distinct(digest).alias("digests"))
    return each.filter("splits > 1 and digests > 1")


def exact_leaks(rows: DataFrame, train: DataFrame, digest: str = "digest") -> DataFrame:
    """Rows whose digest is in train: a semi join on the distinct digests of train."""
    return rows.join(train.select(digest).distinct(), digest, "left_semi")


def leak_overlap(files: DataFrame, digest: str = "digest", split: str = "split", a: str = "train", b: str = "val") -> DataFrame:
    """Digests on both sides with the number of files on each."""
    g = files.groupBy(F.col(digest).alias("digest")).agg(F.count_if(F.col(split) == a).cast("long").alias(f"n_{a}"), F.count_if(F.col(split) == b).cast("long").alias(f"n_{b}"))
    return g.filter(f"n_{a} > 0 and n_{b} > 0")


def shared_files(files: DataFrame, digest: str = "digest", split: str = "split", a: str = "train", b: str = "val") -> DataFrame:
    """The files of the digests that are on both sides, a row each: what leak_overlap() counts. A list for each digest
    would hold all its copies in one place; rows don't."""
    return files.filter(F.col(split).isin(a, b)).join(leak_overlap(files, digest, split, a, b).select(F.col("digest").alias(digest)), digest, "left_semi")


def family_leaks(rows: DataFrame, train: DataFrame, label: str = "label", family: str = "family") -> DataFrame:
    """Rows whose (label, family) is in train."""
    return rows.join(train.select(label, family).distinct(), [label, family], "left_semi")


def clashes_without_leak(rows: DataFrame, train: DataFrame, label: str = "label", family: str = "family") -> DataFrame:
    """Rows whose family is in train, but under other labels only."""
    named = rows.join(train.select(family).distinct(), family, "left_semi")
    return named.join(train.select(label, family).distinct(), [label, family], "left_anti")


def class_sets(a: DataFrame, b: DataFrame, label: str = "label") -> DataFrame:
    """Every label of either side and where it is: both, missing (in a only), unexpected."""
    sides = a.select(label, F.lit(1).alias("s")).distinct().union(b.select(label, F.lit(2)).distinct())
    return sides.groupBy(label).agg(F.sum("s").alias("s")).select(label, F.when(F.col("s") == 3, "both").when(F.col("s") == 1, "missing").otherwise("unexpected").alias("status"))


def quarantine_plan(files: DataFrame, mislabelled: Column | None = None, path: str = "path", digest: str = "digest", label: str = "label", split: str = "split", first: str = "train") -> DataFrame:
    """Each file with its reason to leave, or null: cross_class_duplicate (its digest has more
    labels), else same_class_duplicate (not the first of its label and digest, the `first`
    split before others, then by lower-cased path, then path), else mislabelled.

    The label count of a digest and the first of its files come from one grouping with map-side
    sums, and only digests that repeat are joined; no group is ranked. Rows that repeat a path
    are the same file and are judged alike.
    """
    order = F.struct(F.when(F.col(split) == first, 0).otherwise(1).alias("s"), F.lower(F.col(path)).alias("l"), F.col(path).alias("p"))
    each = files.groupBy(F.col(digest).alias("_d"), F.col(label).alias("_l")).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    counts = each.groupBy("_d").agg(F.sum("n").alias("files"), F.count("*").alias("labels"), F.first("_first").alias("_first"))  # of one label where there is one
    marked = files.join(counts.filter("files > 1"), F.col(digest) == F.col("_d"), "left").drop("_d")
    wrong = F.coalesce(mislabelled, F.lit(False)) if mislabelled is not None else F.lit(False)
    reason = F.when(F.col("labels") > 1, "cross_class_duplicate").when(F.col("_first") != order, "same_class_duplicate").when(wrong, "mislabelled")
    return marked.withColumn("reason", reason).drop("files", "labels", "_first")


def keep_first(files: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given (ascending) order: a minimum with map-side sums, so
    a key of any number of rows is one row a task before the shuffle."""
    by = F.struct(*[c if isinstance(c, Column) else F.col(c) for c in order])
    first = files.groupBy(*keys).agg(F.min_by(F.struct(*files.columns), by).alias("_row"))
    return first.select("_row.*")


def verify_split(files: DataFrame, label: str = "label", split: str = "split", digest: str = "digest", family: str = "family") -> DataFrame:
    """By label: files on either side, digests and families on both, and whether all is well:
    nothing shared and no side empty while the other is not."""
    sides = [F.count_if(F.col(split) == s).cast("long") for s in ("train", "val")]
    size = files.groupBy(label).agg(sides[0].alias("train"), sides[1].alias("val"))
    out = size
    for key, name in ((digest, "shared_digests"), (family, "shared_families")):
        both = files.groupBy(label, key).agg(F.count_distinct(split).alias("s")).filter("s > 1").groupBy(label).agg(F.count("*").alias(name))
        out = out.join(both, label, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    ok = (F.col("shared_digests") == 0) & (F.col("shared_families") == 0) & (F.col("train") > 0) & (F.col("val") > 0)
    return out.withColumn("ok", ok)


def digests_with_memo(listing: DataFrame, memo: DataFrame, digest_of) -> DataFrame:
    """(path, length, modified, digest): digests of an earlier run are reused where size and
    whole-second time agree; only the other files are read and hashed."""
    key = ["path", "length", "modified"]
    known = listing.join(memo.select(*key, "digest"), key)
    fresh = digest_of(listing.join(memo.select(*key), key, "left_anti"))
    return known.select(*key, "digest").unionByName(fresh.select(*key, "digest"))


def split_direction_by_group(files: DataFrame, group: str, order: str, split: str = "split", file: str = "file") -> DataFrame:
    """What split_direction_plan() gives for all pairs (earlier in order, later) of files of one
    group, without the pairs: a file of train leaves if its group has one of val or test, a
    file of val if its group has one of test or a later one of val."""
    last = F.max(F.when(F.col(split) == "val", F.col(order))).alias("_last")
    others = [F.bool_or(F.col(split).isin(*s)).alias(n) for s, n in ((("val", "test"), "_others"), (("test",), "_tests"))]
    held = files.join(files.groupBy(F.col(group).alias("_g")).agg(last, *others), F.col(group) == F.col("_g"))
    goes = F.when(F.col(split) == "train", F.col("_others")).when(F.col(split) == "val", F.col("_tests") | (F.col(order) < F.col("_last")))
    return held.filter(goes).select(split, file).distinct()


def split_direction_plan(pairs: DataFrame) -> DataFrame:
    """From near-duplicate pairs (split_a, file_a, split_b, file_b), the files to quarantine: the
    train side; between val and test the val side; pairs within train are left alone."""
    a_train, b_train = F.col("split_a") == "train", F.col("split_b") == "train"
    side = F.when(a_train & b_train, None).when(a_train, "a").when(b_train, "b").when(F.col("split_a") == "val", "a").when(F.col("split_b") == "val", "b")
    chosen = pairs.withColumn("side", side).filter("side is not null")
    pick = lambda c: F.when(F.col("side") == "a", F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(c)
    return chosen.select(pick("split"), pick("file")).distinct()
