"""Queries on duplicates, leaks, conflicts and quarantine plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import integrity as g
from auditloom.plans.fixtures import SQL_FILES, files, table


def _sides(spark, d):
    f = files(spark, d)
    return f.filter("split = 'val'"), f.filter("split = 'train'")


def exact_dup_groups(spark, d):
    return g.duplicate_groups(files(spark, d))


def redundant_counts(spark, d):
    return g.redundant_counts(g.duplicate_groups(files(spark, d)))


def conflict_groups(spark, d):
    return g.conflict_groups(files(spark, d)).select("digest", "files", F.array_join("labels", ",").alias("labels"))


def conflict_label_pairs(spark, d):
    return g.conflict_pairs(g.conflict_groups(files(spark, d)))


def split_pair_counts(spark, d):
    return g.split_pairs(files(spark, d))


def name_conflicts(spark, d):
    return g.name_conflicts(files(spark, d))


def leak_semi(spark, d):
    val, train = _sides(spark, d)
    return g.exact_leaks(val, train).select("doc_id", "digest", "label")


def leak_overlap(spark, d):
    return g.leak_overlap(files(spark, d))


def family_leak(spark, d):
    val, train = _sides(spark, d)
    return g.family_leaks(val, train).groupBy("label").agg(F.count("*").alias("n"))


def clash_not_leak(spark, d):
    val, train = _sides(spark, d)
    return g.clashes_without_leak(val, train).select("doc_id", "family", "label")


def _renamed_sides(spark, d):
    """Train and val, with a class that each calls by another name."""
    val, train = _sides(spark, d)
    return train.withColumn("label", F.when(F.col("label") == "src3", "old3").otherwise(F.col("label"))), val.withColumn("label", F.when(F.col("label") == "src5", "new5").otherwise(F.col("label")))


def missing_unexpected(spark, d):
    return g.class_sets(*_renamed_sides(spark, d))


def class_union(spark, d):
    train, val = _renamed_sides(spark, d)
    return train.select("label").union(val.select("label")).distinct()


def class_intersection(spark, d):
    train, val = _renamed_sides(spark, d)
    return train.select("label").intersect(val.select("label"))


def class_difference(spark, d):
    train, val = _renamed_sides(spark, d)
    return train.select("label").subtract(val.select("label"))


def dedup_keep_first(spark, d):
    order = [F.when(F.col("split") == "train", 0).otherwise(1), F.lower("path"), F.col("path")]
    return g.keep_first(files(spark, d), ["digest"], order).select("doc_id", "digest")


def _planned(spark, d):
    return g.quarantine_plan(files(spark, d), (F.col("label") == "src3") & (F.col("split") == "val"))


def quarantine_plan(spark, d):
    return _planned(spark, d).select("path", "label", F.col("split").alias("from_split"), F.when(F.col("reason").isNull(), "keep").otherwise("quarantine").alias("action"), "reason")


def quarantine_breakdown(spark, d):
    return _planned(spark, d).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def split_counts(spark, d):
    """Rows by label before and after the quarantine."""
    p = _planned(spark, d)
    return p.groupBy("label").agg(F.count("*").alias("before"), F.count_if(F.col("reason").isNull()).cast("long").alias("after"))


def plan_verification(spark, d):
    return g.verify_split(files(spark, d))


def quarantine_sides(spark, d):
    a = files(spark, d).withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("doc_id") % 3 + 1).cast("int"))).select("digest", "split", F.col("path").alias("file"), "doc_id")
    return g.split_direction_by_group(a, "digest", "doc_id")


def digest_memo(spark, d):
    """Digests of a second run: the first run's are reused where length and time agree."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("path"), F.col("n_chars").alias("length"), (F.col("doc_id") % 5).alias("modified"), "text")
    memo = docs.filter("length % 3 <> 0").select("path", "length", F.when(F.col("length") % 7 == 0, -1).otherwise(F.col("modified")).alias("modified"), F.concat(F.lit("memo:"), F.md5("text")).alias("digest"))
    return g.digests_with_memo(docs, memo, lambda x: x.withColumn("digest", F.md5("text"))).select("path", "digest")


QUERIES = {f.__name__: f for f in (exact_dup_groups, redundant_counts, conflict_groups, conflict_label_pairs, split_pair_counts, name_conflicts, leak_semi, leak_overlap, family_leak, clash_not_leak, missing_unexpected, class_union, class_intersection, class_difference, dedup_keep_first, quarantine_plan, quarantine_breakdown, split_counts, plan_verification, quarantine_sides, digest_memo)}

_F = f"WITH {SQL_FILES}"
_G = f"{_F}, g AS (SELECT digest, count(*) AS files, count(*) - 1 AS redundant, count(DISTINCT label) AS labels, count(DISTINCT split) AS splits, CASE WHEN count(DISTINCT split) > 1 THEN 'cross_split' ELSE 'within_split' END AS kind FROM f GROUP BY digest HAVING count(*) > 1)"
_A = "SELECT DISTINCT CASE WHEN label = 'src3' THEN 'old3' ELSE label END AS label FROM f WHERE split = 'train'"
_B = "SELECT DISTINCT CASE WHEN label = 'src5' THEN 'new5' ELSE label END AS label FROM f WHERE split = 'val'"
_Q = f"""{_F}, m AS (SELECT f.*, (SELECT count(DISTINCT label) FROM f x WHERE x.digest = f.digest) AS nl, row_number() OVER (PARTITION BY label, digest ORDER BY CASE WHEN split = 'train' THEN 0 ELSE 1 END, lower(path), path) AS r FROM f),
q AS (SELECT *, CASE WHEN nl > 1 THEN 'cross_class_duplicate' WHEN r > 1 THEN 'same_class_duplicate' WHEN label = 'src3' AND split = 'val' THEN 'mislabelled' END AS reason FROM m)"""
_L = f"{_F}, x AS (SELECT DISTINCT digest, label FROM f)"
ORACLE_SQL = {
    "exact_dup_groups": f"{_G} SELECT * FROM g",
    "redundant_counts": f"{_G} SELECT kind, count(*) AS groups, CAST(sum(files) AS BIGINT) AS files, CAST(sum(redundant) AS BIGINT) AS redundant FROM g GROUP BY kind",
    "conflict_groups": f"{_F} SELECT digest, count(*) AS files, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM f GROUP BY digest HAVING count(DISTINCT label) > 1",
    "conflict_label_pairs": f"{_L} SELECT a.label AS label_a, b.label AS label_b, count(*) AS groups FROM x a JOIN x b ON a.digest = b.digest AND a.label < b.label GROUP BY ALL",
    "split_pair_counts": f"{_F}, x AS (SELECT DISTINCT digest, split FROM f) SELECT a.split || '<->' || b.split AS pair, count(*) AS groups FROM x a JOIN x b ON a.digest = b.digest AND a.split < b.split GROUP BY ALL",
    "name_conflicts": f"{_F} SELECT name, count(DISTINCT split) AS splits, count(DISTINCT digest) AS digests FROM f GROUP BY name HAVING splits > 1 AND digests > 1",
    "leak_semi": f"{_F} SELECT doc_id, digest, label FROM f WHERE split = 'val' AND digest IN (SELECT digest FROM f WHERE split = 'train')",
    "leak_overlap": f"{_F} SELECT digest, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val FROM f GROUP BY digest HAVING n_train > 0 AND n_val > 0",
    "family_leak": f"{_F} SELECT label, count(*) AS n FROM f v WHERE split = 'val' AND EXISTS (SELECT 1 FROM f t WHERE t.split = 'train' AND t.label = v.label AND t.family = v.family) GROUP BY label",
    "clash_not_leak": f"{_F} SELECT doc_id, family, label FROM f v WHERE split = 'val' AND EXISTS (SELECT 1 FROM f t WHERE t.split = 'train' AND t.family = v.family) AND NOT EXISTS (SELECT 1 FROM f t WHERE t.split = 'train' AND t.label = v.label AND t.family = v.family)",
    "missing_unexpected": f"{_F}, a AS ({_A}), b AS ({_B}) SELECT coalesce(a.label, b.label) AS label, CASE WHEN b.label IS NULL THEN 'missing' WHEN a.label IS NULL THEN 'unexpected' ELSE 'both' END AS status FROM a FULL JOIN b ON a.label = b.label",
    "class_union": f"{_F} {_A} UNION {_B}",
    "class_intersection": f"{_F} {_A} INTERSECT {_B}",
    "class_difference": f"{_F} {_A} EXCEPT {_B}",
    "dedup_keep_first": f"{_F}, r AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY CASE WHEN split = 'train' THEN 0 ELSE 1 END, lower(path), path) AS r FROM f) SELECT doc_id, digest FROM r WHERE r = 1",
    "quarantine_plan": f"{_Q} SELECT path, label, split AS from_split, CASE WHEN reason IS NULL THEN 'keep' ELSE 'quarantine' END AS action, reason FROM q",
    "quarantine_breakdown": f"{_Q} SELECT reason, count(*) AS n FROM q WHERE reason IS NOT NULL GROUP BY reason",
    "split_counts": f'{_Q} SELECT label, count(*) AS "before", count(*) FILTER (WHERE reason IS NULL) AS "after" FROM q GROUP BY label',
    "plan_verification": f"""{_F}, z AS (SELECT label, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val FROM f GROUP BY label),
dg AS (SELECT label, count(*) AS n FROM (SELECT label, digest FROM f GROUP BY ALL HAVING count(DISTINCT split) > 1) GROUP BY label), fm AS (SELECT label, count(*) AS n FROM (SELECT label, family FROM f GROUP BY ALL HAVING count(DISTINCT split) > 1) GROUP BY label)
SELECT z.label, train, val, coalesce(dg.n, 0) AS shared_digests, coalesce(fm.n, 0) AS shared_families, coalesce(dg.n, 0) = 0 AND coalesce(fm.n, 0) = 0 AND train > 0 AND val > 0 AS ok FROM z LEFT JOIN dg USING (label) LEFT JOIN fm USING (label)""",
    "quarantine_sides": f"""{_F}, a AS (SELECT digest, ['train', 'val', 'test'][doc_id % 3 + 1] AS split, path AS file, doc_id FROM f), j AS (SELECT x.split AS sa, x.file AS fa, y.split AS sb, y.file AS fb FROM a x JOIN a y ON x.digest = y.digest AND x.doc_id < y.doc_id),
k AS (SELECT *, CASE WHEN sa = 'train' AND sb = 'train' THEN NULL WHEN sa = 'train' THEN 'a' WHEN sb = 'train' THEN 'b' WHEN sa = 'val' THEN 'a' WHEN sb = 'val' THEN 'b' END AS side FROM j)
SELECT DISTINCT CASE WHEN side = 'a' THEN sa ELSE sb END AS split, CASE WHEN side = 'a' THEN fa ELSE fb END AS file FROM k WHERE side IS NOT NULL""",
    "digest_memo": "SELECT 'doc_' || doc_id AS path, CASE WHEN n_chars % 3 <> 0 AND n_chars % 7 <> 0 THEN 'memo:' ELSE '' END || md5(text) AS digest FROM documents",
}
