"""The reviewed tables seen as datasets: predictions, labelled files, signatures, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators.similarity import sign_signature

#: Names of a class list, which goes to the driver.
MOST_CLASSES = 10_000
THRESHOLDS = [0.0, 0.5, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def class_names(spark: SparkSession, sf_dir: str) -> list[str]:
    """The class list: sorted distinct event types, MOST_CLASSES at most."""
    names = [r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").limit(MOST_CLASSES + 1).collect()]
    if len(names) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes: not a class list")
    return names


def group_of(name: Column) -> Column:
    """A rollup of the classes by their last letter: classes of one group share a crop."""
    return F.when(name.isin("click", "view"), "page").when(name.isin("purchase", "signup"), "account").otherwise("other")


SQL_GROUP = "CASE WHEN {0} IN ('click', 'view') THEN 'page' WHEN {0} IN ('purchase', 'signup') THEN 'account' ELSE 'other' END"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, family, true, pred, conf, ts of each event: predictions that are right in 7 of 10."""
    names = class_names(spark, sf_dir)
    at = lambda shift: F.array(*[F.lit(n) for n in names])[((F.array_position(F.array(*[F.lit(n) for n in names]), F.col("event_type")) - 1 + shift) % len(names)).cast("int")]
    shift = F.when(F.col("event_id") % 10 < 7, 0).when(F.col("event_id") % 10 < 9, 1).otherwise(2)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("family"), F.col("event_type").alias("truth"), at(shift).alias("pred"), ((F.col("event_id") % 101) / F.lit(100.0)).alias("conf"), "ts")


SQL_PRED = """
t AS (SELECT list_sort(list(DISTINCT event_type)) AS ts FROM events),
c AS (SELECT unnest(ts) AS name, unnest(range(len(ts))) AS idx FROM t),
p AS (SELECT event_id AS id, user_id AS family, event_type AS "truth",
        t.ts[(list_position(t.ts, event_type) - 1 + CASE WHEN event_id % 10 < 7 THEN 0 WHEN event_id % 10 < 9 THEN 1 ELSE 2 END) % len(t.ts) + 1] AS pred,
        CAST(event_id % 101 AS DOUBLE) / 100.0 AS conf, events.ts FROM events, t)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as labelled files: path, name, label (source), split by parity, digest, family."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string")).alias("path"),
        F.concat(F.lit("doc_"), (F.col("doc_id") % 400).cast("string"), F.lit(".txt")).alias("name"),
        F.col("source").alias("label"),
        F.when(F.col("doc_id") % 2 == 0, "train").otherwise("val").alias("split"),
        F.md5("text").alias("digest"),
        F.concat(F.lit("f"), (F.col("n_chars") % 97).cast("string")).alias("family"),
        "doc_id",
    )


SQL_FILES = """
f AS (SELECT source || '/doc_' || doc_id AS path, 'doc_' || (doc_id % 400) || '.txt' AS name, source AS label,
        CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'val' END AS split, md5(text) AS digest, 'f' || (n_chars % 97) AS family, doc_id FROM documents)"""


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, sig: the signs of the embeddings as 64-bit signatures."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", sign_signature(F.col("embedding")).alias("sig"))


SQL_SIGS = """
s AS (SELECT vec_id, label, CAST(array_to_string([CASE WHEN embedding[i] > 0 THEN '1' ELSE '0' END FOR i IN range(1, 65)], '') AS BIT) AS sig FROM embeddings)"""
