"""The document pipeline: stages over `documents`, each on what the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return rows of
`documents` as they are. Rows are dropped by a key of their own, so that rows with
equal or null ids are judged one by one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm.common import materialise
from auditloom.llm.decontaminate import contamination
from auditloom.llm.exact_dedup import exact_duplicates
from auditloom.llm.near_dedup import near_duplicates
from auditloom.llm.quality import keep_good
from auditloom.llm.queries import table, tokenizer_path
from auditloom.llm.sentencepiece_bpe import encode_decode


_KEY = "auditloom key"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of its own for each row, in the order of the ids, null ids first.

    The key is the id where no id repeats. Else the rows are put in the order of id and text
    hash, numbered and written out; rows alike in both are still dealt to several tasks.
    """
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return docs.withColumn(_KEY, F.col("doc_id").cast("long"))
    order = [f"{_KEY} {i}" for i in range(3)]
    placed = docs.select("*", *[c.alias(o) for c, o in zip((F.col("doc_id").cast("long"), F.xxhash64("text"), F.monotonically_increasing_id()), order)])
    return materialise(placed.repartitionByRange(*order).sortWithinPartitions(*order).drop(*order).withColumn(_KEY, F.monotonically_increasing_id()), "keyed")


def _without(keyed: DataFrame, judged: DataFrame, keep: str) -> DataFrame:
    """keyed, less its key, without the rows that judged (doc_id, which holds the key, and keep) doesn't keep.

    The keys that go are written out first: then Spark knows their size before it plans the
    join, and texts are shuffled only where the keys are too many to send to all executors."""
    gone = materialise(judged.filter(~F.col(keep)).select(F.col("doc_id").alias("_gone")), "gone")
    return keyed.join(gone, keyed[_KEY].eqNullSafe(gone["_gone"]), "left_anti").drop(_KEY)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return keep_good(docs, labelled=table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; of rows that repeat it, one."""
    keyed = _keyed(docs)
    return _without(keyed, exact_duplicates(keyed, id_col=_KEY, keep="largest"), "kept")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the row with
    the smallest doc_id; of rows that repeat it, one."""
    keyed = _keyed(docs)
    return _without(keyed, near_duplicates(keyed, id_col=_KEY, k=5), "kept")


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    keyed = _keyed(docs)
    judged = contamination(keyed, table(spark, sf_dir, "benchmark"), id_col=_KEY).withColumn("clean", ~F.col("contaminated"))
    return _without(keyed, judged, "clean")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document that is left, and the text they decode to, as digests."""
    return encode_decode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("minhash near-dedup", near),
    ("benchmark decontamination", clean_of_benchmarks),
    ("sentencepiece", encoded),
]

#: No SQL: the classifier and the encoder can't be said in it. tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
