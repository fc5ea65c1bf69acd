"""Shared pieces of the document operators: reading columns, shared scratch tables, words.

Every operator reads only the columns it is told to, under internal names, so further columns
of a table, whatever they are called, neither reach nor clash with a result.
"""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside an operator; it sorts before every other id.
NULL_ID = -(2**63)


def with_id(name: str = "_id", out: str = "doc_id") -> Column:
    """The id column as results carry it: the stand-in becomes null again."""
    return F.when(F.col(name) != F.lit(NULL_ID), F.col(name)).alias(out)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id long, _text string) of each row; a null text is empty, a null id is NULL_ID."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"),
    )


def unique_rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(_key, _id, _text) with a distinct _key for each row, in the order of the ids.

    The key is the id itself where no id repeats. Else (True) the rows are put in the order
    (id, text) once, numbered and written out, so that repeated rows stay apart.
    """
    rows = id_and_text(docs, id_col, text_col)
    if rows.groupBy("_id").count().filter("count > 1").isEmpty():
        return rows.select(F.col("_id").alias("_key"), "_id", "_text"), False
    numbered = rows.repartitionByRange("_id", "_text").sortWithinPartitions("_id", "_text")
    return materialise(numbered.select(F.monotonically_increasing_id().alias("_key"), "_id", "_text"), "rows"), True


def partitions(spark: SparkSession) -> int:
    """How many parts the session deals shuffled rows into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="auditloom-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder of the cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.startswith("local"):  # one machine, as in tests
        root = _local_folder()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root}/auditloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Rows that go to a Python worker at a time: rows of packed columns are of some kilobytes, and
#: both sides hold a batch of each column in whole.
BATCH_ROWS = 2000


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Plans that are run meanwhile send Python workers `rows` rows at a time, or fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialise(df: DataFrame, name: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: this cuts the lineage,
    and a lost executor costs no recomputation. The files stay until the folder is cleared."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with small_batches(spark, batch_rows):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# --------------------------------------------------------------------------- Arrow batches


def pieces_of(batches: Iterable[pa.RecordBatch], column: int = 1, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text of each is about `most` bytes; one long text stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = byte_view(batch.column(column))[1][1:]
        begin, done = 0, 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(begin, end - begin)
            begin, done = end, int(ends[end - 1])


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets from 0) of a string or binary column without nulls; no copy."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


def fixed(values: np.ndarray) -> bytes:
    """The array's bytes, little-endian, as they travel in packed columns."""
    return np.ascontiguousarray(values).tobytes()


# --------------------------------------------------------------------------- hashes and words

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    with np.errstate(over="ignore"):
        x = (x + _U(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BYTE = mix(np.arange(256, dtype=np.uint64) + _U(7_000_003))
#: Bytes and words that are worked on at a time, so that a text of any length takes few of them at once.
SLICE = 1 << 20
_PLACE = np.zeros(0, np.uint64)


def _factors(begin: int, end: int) -> np.ndarray:
    """The factors of the bytes at the places begin..end - 1 of a word."""
    return mix(np.arange(begin, end, dtype=np.uint64) + _U(90_001)) | _U(1)


def _places(n: int) -> np.ndarray:
    global _PLACE
    if len(_PLACE) < n:
        _PLACE = _factors(0, max(64, n))
    return _PLACE


#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that end at ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of words made of a-z, 0-9 and everything beyond ASCII, after lower-casing.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each lower-cased word, first word of each text and the end)."""
    return placed_words(data, offsets, inside)[:2]


def placed_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first word of each text and the end, where each word starts, its length).

    `inside` says which lower-cased bytes belong to words. A word is hashed by a random
    multilinear form over its bytes, so that equal words of any batch have equal hashes. The
    form is a sum, so bytes are taken in slices, and a word may lie in several.
    """
    every_sum, every_start, every_length, before = [], [], [], False
    for at in range(0, len(data), SLICE):
        low = LOWER[data[at : at + SLICE]]
        yes = inside[low]
        first = yes.copy()
        first[1:] &= ~yes[:-1]
        first[0] &= not before
        begins = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, at + len(low))] - at
        first[begins] = yes[begins]
        before = bool(yes[-1])
        places = np.flatnonzero(yes)
        heads = np.flatnonzero(first[places])  # place in `places` where each word begins
        lead = int(heads[0]) if len(heads) else len(places)
        with np.errstate(over="ignore"):
            if lead:  # the rest of a word of the slice before
                done = int(every_length[-1][-1])
                every_sum[-1][-1] += (_BYTE[low[:lead]] * _factors(done, done + lead)).sum(dtype=np.uint64)
                every_length[-1][-1] += lead
            if len(heads):
                lengths = np.diff(np.append(heads, len(places)))
                place = np.arange(lead, len(places)) - np.repeat(heads, lengths)
                every_sum.append(np.add.reduceat(_BYTE[low[places[lead:]]] * _places(int(lengths.max()))[place], heads - lead))
                every_start.append(places[heads] + at)
                every_length.append(lengths)
    if not every_sum:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none
    starts, lengths = np.concatenate(every_start), np.concatenate(every_length)
    with np.errstate(over="ignore"):
        hashes = mix(np.concatenate(every_sum) + lengths.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(starts, offsets), starts, lengths


def shingles(hashes: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct k-word shingles of each text, sorted in each; their bounds).

    A text of fewer words, but not none, has its whole sequence as its only shingle.
    """
    begins, ends, n = firsts[:-1], firsts[1:], len(hashes)
    sums = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, n, SLICE):
            part = sums[at : at + SLICE]
            for j in range(k):
                words = hashes[at + j : at + j + len(part)]  # short at the end, where no shingle begins
                part[: len(words)] = mix(part[: len(words)] * _U(0x9FB21C651E98DF25) + words + _U(j))
        valid = np.ones(n, bool)
        for j in range(1, k):
            valid[(ends - j)[ends - j >= begins]] = False
        for size in range(1, k):
            short = begins[ends - begins == size]
            valid[short], whole = True, np.zeros(len(short), np.uint64)
            for j in range(size):
                whole = mix(whole * _U(0x9FB21C651E98DF25) + hashes[short + j] + _U(j))
            sums[short] = whole
    counts = ends - begins
    sums, bounds = sums[valid], np.append(0, np.cumsum(np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        sums[a:b].sort()
    fresh = np.ones(len(sums), bool)
    fresh[1:] = sums[1:] != sums[:-1]
    fresh[bounds[:-1][counts > 0]] = True
    return sums[fresh], np.append(0, np.cumsum(fresh))[bounds]
