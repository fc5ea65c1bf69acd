"""Exact duplicates by a tree merge of sorted digest runs."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import LOWER, byte_view, fixed, id_and_text, materialise, partitions, pieces_of, record_batch, with_id

#: A run's entry: the digest as four numbers (little-endian, as numpy makes fields native when
#: it joins runs), the text's length in bytes (a check on the digest), the id that stays so
#: far, and how many rows it stands for.
ENTRY = np.dtype([("a", "<u8"), ("b", "<u8"), ("c", "<u8"), ("d", "<u8"), ("size", "<i8"), ("keep", "<i8"), ("n", "<i8")])
_KEY = ("a", "b", "c", "d", "size")
#: Rows of the table for each digest range, so that a range's run is some 14 MB whatever the
#: table's size; and entries that a task holds before it sends its runs.
RANGE_ROWS, TASK_ENTRIES = 250_000, 1_000_000

_DIGEST = pa.schema([("_id", pa.int64()), ("size", pa.int64()), ("digest", pa.binary())])
_RUN = pa.schema([("range", pa.int64()), ("slot", pa.int64()), ("run", pa.binary())])
_GROUP = pa.schema([("digest", pa.binary()), ("size", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _digests(batches):
    for batch in pieces_of(batches):
        data, offsets = byte_view(batch.column(1))
        view, ends = memoryview(LOWER[data]), offsets.tolist()
        yield record_batch(_DIGEST, batch.column(0), np.diff(offsets), [hashlib.sha256(view[a:b]).digest() for a, b in zip(ends[:-1], ends[1:])])


def _native(run: np.ndarray, key: str) -> np.ndarray:
    return run[key].astype(np.int64 if key in ("size", "keep", "n") else np.uint64)


def sorted_run(entries: np.ndarray, largest: bool) -> np.ndarray:
    """Entries in any order as a run."""
    return folded(entries[np.lexsort([_native(entries, k) for k in reversed(_KEY)])], largest)


def _merged_two(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Two sequences ordered by `a` as one; each entry moves to its place, nothing is sorted."""
    out, at = np.empty(len(x) + len(y), ENTRY), np.searchsorted(_native(x, "a"), _native(y, "a"), "right") + np.arange(len(y))
    own = np.ones(len(out), bool)
    own[at] = False
    out[at], out[own] = y, x
    return out


def folded(every: np.ndarray, largest: bool) -> np.ndarray:
    """Entries ordered by `a` with one left for each (digest, length): equal ones, verified by the
    whole digest and the length, become the smallest (or largest) id and the sum of the counts."""
    if not len(every):
        return every
    a = _native(every, "a")
    same = a[1:] == a[:-1]
    differ = np.any([every[k][1:] != every[k][:-1] for k in _KEY[1:]], axis=0)
    if np.any(same & differ):  # equal in the first quarter of the digest only: order these by the rest
        every = every[np.lexsort([_native(every, k) for k in reversed(_KEY)])]
        same, differ = every["a"][1:] == every["a"][:-1], np.any([every[k][1:] != every[k][:-1] for k in _KEY[1:]], axis=0)
    heads = np.flatnonzero(np.append(True, ~same | differ))
    out = every[heads]
    out["keep"] = (np.maximum if largest else np.minimum).reduceat(_native(every, "keep"), heads)
    out["n"] = np.add.reduceat(_native(every, "n"), heads)
    return out


def merge_runs(runs: list[np.ndarray], largest: bool) -> np.ndarray:
    """Merge sorted runs into one, two neighbours at a time until one is left, with an entry for
    each (digest, length): the smallest (or largest) id and the sum of the counts."""
    runs = list(runs) or [np.zeros(0, ENTRY)]
    while len(runs) > 1:
        runs = [folded(_merged_two(*runs[i : i + 2]), largest) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0]


def _leaf_runs(ranges: int, largest: bool):
    def send(runs):
        run = merge_runs(runs, largest)
        of = ((_native(run, "a") >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        cuts = np.flatnonzero(np.diff(of.astype(np.int64))) + 1
        parts = np.split(run, cuts) if len(run) else []
        slot = TaskContext.get().partitionId()
        for at in range(0, len(parts), 5000):
            some = parts[at : at + 5000]
            yield record_batch(_RUN, of[np.append(0, cuts)][at : at + 5000].astype(np.int64), [slot] * len(some), [fixed(p) for p in some])

    def leaf(batches):
        runs, n = [], 0
        for batch in batches:
            part = np.zeros(batch.num_rows, ENTRY)
            words = np.frombuffer(b"".join(batch.column(2).to_pylist()), ">u8").reshape(-1, 4)
            for i, k in enumerate("abcd"):
                part[k] = words[:, i]
            part["size"], part["keep"], part["n"] = batch.column(1).to_numpy(), batch.column(0).to_numpy(), 1
            runs.append(sorted_run(part, largest))
            n += len(runs[-1])
            if n >= TASK_ENTRIES:
                yield from send(runs)
                runs, n = [], 0
        if runs:
            yield from send(runs)

    return leaf


def _merged(largest: bool):
    def merge(key, table):
        runs = [np.frombuffer(r, ENTRY) for r in table.column("run").to_pylist()]
        return pa.table({"range": [key[0].as_py()], "slot": [key[1].as_py()], "run": [fixed(merge_runs(runs, largest))]}, schema=_RUN)

    return merge


def _grouped(largest: bool):
    """The last merge of a range: of the entries only those of two rows or more. The merge and the
    choice are one function, so that a task needs one Python worker and not two."""

    def merge(key, table):
        run = merge_runs([np.frombuffer(r, ENTRY) for r in table.column("run").to_pylist()], largest)
        run = run[run["n"] > 1]
        digests = np.stack([run[k] for k in "abcd"], axis=1).astype(">u8").tobytes() if len(run) else b""
        columns = [[digests[i : i + 32] for i in range(0, len(digests), 32)], run["size"].astype(np.int64), run["keep"].astype(np.int64), run["n"].astype(np.int64)]
        return pa.Table.from_batches([record_batch(_GROUP, *columns)])

    return merge


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_in: int = 8) -> DataFrame:
    """For each row: doc_id, keep_id, group_size, kept, text_sha256 (hex of the lower-cased text).

    Texts are equal if they are identical after lower-casing A-Z. Each partition sorts its
    digests into runs, one for each digest range, and folds its own copies. Then runs of the
    same range meet `fan_in` at a time, round by round (a binomial tree for 2), until each
    range has one; each merge keeps the smallest or largest id of equal digests, verified by
    the texts' lengths. There is a range for each RANGE_ROWS rows, so no run outgrows a task,
    and a partition of very many rows sends several runs. So a group of any size is one entry for each partition before
    anything is shuffled, and a range holds distinct texts only. Lastly the groups of two or
    more join the documents again, where Spark splits a frequent digest.

    Null text: empty, and equal to other empty texts. A null id counts as smaller than any
    other; where it stays, keep_id is null. Rows that repeat an id each count and each get a
    row; all rows with the id that stays are kept. Empty table: no rows.
    """
    if keep not in ("smallest", "largest") or fan_in < 2:
        raise ValueError("keep is 'smallest' or 'largest', fan_in at least 2")
    largest, spark = keep == "largest", docs.sparkSession
    digests = materialise(id_and_text(docs, id_col, text_col).mapInArrow(_digests, "_id long, size long, digest binary"), "digests")
    ranges = min(1 << 31, max(partitions(spark), -(-digests.count() // RANGE_ROWS)))
    runs = digests.mapInArrow(_leaf_runs(ranges, largest), "range long, slot long, run binary")
    slots = digests.rdd.getNumPartitions()
    while slots > fan_in:
        slots = -(-slots // fan_in)
        runs = runs.withColumn("slot", F.floor(F.col("slot") / fan_in)).groupBy("range", "slot").applyInArrow(_merged(largest), "range long, slot long, run binary")
    groups = runs.groupBy("range").applyInArrow(_grouped(largest), "digest binary, size long, keep_id long, group_size long")
    joined = digests.join(groups, ["digest", "size"], "left").withColumn("keep_id", F.coalesce("keep_id", "_id"))
    return joined.select(
        with_id(),
        with_id("keep_id", "keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_id") == F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
