"""Near duplicates by one-permutation MinHash with optimal densification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import NOT_SPACE, byte_view, fixed, materialise, mix, pieces_of, record_batch, shingles, unique_rows, with_id, words
from auditloom.llm.components import components, joined

_U = np.uint64
_EMPTY = np.iinfo(np.uint64).max
_SET = pa.schema([("_key", pa.int64()), ("_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64()))])
_SET_DDL = "_key long, _id long, n long, s1 long, s2 long, bands array<long>"
_FULL = pa.schema([("_key", pa.int64()), ("grams", pa.binary())])


def signatures(grams: np.ndarray, bounds: np.ndarray, bins: int) -> np.ndarray:
    """One row of `bins` minima for each non-empty set of sorted shingle hashes.

    One permutation: a hash falls into a bin by its size, and the least hash of a bin is its
    minimum. An empty bin takes the minimum of another, found by a hash of the bin's number
    and a counter that runs until the bin hit isn't empty (optimal densification), so equal
    sets and only similar sets agree there, with the same probability as in other bins.
    """
    n = len(bounds) - 1
    text = np.repeat(np.arange(n), np.diff(bounds))
    cell = text * bins + ((grams >> _U(32)) * _U(bins) >> _U(32)).astype(np.int64)
    new = np.ones(len(cell), bool)
    new[1:] = cell[1:] != cell[:-1]
    out = np.full(n * bins, _EMPTY)
    out[cell[new]] = grams[new]
    raw = out.reshape(n, bins)
    out = raw.copy()
    row, col = np.nonzero((raw == _EMPTY) & (np.diff(bounds) > 0)[:, None])
    tries = 0
    while len(row):
        tries += 1
        source = (mix((col * 1_000_003 + tries * 7_919).astype(np.uint64)) % _U(bins)).astype(np.int64)
        value = raw[row, source]
        full = value != _EMPTY
        out[row[full], col[full]] = value[full]
        row, col = row[~full], col[~full]
    return out


def _sets(k: int, bands: int, rows: int):
    def sets(batches):
        for batch in pieces_of(batches, 2, 2 << 20):
            grams, bounds = shingles(*words(*byte_view(batch.column(2)), NOT_SPACE), k)
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            s1, s2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            keys = np.zeros((len(full), bands), np.uint64)
            if len(full):
                with np.errstate(over="ignore"):
                    s1[full] = np.add.reduceat(mix(grams + _U(11)), bounds[:-1][full])
                    s2[full] = np.add.reduceat(mix(grams ^ _U(0x5555AAAA5555AAAA)), bounds[:-1][full])
                    sig = signatures(grams, np.append(bounds[:-1][full], len(grams)), bands * rows).reshape(len(full), bands, rows)
                    keys += np.arange(bands, dtype=np.uint64) + _U(1)
                    for r in range(rows):
                        keys = mix(keys * _U(0x9FB21C651E98DF25) + sig[:, :, r])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.append(0, np.where(n > 0, bands, 0))), pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
            yield record_batch(_SET, batch.column(0), batch.column(1), n, s1.view(np.int64), s2.view(np.int64), lists)

    return sets


def _full_sets(k: int):
    def sets(batches):
        for batch in pieces_of(batches):
            grams, bounds = shingles(*words(*byte_view(batch.column(1)), NOT_SPACE), k)
            yield record_batch(_FULL, batch.column(0), [fixed(grams[a:b]) for a, b in zip(bounds[:-1], bounds[1:])])

    return sets


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _confirmed(percent: int):
    def confirm(batches):
        for batch in batches:
            kept = []
            for x, y in zip(batch.column(2), batch.column(3)):
                both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                kept.append(100 * common >= percent * (len(both) - common))
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    return confirm


#: Rows that Python gets at a time: pairs of sets, and pairs of blocks, of a few megabytes in all
#: as a rule; Spark ends a batch at 64 MB (spark.sql.execution.arrow.maxBytesPerBatch).
PAIR_ROWS, MEETING_ROWS = 200, 16
#: Nodes in a block, a long one counting as one for each so many shingles; and shingles that
#: a comparison of two blocks has in its table at a time.
BLOCK_NODES, NODE_SHINGLES, SLICE = 48, 2000, 8192
_BLOCK_DDL = "array<struct<node:bigint,component:bigint,grams:binary>>"


def _compared(percent: int):
    """Links between nodes of two blocks (arrays of node, component, grams) in different components."""

    def unpacked(block):
        grams = [np.frombuffer(x["grams"], np.uint64) for x in block]
        return np.array([x["node"] for x in block], np.int64), np.array([x["component"] for x in block], np.int64), np.array([len(g) for g in grams], np.int64), np.concatenate(grams)

    def compare(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                node_x, of_x, n_x, x = unpacked(batch.column(0)[i].as_py())
                node_y, of_y, n_y, y = unpacked(batch.column(1)[i].as_py())
                both = np.intersect1d(x, y)
                common = np.zeros((len(n_x), len(n_y)), np.float32)
                row_x, row_y = np.repeat(np.arange(len(n_x)), n_x), np.repeat(np.arange(len(n_y)), n_y)
                for at in range(0, len(both), SLICE):
                    part = both[at : at + SLICE]
                    tables = []
                    for grams, row, n in ((x, row_x, len(n_x)), (y, row_y, len(n_y))):
                        col = np.minimum(np.searchsorted(part, grams), len(part) - 1)
                        has = part[col] == grams
                        table = np.zeros((n, len(part)), np.float32)
                        table[row[has], col[has]] = 1
                        tables.append(table)
                    common += tables[0] @ tables[1].T  # whole numbers below 2 ** 24: exact
                shared = common.astype(np.int64)
                linked = (100 * shared >= percent * (n_x[:, None] + n_y[None, :] - shared)) & (of_x[:, None] != of_y[None, :])
                a, b = np.nonzero(linked)
                yield record_batch(_LINK, np.minimum(node_x[a], node_y[b]), np.maximum(node_x[a], node_y[b]))

    return compare


def _between(open_: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of one bucket that are in different components.

    open_ (bucket, node, n, component, low) has the buckets whose members are in several
    components, low being the smallest. Components that such buckets tie together are a
    cluster; a cluster is dealt into
    blocks of bounded size, a component that fills blocks of its own apart from the rest, and
    small clusters share blocks. Blocks with a common bucket are compared as a whole, in one
    row, unless both are of the same component. So no pair of nodes is a row, each two blocks
    meet once however many buckets they share, and no task holds more than two blocks.
    """
    ties = open_.filter("component <> low").select(F.col("low").alias("a"), F.col("component").alias("b")).distinct()
    clusters = components(ties).select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    nodes = open_.select("node", "n", "component").distinct().withColumn("weight", F.greatest(F.lit(1), F.floor(F.col("n") / NODE_SHINGLES)))
    nodes = materialise(nodes.join(clusters, "component"), "clusters")

    def parts(total: str):
        return F.ceil(F.col(total) / BLOCK_NODES)

    whole = nodes.groupBy("cluster", "component").agg(F.sum("weight").alias("own")).withColumn("fills", F.col("own") >= BLOCK_NODES)
    rest = whole.filter("not fills").groupBy("cluster").agg(F.sum("own").alias("rest"))
    small = rest.filter(F.col("rest") < BLOCK_NODES).agg(F.sum("rest")).first()[0] or 1
    dealt = nodes.join(whole, ["cluster", "component"]).join(rest, "cluster", "left").select(
        "node",
        "component",
        F.when(F.col("fills"), F.col("component")).alias("only"),
        F.when(F.col("fills"), F.xxhash64(F.lit("own"), "component", F.pmod(F.xxhash64("node"), parts("own"))))
        .when(F.col("rest") >= BLOCK_NODES, F.xxhash64(F.lit("rest"), "cluster", F.pmod(F.xxhash64("component"), parts("rest"))))
        .otherwise(F.xxhash64(F.lit("small"), F.pmod(F.xxhash64("cluster"), F.lit(-(-small // BLOCK_NODES)))))
        .alias("block"),
    )
    dealt = materialise(dealt, "dealt")
    packed = dealt.join(full, F.col("node") == F.col("_key")).groupBy("block").agg(F.collect_list(F.struct("node", "component", "grams")).cast(_BLOCK_DDL).alias("held"))
    packed = materialise(packed, "blocks")
    at = open_.select("bucket", "node").join(dealt.select("node", "only", "block"), "node").select("bucket", "only", "block").distinct()
    other = at.select("bucket", F.col("only").alias("only_b"), F.col("block").alias("block_b"))
    meet = at.join(other, "bucket").filter("block <= block_b and (only is null or only_b is null or only <> only_b)").select("block", "block_b").distinct()
    meet = materialise(meet, "meetings")
    rows = meet.join(packed.select("block", F.col("held").alias("x")), "block").join(packed.select(F.col("block").alias("block_b"), F.col("held").alias("y")), "block_b")
    return rows.select("x", "y").mapInArrow(_compared(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = 72, rows: int = 7) -> DataFrame:
    """For each row: doc_id, n_shingles, component_id (smallest doc_id reachable), kept.

    A document's set holds the distinct k-word shingles of its lower-cased words, or all its
    words as one if it has fewer than k. Two documents are linked if
    100 * intersection >= percent * union, confirmed on the full sets.

    1. Each set is signed with bands * rows minima; `rows` minima make a bucket key. A pair at
       0.8 shares none of 72 buckets of 7 with probability 4e-8, and texts that share only a
       passage, however many they are, seldom share a bucket.
    2. Equal sets are one node from here on, whatever the number of copies. A shingle is a hash
       of 64 bits throughout; sets are equal by their size and two sums of 64 bits over them.
    3. In a bucket only the star from its smallest node is tested, which bounds the pairs by
       the members. Sizes that rule a link out are dropped first.
    4. Buckets whose members are not yet all in one component may hide further links. Their
       nodes are dealt into blocks, and blocks that share a bucket are compared as a whole, so
       that every pair of a bucket is in one component or tested. No pair is given up.

    Null or empty text, or no words: an empty set, linked with nothing, its own component. A
    null doc_id counts as smaller than any other. Rows that repeat a doc_id are documents of
    their own with one id. Empty table: no rows.
    """
    texts, repeated = unique_rows(docs, id_col, text_col)
    sets = materialise(texts.select("_key", "_id", "_text").mapInArrow(_sets(k, bands, rows), _SET_DDL), "sets")
    nodes = materialise(sets.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("_key").alias("node"), F.min_by("bands", "_key").alias("bands")), "nodes")
    member = nodes.select(F.explode("bands").alias("bucket"), "node", "n")
    shared = member.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("first")).filter("size > 1")
    members = materialise(member.join(shared.select("bucket", "first"), "bucket"), "members")
    wanted = members.select("node").distinct()
    full = materialise(texts.select("_key", "_text").join(wanted.hint("shuffle_hash"), texts["_key"] == wanted["node"], "left_semi").mapInArrow(_full_sets(k), "_key long, grams binary"), "shingles")

    fitting = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    sizes = nodes.select("node", "n")

    def confirmed(pairs: DataFrame) -> DataFrame:
        x, y = full.select(F.col("_key").alias("a"), F.col("grams").alias("x")), full.select(F.col("_key").alias("b"), F.col("grams").alias("y"))
        return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(_confirmed(percent), "a long, b long")

    stars = members.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"), F.col("n").alias("nb")).distinct()
    stars = stars.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").filter(fitting).select("a", "b")
    links = materialise(confirmed(materialise(stars, "pairs")), "links", PAIR_ROWS)
    labels = components(links)
    placed = members.join(labels, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    open_ = materialise(placed.join(mixed.select("bucket", "low"), "bucket"), "open")
    if not open_.isEmpty():
        found = materialise(_between(open_, full, percent), "links", MEETING_ROWS)
        if not found.isEmpty():
            labels = joined(labels, found)

    named = nodes.select("n", "s1", "s2", "node").join(labels, "node", "left").select("n", "s1", "s2", F.coalesce("component", "node").alias("component"))
    out = sets.select("_key", "_id", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left").withColumn("component", F.coalesce("component", "_key"))
    if repeated:
        out = out.join(sets.select(F.col("_key").alias("component"), F.col("_id").alias("component_id")), "component")
    else:
        out = out.withColumn("component_id", F.col("component"))
    return out.select(with_id(), F.col("n").alias("n_shingles"), with_id("component_id", "component_id"), (F.col("_key") == F.col("component")).alias("kept"))
