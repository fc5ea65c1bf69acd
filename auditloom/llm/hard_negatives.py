"""Hard negatives by a kNN join over Voronoi cells.

Vectors become integers, so scores (inner products) are exact. With one component more, the root of
M^2 - |x|^2 for the largest norm M (0 for an anchor), the distance of an anchor a and a row x is
|a|^2 + M^2 - 2 a.x: the larger the score, the nearer. So

1. rows and anchors are assigned to the nearest pivot, and the anchors of a cell, cut into groups
   of bounded size, know how far from the pivot their farthest anchor is;
2. a group is joined with the rows of its own cell first. What its anchors find there bounds
   what a row must score to serve any of them;
3. with a row's distance to the group's pivot, the triangle inequality bounds its scores with
   all anchors of the group. The row is sent only to groups that it may serve, in packs, and
   each pack is compared with the group's anchors as one matrix product, keeping the best.

So the positives are found, and then in the same way the rows in the score windows of their negatives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditloom.llm.common import NULL_ID, materialise, partitions, record_batch

#: Components are kept within these bounds, so that scores of 128 dimensions fit 64 bits.
MOST_COMPONENT = 1 << 28
#: Anchors of a group (or more, so that there are about MOST_GROUPS at most), rows of a pack, most pivots.
GROUP_ANCHORS, MOST_GROUPS, PACK_ROWS, MOST_PIVOTS = 512, 1 << 16, 4096, 1024
#: Rows of a batch for Python: vectors are short, and Spark ends a batch of packs at 64 MB.
PACKED_BATCH = 10_000
#: Groups whose best rows a task holds, of some hundred kilobytes each.
HELD_GROUPS = 200
#: Rows that pivots are taken from.
PIVOT_SAMPLE = 8192

_ROW = "_key long, _id long, _label long, _vector binary, _anchor boolean, _square double"
_PACK = pa.schema([("group", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary())])
_PACK_DDL = "group long, keys binary, ids binary, labels binary, vectors binary"
_BEST = pa.schema([("anchor", pa.int64()), ("window", pa.int64()), ("score", pa.int64()), ("id", pa.int64()), ("key", pa.int64())])
_BEST_DDL = "anchor long, window long, score long, id long, key long"


def _integers(scale: float):
    """Rows with vectors of integers; rows without label, vector or a finite component are left out."""
    schema = pa.schema([("_id", pa.int64()), ("_label", pa.int64()), ("_vector", pa.binary()), ("_anchor", pa.bool_()), ("_square", pa.float64())])

    def run(batches):
        for batch in batches:
            lists = batch.column(2).cast(pa.list_(pa.float64()))
            flat, ends = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            x = np.floor(scale * flat.fill_null(np.nan).to_numpy(zero_copy_only=False))
            bounds = np.append(0, np.cumsum(ends))
            bad = np.append(0, np.cumsum(~np.isfinite(x)))[bounds]
            keep = (bad[1:] == bad[:-1]) & ~lists.is_null().to_numpy(zero_copy_only=False) & ~batch.column(1).is_null().to_numpy(zero_copy_only=False)
            x = np.clip(np.where(np.isfinite(x), x, 0), -MOST_COMPONENT, MOST_COMPONENT).astype("<i4")
            at = np.flatnonzero(keep)
            squares = np.append(0, np.cumsum(np.where(np.repeat(keep, ends), x.astype(np.int64) ** 2, 0)))[bounds] if len(x) else np.zeros(len(bounds))
            some = [batch.column(i).take(pa.array(at)) for i in (0, 1, 3)]
            yield record_batch(schema, some[0], some[1], [x[bounds[i] : bounds[i + 1]].tobytes() for i in at.tolist()], some[2], np.diff(squares)[at].astype(np.float64))

    return run


def _matrix(vectors: list[bytes], dim: int) -> np.ndarray:
    """Vectors as rows of whole numbers; shorter ones are filled up with zeros."""
    if all(len(v) == 4 * dim for v in vectors):
        return np.frombuffer(b"".join(vectors), "<i4").reshape(-1, dim)
    out = np.zeros((len(vectors), dim), "<i4")
    for i, v in enumerate(vectors):
        out[i, : len(v) // 4] = np.frombuffer(v, "<i4")
    return out


def scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: by floating point where all sums are whole numbers below 2 ** 53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ x.astype(np.int64).T


class Space:
    """Pivots, and the distances of rows and anchors to them."""

    def __init__(self, pivots: np.ndarray, norm: float) -> None:
        """pivots: rows of the sample; norm: the largest square of a row's length."""
        self.dim, self.norm = pivots.shape[1], norm
        self.pivots = self._raised(pivots, False)

    def _raised(self, x: np.ndarray, anchors: bool) -> np.ndarray:
        x = x.astype(np.float64)
        more = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(0, self.norm - (x * x).sum(1)))
        return np.column_stack([x, more])

    def distances(self, x: np.ndarray, anchors: bool = False) -> np.ndarray:
        x = self._raised(x, anchors)
        squares = (x * x).sum(1)[:, None] + (self.pivots * self.pivots).sum(1)[None] - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(0, squares))


def _cells(space, column: int, anchors: bool):
    """The rows, with the nearest pivot, the distance to it and the square of the length."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(column).to_pylist(), space.value.dim)
                d = space.value.distances(x, anchors)
                cell = d.argmin(1)
                more = [pa.array(cell.astype(np.int64)), pa.array(d[np.arange(len(d)), cell])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "cell", "far"])

    return run


class Groups:
    """What is known of the groups of anchors: pivot, reach, lengths, and the scores of use to them."""

    def __init__(self, table: pa.Table) -> None:
        """table: group, cell, reach, low_square, high_square, label (or null for any), low, high."""
        c = {n: table.column(n).to_numpy() for n in ("group", "cell", "reach", "low_square", "high_square", "low", "high")}
        self.group, self.cell, self.reach, self.low, self.high = c["group"], c["cell"], c["reach"], c["low"], c["high"]
        self.squares = c["low_square"], c["high_square"]
        label = table.column("label")
        self.label = label.fill_null(0).to_numpy()
        self.any = label.is_null().to_numpy()
        self.of_group: list[tuple[int, list[int]]] = sorted((g, np.flatnonzero(self.group == g).tolist()) for g in set(self.group.tolist()))


def _sent(space, groups, own_cell: bool):
    """Packs of rows for the groups that they may serve: of their own cell, or of all others."""

    def run(batches):
        s, g = space.value, groups.value
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(3).to_pylist()
            keys, ids, labels = (batch.column(i).to_numpy() for i in range(3))
            x = _matrix(vectors, s.dim)
            d = s.distances(x)
            cell = d.argmin(1)
            size = np.sqrt(np.maximum(0, s.norm)) + 1
            slack = 1e-6 * size * size + 1  # of rounding
            for group, some in g.of_group:
                take = np.zeros(len(x), bool)
                for i in some:  # the labels of the group's anchors, or one row for all
                    own = (cell == g.cell[i]) == own_cell
                    if not g.any[i]:
                        own &= labels == g.label[i]
                    if not own_cell:
                        far = d[:, g.cell[i]]
                        high = (g.squares[1][i] + s.norm - np.maximum(0, far - g.reach[i]) ** 2) / 2 + slack
                        low = (g.squares[0][i] + s.norm - (far + g.reach[i]) ** 2) / 2 - slack
                        own &= (high >= g.low[i]) & (low <= g.high[i])
                    take |= own
                at = np.flatnonzero(take)
                for begin in range(0, len(at), PACK_ROWS):
                    p = at[begin : begin + PACK_ROWS]
                    yield record_batch(_PACK, [group], [keys[p].astype("<i8").tobytes()], [ids[p].astype("<i8").tobytes()], [labels[p].astype("<i8").tobytes()], [x[p].tobytes()])

    return run


class _Kept:
    """The k best rows that a task has found so far for each window of a group's anchors."""

    def __init__(self, anchors: list[dict], dim: int, k: int) -> None:
        self.k, self.keys = k, np.array([a["key"] for a in anchors], np.int64)
        self.labels, self.x = np.array([a["label"] for a in anchors], np.int64), _matrix([a["vector"] for a in anchors], dim)
        most = max(len(a["windows"]) for a in anchors)
        none = {"window": -1, "low": 1, "high": 0}  # lets nothing in
        windows = [(sorted(a["windows"], key=lambda w: w["window"]) + [none] * most)[:most] for a in anchors]
        self.window, self.low, self.high = (np.array([[w[n] for w in ws] for ws in windows], np.int64) for n in ("window", "low", "high"))
        shape = (len(anchors), most, k)
        self.found = np.zeros(shape, bool)
        self.score, self.id, self.key = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, np.int64)

    def add(self, keys: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, same_label: bool) -> None:
        order = np.lexsort((keys, ids))
        keys, ids, labels = keys[order], ids[order], labels[order]
        every = scores(self.x, x[order])
        fit = (self.labels[:, None] == labels) == same_label
        if same_label:
            fit &= self.keys[:, None] != keys
        for w in range(self.window.shape[1]):
            ok = fit & (every >= self.low[:, w, None]) & (every <= self.high[:, w, None])
            at, valid = _best_places(every, ok, self.k)
            score, i, key = np.take_along_axis(every, at, 1), ids[at], keys[at]
            every_found = np.concatenate([self.found[:, w], valid], 1)
            parts = [np.concatenate([old[:, w], new], 1) for old, new in ((self.score, score), (self.id, i), (self.key, key))]
            order = np.lexsort((parts[2], parts[1], -parts[0], ~every_found))[:, : self.k]
            self.found[:, w] = np.take_along_axis(every_found, order, 1)
            self.score[:, w], self.id[:, w], self.key[:, w] = (np.take_along_axis(x, order, 1) for x in parts)

    def rows(self) -> list[np.ndarray]:
        a, w, k = np.nonzero(self.found)
        return [self.keys[a], self.window[a, w], self.score[a, w, k], self.id[a, w, k], self.key[a, w, k]]


def _best_places(every: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, whether they count) of the k highest scores of each line among those that are ok, of
    equals the first; in any order."""
    n = every.shape[1]
    bits = max(1, (n - 1).bit_length())
    if int(np.abs(every).max(initial=0)) < 1 << (61 - bits):  # score and place in one number
        whole = np.where(ok, (every << bits) | (n - 1 - np.arange(n)), np.iinfo(np.int64).min)
        at = np.argpartition(whole, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), every.shape)
    else:
        at = np.lexsort((np.broadcast_to(np.arange(n), every.shape), -every, ~ok))[:, :k]
    valid = np.take_along_axis(ok, at, 1)
    if at.shape[1] < k:
        more = k - at.shape[1]
        at, valid = np.pad(at, ((0, 0), (0, more))), np.pad(valid, ((0, 0), (0, more)))
    return at, valid


def _best(dim: int, same_label: bool, k: int):
    """The k best rows of each anchor's windows among the packs of its group, by score, id and key.

    Input: group, packed rows, and the anchors of the group as lists. What a task has found is
    kept for HELD_GROUPS groups, so that it tells k rows of a window as a rule."""

    def run(batches):
        kept: dict[int, _Kept] = {}

        def out():
            for one in kept.values():
                rows = one.rows()
                for at in range(0, len(rows[0]), 50_000):
                    yield record_batch(_BEST, *[c[at : at + 50_000] for c in rows])

        for batch in batches:
            for i, group in enumerate(batch.column(0).to_pylist()):
                if group not in kept:
                    if len(kept) >= HELD_GROUPS:
                        yield from out()
                        kept.clear()
                    kept[group] = _Kept(batch.column(5)[i].as_py(), dim, k)
                keys, ids, labels = (np.frombuffer(batch.column(c)[i].as_py(), "<i8") for c in (1, 2, 3))
                kept[group].add(keys, ids, labels, np.frombuffer(batch.column(4)[i].as_py(), "<i4").reshape(-1, dim), same_label)
        yield from out()

    return run


def _joined(rows: DataFrame, groups: DataFrame, described: DataFrame, space, dim: int, own_cell: bool, same_label: bool, k: int) -> DataFrame:
    """(anchor, window, score, id, key): the k best rows of each anchor's windows among the rows of
    the group's own cell, or among those of all others that may serve the group.

    groups: (group, anchors). A group's rows are dealt to several tasks where there are fewer groups."""
    spark = rows.sparkSession
    table = described.toArrow()  # MOST_GROUPS groups, and as many cells, at most; a row for each of their labels
    sent = spark.sparkContext.broadcast(Groups(table))
    packs = rows.select("_key", "_id", "_label", "_vector").mapInArrow(_sent(space, sent, own_cell), _PACK_DDL)
    salts = max(1, -(-partitions(spark) // max(1, len(set(table.column("group").to_pylist())))))
    packs = packs.withColumn("salt", F.pmod(F.xxhash64("keys"), F.lit(salts)))
    dealt = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    met = packs.join(dealt, ["group", "salt"]).select("group", "keys", "ids", "labels", "vectors", "anchors")
    return met.mapInArrow(_best(dim, same_label, k), _BEST_DDL)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best of each window, ranked; the tasks have left k rows each at most."""
    order = Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "id", "key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _described(grouped: DataFrame, by_label: bool) -> DataFrame:
    """A row for each group (and label): the scores that are of use to its anchors."""
    at = ["group", "cell", *(["label"] if by_label else [])]
    edge = [F.max("far").alias("reach"), F.min("square").alias("low_square"), F.max("square").alias("high_square"), F.min("low").alias("low"), F.max("high").alias("high")]
    out = grouped.groupBy(*at).agg(*edge)
    return out if by_label else out.withColumn("label", F.lit(None).cast("long"))


def _packed(grouped: DataFrame) -> DataFrame:
    """(group, anchors): a group has about GROUP_ANCHORS anchors."""
    one = grouped.groupBy("group", "key", "label", "vector").agg(F.collect_list(F.struct("window", "low", "high")).alias("windows"))
    return one.groupBy("group").agg(F.collect_list(F.struct("key", "label", "vector", "windows")).alias("anchors"))


_ANY = (-(2**62), 2**62)


def mine_hard_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, pivots: int | None = None) -> DataFrame:
    """For anchors and their positives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x becomes floor(scale * x); a score is the inner product. An anchor's positives are its
    `positives` best other rows with its label; the negatives of a pair are the `negatives` best rows
    of other labels with low * positive_score <= 100 * negative_score <= high * positive_score. Better is the
    higher score, then the smaller id, then the earlier of rows alike. `anchor` is a condition
    on the columns of vectors; pivots are by default a 256th of the anchors' number, 4 to 1,024.

    Rows with a null label or vector, or a component that is null or not finite, take no part.
    Components beyond 2 ** 28 in size count as that. A vector that is shorter than others is filled up with
    zeros. A null id sorts first and comes back as null; a null condition is no anchor. Rows that
    repeat an id each count as a row, also as an anchor. Pairs without negatives have no rows;
    nor has an empty table.
    """
    spark = vectors.sparkSession
    read = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), F.col(label_col).cast("long"), F.col(vector_col).cast("array<double>"), F.coalesce(anchor, F.lit(False)))
    read = read.toDF("_id", "_label", "_vector", "_anchor").mapInArrow(_integers(scale), _ROW.partition(", ")[2])
    rows = materialise(read.withColumn("_key", F.monotonically_increasing_id()).select("_key", "_id", "_label", "_vector", "_anchor", "_square"), "vectors")
    size = rows.agg(F.max(F.octet_length("_vector")), F.count_if("_anchor"), F.max("_square")).first()
    dim, n, norm = (size[0] or 0) // 4, size[1], size[2]
    pairs = "anchor long, positive long, rank int, negative long, positive_score long, negative_score long"
    if not n or not dim:
        none = spark.createDataFrame([], pairs)
        return none.toDF("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    some = rows.orderBy(F.xxhash64("_key")).select("_vector").limit(PIVOT_SAMPLE).toArrow().column(0).to_pylist()
    space = spark.sparkContext.broadcast(Space(chosen(_matrix(some, dim), pivots or min(MOST_PIVOTS, max(4, n // 256))), norm))
    anchors = rows.filter("_anchor").mapInArrow(_cells(space, 3, True), _ROW + ", cell long, far double")
    in_cell = anchors.groupBy("cell").agg(F.count("*").alias("cell_n"))
    part = F.pmod(F.xxhash64("_key"), F.ceil(F.col("cell_n") / max(GROUP_ANCHORS, n // MOST_GROUPS)))
    anchors = anchors.join(F.broadcast(in_cell), "cell").select((F.col("cell") * F.lit(1 << 32) + part).alias("group"), "cell", "far", F.col("_square").alias("square"), F.col("_key").alias("key"), F.col("_id").alias("id"), F.col("_label").alias("label"), F.col("_vector").alias("vector"))
    anchors = materialise(anchors, "anchors")

    def served(windows: DataFrame, same_label: bool, k: int, name: str) -> DataFrame:
        """The best k rows of each window (an anchor's row with window, low, high) over all rows."""
        own = materialise(_joined(rows, _packed(windows), _described(windows, same_label), space, dim, True, same_label, k), f"{name}-own", PACKED_BATCH)
        full = _first(own, k).groupBy("anchor", "window").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == k).select(F.col("anchor").alias("key"), "window", "least")
        narrow = windows.join(full, ["key", "window"], "left").withColumn("low", F.greatest("low", F.coalesce("least", "low"))).drop("least")
        narrow = materialise(narrow, f"{name}-windows")
        rest = materialise(_joined(rows, _packed(narrow), _described(narrow, same_label), space, dim, False, same_label, k), f"{name}-rest", PACKED_BATCH)
        return materialise(_first(own.unionByName(rest), k), name)

    whole = anchors.withColumns({"window": F.lit(0).cast("long"), "low": F.lit(_ANY[0]).cast("long"), "high": F.lit(_ANY[1]).cast("long")})
    best = served(whole, True, positives, "positives")
    wide = F.col("score").cast("decimal(20,0)")  # low <= 100 * score / positive score <= high, in whole numbers
    bounds = best.select(F.col("anchor").alias("key"), F.col("rank").cast("long").alias("window"), F.col("id").alias("positive"), F.col("score").alias("positive_score"), F.ceil(wide * low / 100).cast("long").alias("low"), F.floor(wide * high / 100).cast("long").alias("high"))
    windows = materialise(anchors.join(bounds.filter(F.col("low") <= F.col("high")), "key"), "negative-windows")
    found = served(windows.drop("positive", "positive_score"), False, negatives, "negatives")
    named = windows.select(F.col("key").alias("anchor"), "window", F.col("id").alias("anchor_id"), "positive", "positive_score")
    out = found.join(named, ["anchor", "window"])
    return out.select(*[F.when(F.col(c) != NULL_ID, F.col(c)).alias(n) for c, n in (("anchor_id", "anchor_id"), ("positive", "positive_id"))], F.col("rank").cast("int").alias("rank"), F.when(F.col("id") != NULL_ID, F.col("id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def chosen(sample: np.ndarray, n: int) -> np.ndarray:
    """Of the sample, n rows that lie far apart: each the farthest from those before."""
    x = np.unique(sample, axis=0).astype(np.float64)
    out, near = [0], None
    while len(out) < min(n, len(x)):
        d = ((x - x[out[-1]]) ** 2).sum(1)
        near = d if near is None else np.minimum(near, d)
        out.append(int(near.argmax()))
    return x[out]


def oracle_sql() -> str:
    """The contract's result from `embeddings`."""
    return """
WITH e AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           [floor(256 * x::DOUBLE) for x in embedding] AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, x.vec_id AS id, a.label = x.label AS same, list_inner_product(a.v, x.v)::BIGINT AS score
    FROM e a JOIN e x ON a.vec_id <> x.vec_id WHERE a.vec_id % 50 = 0
), p AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INT AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 3
"""
