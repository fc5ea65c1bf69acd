"""Hamming joins and greedy dedup against brute force."""

import collections
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditloom.operators import curation, similarity, vectors
from auditloom.plans import curation as queries
from auditloom.plans import similarity as similarity_queries


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def make(n, seed, flips=8):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(max(1, n // 6))]
    out = []
    for i in range(n):
        s = rng.choice(base)
        for _ in range(rng.randint(0, flips)):
            s ^= 1 << rng.randrange(64)
        out.append((i, s))
    return out


@pytest.mark.parametrize("limit", [0, 5, 6])
def test_pairs_match_brute_force(spark, limit):
    data = make(120, limit)
    df = spark.createDataFrame([(i, signed(s), i % 2) for i, s in data], "id long, sig long, w int")
    want = {(a, b, (x ^ y).bit_count()) for a, x in data for b, y in data if a < b and (x ^ y).bit_count() <= limit}
    got = similarity.near_pairs(df, df, "id", "sig", limit, self_join=True)
    assert {tuple(r) for r in got.collect()} == want
    sized = similarity.near_pairs(df, df, "id", "sig", limit, ["w"], self_join=True)
    assert {tuple(r) for r in sized.collect()} == {p for p in want if p[0] % 2 == p[1] % 2}


def random_table(spark, seed, n, fixed=0):
    """n signatures, the bits of `fixed` alike in a third of them, and the opposite in another third."""
    rng = random.Random(seed)
    base = [rng.getrandbits(64)] * 2
    base[1] ^= 2**64 - 1
    found = [(base[i % 3] & fixed) | (rng.getrandbits(64) & ~fixed) if i % 3 < 2 else rng.getrandbits(64) for i in range(n)]
    found += [s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 9))) for s in found[: n // 10]]
    return found, spark.createDataFrame([(i, signed(s)) for i, s in enumerate(found)], "id long, sig long")


def test_shared_band_values_are_cut_again(spark):
    """A third of the signatures share 20 places, another third have them reversed, so each place alone tells rows apart. Cut again they meet about as rarely as the others; no pair is lost."""
    fixed = sum(1 << p for p in (*range(0, 64, 4), 1, 5, 9, 13))  # every fourth place makes the first band
    found, df = random_table(spark, 5, 1500, fixed)
    cut = similarity.near_candidates(df, df, "sig", 8, hot=60).distinct().count()
    plain = similarity.near_candidates(df, df, "sig", 8, hot=10**9).distinct().count()
    n = len(set(found))
    assert cut < 0.02 * n * n < 0.2 * plain, (cut, plain)
    want = {(a, b) for a in set(found) for b in set(found) if (a ^ b).bit_count() <= 8}
    for hot in (60, 5, 0):
        near = similarity.near_candidates(df, df, "sig", 8, hot=hot).filter(similarity.hamming(F.col("_sa"), F.col("_sb")) <= 8).distinct().collect()
        assert {(r._sa % 2**64, r._sb % 2**64) for r in near} == want


def test_places_that_are_alike_are_dealt_out(spark):
    _, df = random_table(spark, 6, 300, fixed=0)
    flat = df.select("id", F.col("sig").bitwiseAND(F.lit((1 << 32) - 1)).alias("sig"))  # the upper half tells nothing
    places, n = similarity.balanced_bits(flat, "sig")
    assert sorted(places) == list(range(64)) and n == flat.count()
    assert all(6 <= sum(p < 32 for p in places[i : i + 16]) <= 10 for i in range(0, 64, 16))
    assert similarity.balanced_bits(df.limit(0), "sig")[1] == 0 == similarity.near_candidates(df.limit(0), df.limit(0), "sig", 4).count()


def test_candidates_at_limit_14(spark):
    """Few look-ups meet 6 % of all pairs of random signatures, many below 1 %; none within the limit is lost."""
    found, df = random_table(spark, 7, 300)
    n = len(set(found))
    want = {(a, b) for a in set(found) for b in set(found) if (a ^ b).bit_count() <= 14}
    for probes, share in ((500, 0.08), (25_000, 0.013)):
        met = similarity.near_candidates(df, df, "sig", 14, most_probes=probes).distinct().collect()
        assert len(met) - n < share * n * n
        assert want <= {(r._sa % 2**64, r._sb % 2**64) for r in met}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10**6))
def test_greedy_matches_sequential(spark, seed):
    data = make(60, seed, 4)
    kept = []
    for i, s in data:
        if all((s ^ data[k][1]).bit_count() > 5 for k in kept):
            kept.append(i)
    df = spark.createDataFrame([(i, signed(s)) for i, s in data], "id long, sig long")
    got = {r.id for r in similarity.greedy_keep(df, "id", "sig", 5).filter("kept").collect()}
    assert got == set(kept)


def test_top_k_is_stable_and_ties_count(spark):
    r = spark.createDataFrame([([0.5, 0.9, 0.9, 0.1],)], "s array<float>").select(vectors.top_k(F.col("s"), 3).alias("t"), vectors.argmax(F.col("s")).alias("a"), vectors.ties_at_top(F.col("s")).alias("n")).first()
    assert [x.idx for x in r.t] == [1, 2, 0] and r.a == 1 and r.n == 2


def test_softmax_only_if_needed(spark):
    df = spark.createDataFrame([([0.25, 0.75],), ([1.0, 3.0],), ([-1.0, 1.5],)], "s array<double>")
    got = [r.p for r in df.select(vectors.softmax_if_needed(F.col("s")).alias("p")).collect()]
    assert got[0] == [0.25, 0.75] and all(abs(sum(p) - 1) < 1e-9 for p in got)


@pytest.mark.parametrize("block_edges", [7, 100, 10**6])
def test_first_independent_set_by_blocks(spark, block_edges):
    rng = random.Random(block_edges)
    edges = sorted({tuple(sorted(rng.sample(range(200), 2))) for _ in range(400)})
    kept = {}
    for node in range(200):
        kept[node] = not any(kept[a] for a, b in edges if b == node)
    want = {b: kept[b] for _, b in edges}
    named = [(f"n{a:03d}", f"n{b:03d}") for a, b in edges]  # nodes of any type that has an order
    got = similarity.first_independent(spark.createDataFrame(named, "before string, node string"), block_edges).collect()
    assert {int(r.node[1:]): r.kept for r in got} == want and len(got) == len(want)


def test_a_chain_takes_as_many_rounds_as_tasks(spark, monkeypatch):
    """100,000 links in order, 5,000 to a task: the rule of one link a round would take 100,000."""
    rounds, stored = [], similarity.stored
    monkeypatch.setattr(similarity, "stored", lambda df, s: rounds.append(1) or stored(df, s))
    chain = spark.range(100_000).select(F.col("id").alias("before"), (F.col("id") + 1).alias("node"))
    assert similarity.first_independent(chain, 5000).filter(F.col("kept") == (F.col("node") % 2 == 0)).count() == 100_000
    assert (len(rounds) - 1) / 2 < 30


def test_no_neighbours_at_all(spark):
    assert similarity.first_independent(spark.createDataFrame([], "before long, node long")).count() == 0
    rows = spark.createDataFrame([(3, 0), (1, -1), (2, 0)], "id long, sig long")
    assert sorted(map(tuple, similarity.greedy_keep(rows, "id", "sig", 4).collect())) == [(1, True), (2, True), (3, False)]


def labelled(spark, n=400, seed=11):
    """Signatures with copies, near ones, nulls among them, and two labels or none."""
    rng = random.Random(seed)
    found = [(i, signed(rng.getrandbits(64)), i % 2) for i in range(n)]
    found += [(n + i, signed((s % 2**64) ^ (1 << rng.randrange(64)) if i % 2 else s % 2**64), i % 3 % 2) for i, (_, s, _) in enumerate(found[:40])]
    found += [(-1, None, 0), (-2, found[0][1], None), (-3, 0, 1), (-4, -1, 1), (-5, -(2**63), 0), (-6, -(2**63) + 1, 0)]
    return found, spark.createDataFrame(found, "id long, sig long, label int")


def near_of(left, right, limit, label=False):
    far = lambda x, y: ((x % 2**64) ^ (y % 2**64)).bit_count()
    return {(a, b, far(x, y)) for a, x, v in left for b, y, w in right if None not in (x, y) and far(x, y) <= limit and (not label or (v == w and v is not None))}


@pytest.mark.parametrize("size", [(32_768, 2048, 16), (37, 10, 3), (50, 50, 7)])
def test_blocks_at_limit_18_match_brute_force(spark, monkeypatch, size):
    """At 18 of 64 a third of all pairs meet in a band by chance: none goes through the bands."""
    monkeypatch.setattr(similarity, "near_candidates", lambda *a, **k: pytest.fail("joined by bands"))
    for name, value in zip(("BLOCK", "FULL", "SPREAD"), size):
        monkeypatch.setattr(similarity, name, value)
    data, df = labelled(spark)
    pairs = {(a, b, d) for a, b, d in near_of(data, data, 18) if a < b}
    got = [tuple(r) for r in similarity.near_pairs(df, df, "id", "sig", 18, self_join=True).collect()]
    assert set(got) == pairs and len(got) == len(pairs) > 60
    sized = [tuple(r) for r in similarity.near_pairs(df, df, "id", "sig", 18, ["label"], self_join=True).collect()]
    assert set(sized) == {p for p in near_of(data, data, 18, True) if p[0] < p[1]} and len(sized) == len(set(sized))


def test_blocks_yield_in_small_parts(monkeypatch):
    """A block whose pairs are all near is told piece by piece."""
    monkeypatch.setattr(similarity, "CELLS", (16, 512))
    a = list(range(1000))
    rows = similarity.pa.RecordBatch.from_pylist([{"_same": False, "_a": a, "_b": a}])
    parts = list(similarity._compared([rows], 18, False))
    assert sum(p.num_rows for p in parts) == 10**6 and max(p.num_rows for p in parts) < 60_000


def test_bands_where_they_make_few_rows(spark, monkeypatch):
    assert similarity.bands_are_cheaper(10**6, 10**12 // 2, 3) and not similarity.bands_are_cheaper(10**6, 10**12 // 2, 8)
    data, df = labelled(spark)
    want = {(a, b, d) for a, b, d in near_of(data, data, 3) if a < b}
    for parts in (10**9, 0):
        monkeypatch.setattr(similarity, "COMPARED", parts)
        assert {tuple(r) for r in similarity.near_pairs(df, df, "id", "sig", 3, self_join=True).collect()} == want


def test_rows_of_bands_are_not_broadcast(spark, tmp_path):
    """A small table makes some hundred rows a signature in the bands, which went to the driver and all executors."""
    random_table(spark, 12, 500)[1].write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    halves = t.filter("id % 2 = 0"), t.filter("id % 2 = 1")
    for met in (similarity.near_candidates(*halves, "sig", 8), similarity.near_signatures(*halves, "sig", 18)):
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_both_directions_of_a_pair_come_from_one_comparison(spark):
    """Across splits, the signatures were compared once for each direction."""
    data, df = labelled(spark)
    rows = df.filter("label is not null")
    groups = similarity.cross_split_groups(rows, "label", "sig", 18)
    assert groups._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    known = [x for x in data if x[1] is not None and x[2] is not None]
    copies = collections.Counter((s % 2**64, v) for _, s, v in known)
    want = {(a, v, n, b, w, m, (a ^ b).bit_count()) for (a, v), n in copies.items() for (b, w), m in copies.items() if v < w and (a ^ b).bit_count() <= 18}
    got = [(r.sig_a % 2**64, r.split_a, r.n_a, r.sig_b % 2**64, r.split_b, r.n_b, r.distance) for r in groups.collect()]
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("self_join", [True, False])
def test_signatures_are_computed_once(spark, self_join):
    """Each read of a side (counts, blocks, both ends of the pairs) computed its signatures anew."""
    _, df = labelled(spark)
    n, calls = df.count(), spark.sparkContext.accumulator(0)

    def counted(x):
        calls.add(1)
        return x

    rows = df.withColumn("sig", F.udf(counted, "long")("sig"))
    sides = (rows, rows) if self_join else (rows.filter("id % 2 = 0"), rows.filter("id % 2 <> 0"))
    assert similarity.near_pairs(*sides, "id", "sig", 18, self_join=self_join).count() > 20
    assert calls.value <= 2 * n, calls.value


def test_blocks_of_many_signatures_are_dealt_evenly(spark):
    """Two comparisons of large blocks a task: chance gave some tasks three times the mean."""
    n = 600_000
    k, parts = -(-n // similarity.BLOCK), -(-n * n // 2 // similarity.TASK)
    met = spark.range(k * k).selectExpr(f"cast(id div {k} as int) i", f"cast(id % {k} as int) j").filter("i <= j")
    loads = [r[1] for r in met.repartition(parts, "i", "j").groupBy(F.spark_partition_id()).count().collect()]
    assert max(loads) < 2 * sum(loads) / parts, (max(loads), sum(loads), parts)


def predicted(spark):
    """labelled() with a prediction and a vector each: predictions that are right, wrong or null; values that are null, lists of other lengths."""
    data, df = labelled(spark)
    right = F.when(F.col("id") % 4 == 0, F.col("label") + 1).when(F.col("id") % 7 > 0, F.col("label"))
    return data, df.withColumn("pred", right.cast("long"))


def blocks_of(monkeypatch, size):
    for name, value in zip(("BLOCK", "FULL", "SPREAD", "CELLS"), size):
        monkeypatch.setattr(similarity, name, value)


@pytest.mark.parametrize("size", [(8192, 2048, 16, (16, 8192)), (37, 10, 3, (2, 24)), (50, 50, 7, (1, 8))])
def test_summary_by_blocks_is_that_of_all_pairs(spark, monkeypatch, size):
    blocks_of(monkeypatch, size)
    _, df = predicted(spark)
    for rows in (df, df.withColumn("id", F.format_string("n%05d", F.col("id") + 10)), df.filter("id > 10000")):
        pairs = similarity.near_pairs(rows, rows, "id", "sig", 18, self_join=True)
        want = curation.pair_summary(pairs, rows.select("id", F.col("label").alias("truth"), "pred"))
        got = similarity.near_summary(rows, "id", "sig", "label", "pred", 18)
        assert got.dtypes == want.dtypes and got.first() == want.first()
    assert got.first().pairs == 0


def test_predictions_of_near_rows_take_no_row_for_a_pair(spark, tmp_path):
    """Near pairs were joined with their ids and predictions, and counted distinct in five copies: 4.5 million rows for 3,000 copies of a vector."""
    copies = spark.range(3000).select(F.col("id").alias("vec_id"), (F.col("id") % 3).cast("int").alias("label"), F.array_repeat(F.lit(1.0).cast("float"), 64).alias("embedding"))
    copies.write.parquet(str(tmp_path / "embeddings.parquet"))
    found = queries.neardup_predictions(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and "Expand" not in plan, plan  # of blocks with blocks
    r = found.first()
    assert (r.pairs, r.identical, r.rows_a, r.rows_b, r.closest, r.same_class) == (3000 * 2999 // 2, 3000 * 2999 // 2, 2999, 2999, 0, 3 * 1000 * 999 // 2)


@pytest.mark.parametrize("size", [(8192, 2048, 16, (16, 8192)), (37, 10, 3, (2, 24))])
def test_differences_by_blocks_are_those_of_joined_pairs(spark, monkeypatch, size):
    blocks_of(monkeypatch, size)
    _, df = labelled(spark)
    value = lambda i: F.when((F.col("id") % 31 != 5) | (i != 2), F.rand(3) * 9 - i).cast("float")
    rows = df.withColumn("vec", F.when(F.col("id") % 17 == 3, F.array(value(1), value(2))).when(F.col("id") % 19 != 4, F.array(*[value(i) for i in range(5)])))
    rows = rows.unionByName(rows.filter("id between 400 and 420").withColumn("id", F.col("id") + 1000)).localCheckpoint()
    a, b = (rows.select(F.col("id").alias(f"id_{s}"), F.col("vec").alias(f"v_{s}")) for s in "ab")
    for equal in ([], ["label"]):
        want = similarity.near_pairs(rows, rows, "id", "sig", 18, equal, self_join=True).join(a, "id_a").join(b, "id_b")
        want = want.select("id_a", "id_b", "distance", similarity.max_abs_diff(F.col("v_a"), F.col("v_b")).alias("most"), similarity.mean_abs_diff(F.col("v_a"), F.col("v_b")).alias("mean"))
        got = similarity.near_differences(rows, "id", "sig", "vec", 18, equal)
        assert got.dtypes == want.dtypes
        got, want = ({tuple(r)[:2]: tuple(r)[2:] for r in x.collect()} for x in (got, want))
        assert got == want and len(got) > 60 and {None} < {m for _, _, m in got.values()}


def test_pairs_of_copies_are_shared_among_tasks(spark, tmp_path, monkeypatch):
    """All pairs of 2,000 copies of a vector were made in one task."""
    copies = spark.range(2000).select(F.col("id").alias("vec_id"), F.lit(1).alias("label"), F.array_repeat(F.lit(1.0).cast("float"), 64).alias("embedding"))
    copies.write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(similarity, "FULL", 100)
    found = similarity_queries.mae_verdicts(spark, str(tmp_path))
    tasks = [r[1] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 2000 * 1999 // 2 and max(tasks) < 0.6 * sum(tasks), tasks
    assert found.select("mae", "verdict").distinct().collect() == [(0.0, "same")]


def test_copies_are_parted_before_their_pairs_are_made(spark, monkeypatch):
    """near_pairs() made all pairs of 1,500 copies in one task, whatever the tasks; now no part of 100 copies is joined with more than all others."""
    monkeypatch.setattr(similarity, "COPIES", 100)
    data, few = labelled(spark)
    rows = few.unionByName(spark.range(5000, 6500).select("id", F.lit(7).cast("long").alias("sig"), F.lit(1).alias("label"))).localCheckpoint()
    pairs = similarity.near_pairs(rows, rows, "id", "sig", 18, ["label"], self_join=True)
    copies = pairs.filter("id_a >= 5000 and id_b >= 5000")
    tasks = [r[1] for r in copies.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 1500 * 1499 // 2 == copies.distinct().count() and max(tasks) < 0.6 * sum(tasks), tasks
    more = [(i, 7, 1) for i in range(5000, 6500)]
    want = {p for p in near_of(data, data + more, 18, True) if p[0] < p[1]}
    got = [tuple(r) for r in pairs.filter("id_a < 5000").collect()]
    assert set(got) == want and len(got) == len(want)
    halves = rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")
    assert similarity.near_pairs(*halves, "id", "sig", 18).filter("id_a >= 5000 and id_b >= 5000").count() == 750 * 750
