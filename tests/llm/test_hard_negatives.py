import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import auditloom.llm.hard_negatives as module
from auditloom.llm.hard_negatives import mine_hard_negatives, scores


def table(spark, rows):
    df = spark.createDataFrame([(i, v, x, "x", 0) for i, v, x in rows], "vec_id long, embedding array<double>, label int, key string, score int")
    return df.repartition(5)


def whole(v):
    return [max(-(2**28), min(2**28, math.floor(256.0 * x))) for x in v]


def brute(rows, every, positives=5, negatives=3, low=50, high=95):
    fit = [(i, whole(v), x) for i, v, x in rows if v is not None and x is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    first = lambda found: sorted(found, key=lambda f: (-f[0], f[1] is not None, f[1] or 0))
    for at, (a, va, xa) in enumerate(fit):
        if a is None or a % every:
            continue
        own = [(sum(p * q for p, q in zip(va, v)), i, x == xa) for j, (i, v, x) in enumerate(fit) if j != at]
        for ps, p, _ in first([o for o in own if o[2]])[:positives]:
            for rank, (ns, n, _) in enumerate(first([o for o in own if not o[2] and low * ps <= 100 * o[0] <= high * ps])[:negatives], 1):
                out.append((a, p, rank, n, ps, ns))
    return sorted(out, key=repr)


def mined(spark, rows, every, **more):
    return sorted(map(tuple, mine_hard_negatives(table(spark, rows), F.col("vec_id") % every == 0, **more).collect()), key=repr)


def clustered(seed, n, dim=6, centres=5, spread=0.1, labels=3):
    rng = random.Random(seed)
    at = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(centres)]
    return [(i, [c + rng.gauss(0, spread) for c in rng.choice(at)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("spread,pivots", [(0.05, None), (0.05, 9), (1.5, 3)])
def test_against_brute_force(spark, spread, pivots):
    rows = clustered(1, 400, spread=spread)
    assert mined(spark, rows, 10, pivots=pivots) == brute(rows, 10)


def test_groups_are_cut_and_packs_small(spark, monkeypatch):
    monkeypatch.setattr(module, "GROUP_ANCHORS", 4)
    rows = clustered(2, 300)
    assert mined(spark, rows, 3, positives=2, negatives=4, low=20, high=100) == brute(rows, 3, 2, 4, 20, 100)


def test_odd_rows(spark):
    rows = clustered(3, 60, dim=3)
    rows += [(100, None, 1), (110, [1.0, 2.0, 3.0], None), (120, [1.0, None, 2.0], 1), (130, [1.0, math.nan, 2.0], 1), (140, [math.inf, 1.0, 1.0], 1)]
    rows += [(None, [1.0, 1.0, 1.0], 1), (None, [1.0, 1.0, 1.0], 2), (150, [], 1), (160, [2.0], 2), (170, [1e300, -1e300, 5.0], 0), (170, [1e300, -1e300, 5.0], 0), (180, [9e5, 9e5, 9e5], 1)]
    rows += [(200, [0.5, 0.5, 0.5], 1)] * 40 + [(210, [0.5, 0.5, 0.5], 2)] * 40
    assert mined(spark, rows, 10) == brute(rows, 10)


def test_empty_tables(spark):
    assert mined(spark, [], 10) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 1)], 10) == []
    assert mined(spark, [(10, None, 1)], 10) == mined(spark, [(10, [], 1), (20, [], 2)], 10) == []


def test_scores_beyond_floating_point_are_exact():
    a, x = np.array([[2**28, 2**28 - 1, 1]]), np.array([[2**28 - 3, -(2**27), 5], [1, 1, 1]])
    assert scores(a, x).tolist() == [[sum(int(p) * int(q) for p, q in zip(a[0], r)) for r in x]]


def test_rows_that_can_serve_no_anchor_are_not_sent(spark):
    """Two far clusters; anchors lie in one. The other's rows stay out of all packs."""
    rng = random.Random(9)
    rows = [(i, [10 + rng.random() / 9, rng.random() / 9], i % 2) for i in range(200)] + [(1001 + 2 * i, [rng.random() / 9, 10.0], i % 2) for i in range(200)]
    near = np.array([whole(v) for _, v, _ in rows], "<i4")
    norm = float((near.astype(float) ** 2).sum(1).max())
    space = module.Space(near[[0, -1]].astype(float), norm)
    import pyarrow as pa

    reach = float(space.distances(near[:200], True)[:, 0].max())
    square = (near[:200].astype(float) ** 2).sum(1)
    lowest = int(scores(near[:200], near[:200]).min() // 2)
    groups = module.Groups(pa.table({"group": [0], "cell": [0], "reach": [reach], "low_square": [square.min()], "high_square": [square.max()], "label": pa.array([None], pa.int64()), "low": [lowest], "high": [2**62]}))
    batch = pa.RecordBatch.from_pydict({"_key": list(range(400)), "_id": [r[0] for r in rows], "_label": [r[2] for r in rows], "_vector": [v.tobytes() for v in near]})
    sent = lambda x: type("Sent", (), {"value": x})
    counted = [sum(len(b.column(1)[0].as_py()) // 8 for b in module._sent(sent(space), sent(groups), own)([batch])) for own in (True, False)]
    assert counted == [200, 0]
    assert mined(spark, rows, 10, pivots=2) == brute(rows, 10)
