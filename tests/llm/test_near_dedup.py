import random
import re
from collections import defaultdict

import pytest

from auditloom.llm.components import components
from auditloom.llm.near_dedup import BLOCK_NODES, near_duplicates
from tests.llm.conftest import prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, k, percent=80):
    sets = []
    for _, text in rows:
        words = re.findall("[^ \t-\r]+", (text or "").translate(LOWER))
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    ids = [-(2**63) if i is None else i for i, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y, key=lambda i: (ids[i], i))] = min(x, y, key=lambda i: (ids[i], i))
    least = defaultdict(lambda: 2**63)
    for i in range(len(rows)):
        least[find(i)] = min(least[find(i)], ids[i])
    return sorted([(rows[i][0], len(sets[i]), None if least[find(i)] == -(2**63) else least[find(i)]) for i in range(len(rows))], key=repr)


def check(docs_of, rows, k):
    got = near_duplicates(docs_of(rows), k=k).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=repr) == brute(rows, k)
    return got


def edited(text, share, rng):
    return " ".join(w if rng.random() > share else f"{w}{rng.randrange(90)}" for w in text.split())


@pytest.mark.parametrize("k,share", [(2, 0.03), (2, 0.07), (5, 0.02)])
def test_against_brute_force(docs_of, k, share):
    rng = random.Random(k)
    rows = [(k * 1000 + i, edited(prose(i % 25, 30 + 5 * (i % 25), 30), share * rng.random() * 2, rng)) for i in range(260)]
    got = check(docs_of, rows, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_many_texts_that_are_almost_similar(docs_of):
    """One base, edits around the threshold: a bucket has many components, and more nodes than a block."""
    rng = random.Random(9)
    base = prose(3, 80, 40)
    check(docs_of, [(i, edited(base, rng.choice([0.02, 0.04, 0.06, 0.08, 0.1]), rng)) for i in range(5 * BLOCK_NODES)], 2)


def test_chains_copies_and_a_shared_passage(docs_of):
    words = [f"w{i}" for i in range(300)]
    chain = [(i, " ".join(words[3 * i : 3 * i + 60])) for i in range(60)]
    copies = [(100 + i, "The same short text") for i in range(200)]
    passage = prose(8, 40, 20)
    shared = [(400 + i, f"{passage} {prose(i, 25, 50)}") for i in range(60)]
    check(docs_of, chain + copies + shared, 2)


def test_odd_rows_and_empty_table(docs_of, odd_rows):
    check(docs_of, odd_rows, 2)
    assert near_duplicates(docs_of([])).count() == 0


def test_a_repeated_id_keeps_one_row(docs_of):
    got = near_duplicates(docs_of([(1, "a b c d"), (1, "a b c d"), (2, "a b c d")]), k=2).collect()
    assert sorted(r.kept for r in got) == [False, False, True] and {r.component_id for r in got} == {1}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (205, 201)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(101)}, 200: 200, 201: 200, 205: 200}
