import hashlib
from collections import defaultdict

import pytest

import numpy as np

from auditloom.llm import exact_dedup as module
from auditloom.llm.exact_dedup import ENTRY, exact_duplicates, merge_runs, sorted_run

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(-(2**63) if i is None else i)
    out = []
    for i, t in rows:
        text = (t or "").translate(LOWER)
        stays = (max if keep == "largest" else min)(groups[text])
        out.append((i, None if stays == -(2**63) else stays, len(groups[text]), (-(2**63) if i is None else i) == stays, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fan_in", [2, 8])
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_against_brute_force(docs_of, odd_rows, keep, fan_in):
    rows = odd_rows + [(100 + i, ["Same TEXT", "same text", "ÄÖ same", "äö same", f"own {i}"][i % 5]) for i in range(300)]
    got = exact_duplicates(docs_of(rows), keep=keep, fan_in=fan_in).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows, keep)


@pytest.mark.parametrize("fan_in", [2, 8, 64])
def test_many_partitions_merge_in_any_number_of_rounds(docs_of, fan_in):
    rows = [(i, f"text {i % 37}") for i in range(900)]
    got = exact_duplicates(docs_of(rows).repartition(23), keep="largest", fan_in=fan_in).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows, "largest")


def test_empty_table_and_wrong_arguments(docs_of):
    assert exact_duplicates(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        exact_duplicates(docs_of([]), keep="any")


@pytest.mark.parametrize("largest", [False, True])
def test_runs_merge_like_one_sort(largest):
    """Few values in each field, so that digests that differ only in a later quarter meet too."""
    rng = np.random.default_rng(3)
    every = np.zeros(4000, ENTRY)
    for k in ENTRY.names:
        every[k] = rng.integers(0, 2**40 if k == "keep" else 3, len(every))
    got = merge_runs([sorted_run(x, largest) for x in np.split(every, [10, 10, 700, 701, 3000])], largest)
    want = defaultdict(list)
    for e in every.tolist():
        want[e[:5]].append(e[5:])
    assert [(e[:5], e[5], e[6]) for e in got.tolist()] == [(k, (max if largest else min)(x for x, _ in v), sum(n for _, n in v)) for k, v in sorted(want.items())]


def test_ranges_and_runs_of_few_rows(docs_of, odd_rows, monkeypatch):
    monkeypatch.setattr(module, "RANGE_ROWS", 7)
    rows = odd_rows + [(100 + i, f"text {i % 50}") for i in range(200)]
    assert sorted([tuple(r) for r in exact_duplicates(docs_of(rows)).collect()], key=repr) == brute(rows, "smallest")
