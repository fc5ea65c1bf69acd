import hashlib
import random

import numpy as np
import pytest

import auditloom.llm.suffix_dedup as module
from auditloom.llm.suffix_dedup import expand, remove_repeats
from tests.llm.conftest import prose


def brute(rows, length):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], r[1] or "")):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, np.int64)
        for at in range(len(raw) - length + 1):
            window = raw[at : at + length]
            if window in seen:
                gone[at] += 1
                gone[at + length] -= 1
            seen.add(window)
        cover = np.cumsum(gone)[:-1] > 0 if len(raw) else np.zeros(0, bool)
        spans = int(cover[:1].sum() + (cover[1:] & ~cover[:-1]).sum())
        kept = bytes(b for b, c in zip(raw, cover.tolist()) if not c)
        out.append((doc, len(raw), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def check(docs_of, rows, length):
    got = remove_repeats(docs_of(rows), length=length).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows, length)


@pytest.mark.parametrize("length", [64, 100])
def test_against_brute_force(docs_of, length):
    rng = random.Random(length)
    passages = [prose(100 + k, rng.randrange(8, 60)) for k in range(12)] + ["é" * 90, "ab" * 150, "\n" * 130]
    rows = [(k, " ".join(rng.choice(passages)[rng.randrange(20) :] if rng.random() < 0.6 else prose(1000 + 7 * k + j, 12) for j in range(rng.randrange(6)))) for k in range(60)]
    check(docs_of, rows, length)


def test_self_overlap_is_removed_but_for_the_first_copy(docs_of):
    check(docs_of, [(1, "a" * 500), (2, "a" * 99), (3, "b" + "a" * 100), (4, "abc" * 200)], 100)


def test_a_passage_in_many_documents_with_own_surroundings(docs_of):
    passage = prose(5, 40)
    check(docs_of, [(k, f"{prose(k, 5, 9)} {passage} {prose(k + 500, 9, 9)}") for k in range(150)], 100)


@pytest.mark.parametrize("most", [300, 3000])
def test_strips_that_are_too_many_for_a_transform(docs_of, monkeypatch, most):
    """Passages with own surroundings on either side; the transforms take a few strips only."""
    monkeypatch.setattr(module, "TRANSFORM_BYTES", most)
    monkeypatch.setattr(module, "PART_BYTES", 2000)
    passage = prose(6, 25)
    rows = [(k, f"{prose(k, 5, 9)} {passage[k % 7 :]} {prose(k + 500, 9, 9)}") for k in range(80)]
    check(docs_of, rows + [(200 + k, f"{k % 3}" + passage[:130]) for k in range(40)] + [(300, "ab" * 200), (301, "ba" * 200)], 100)


def test_a_very_long_text(docs_of):
    rng = random.Random(8)
    text = prose(9, 30_000, 50)
    again = "".join(text[at : at + n] + prose(at, 3, 90) for at, n in ((rng.randrange(len(text) - 999), rng.randrange(60, 900)) for _ in range(200)))
    check(docs_of, [(1, text), (2, again), (3, text[5000:200_000])], 100)


def test_odd_rows_and_empty_table(docs_of, odd_rows):
    check(docs_of, [(i, t[:3000] if t else t) for i, t in odd_rows], 100)
    assert remove_repeats(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(docs_of([]), length=10)


def test_expansion_finds_all_repeated_windows():
    rng = np.random.default_rng(3)
    for _ in range(20):
        codes = np.concatenate([np.append(rng.integers(1, 4, rng.integers(5, 60)), 0) for _ in range(4)]).astype(np.uint8)
        places, group = expand(codes, 5)
        want = {}
        for i in range(len(codes) - 4):
            if (w := codes[i : i + 5]).all():
                want.setdefault(w.tobytes(), set()).add(i)
        got = {}
        for p, g in zip(places.tolist(), group.tolist()):
            got.setdefault(g, set()).add(p)
        assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)
