import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

import auditloom.llm.decontaminate as module
from auditloom.llm.decontaminate import contamination
from tests.llm.conftest import prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def brute(docs, items, size):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= names
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def check(docs_of, docs, items, size=13):
    got = contamination(docs_of(docs), docs_of(items, "item_id"), size=size).drop("n_near").collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(docs, items, size)


@pytest.mark.parametrize("block", [500_000, 60])
def test_against_brute_force(docs_of, odd_rows, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK_WORDS", block)
    rng = random.Random(4)
    items = [(i, prose(i, n, 20)) for i, n in enumerate([3, 13, 14, 30, 1, 50])] + [(10, None), (11, "..."), (None, prose(77, 15, 20)), (2, prose(78, 20, 20)), (12, prose(3, 30, 20))]
    docs = odd_rows[:-2]
    for k in range(80):
        item = rng.choice(items)[1] or ""
        docs.append((100 + k, f"{prose(200 + k, rng.randrange(300), 40)} {item.upper()[rng.randrange(9):]}! {prose(900 + k, rng.randrange(20), 40)}"))
    check(docs_of, docs, items)


def test_short_vocabulary_has_many_partial_matches(docs_of):
    rng = random.Random(5)
    docs = [(k, " ".join(rng.choice("ab") for _ in range(60))) for k in range(40)]
    check(docs_of, docs, [(k, " ".join(rng.choice("ab") for _ in range(6))) for k in range(8)], size=4)


def test_proximity_matches_in_any_order(docs_of):
    item = "alpha beta gamma delta"
    got = {r.doc_id: (r.n_hit, r.n_near) for r in contamination(docs_of([(1, item), (2, "delta gamma and beta alpha"), (3, "alpha beta gamma " + "x " * 30 + "delta")]), docs_of([(1, item)], "item_id")).collect()}
    assert got == {1: (4, 1), 2: (0, 1), 3: (0, 0)}


def test_empty_tables(docs_of):
    assert contamination(docs_of([]), docs_of([(1, "a b")], "item_id")).count() == 0
    assert [r.contaminated for r in contamination(docs_of([(1, "a b")]), docs_of([], "item_id")).collect()] == [False]


def near_brute(docs, items, size, slop=5):
    """Items with a window whose words all stand within length + slop words of one of its rarest word."""
    texts = [words(t) for _, t in docs]
    times = Counter(w for t in texts for w in t)
    windows = defaultdict(set)
    for name, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add("" if name is None else str(name))
    out = []
    for (doc, _), t in zip(docs, texts):
        where, found = defaultdict(list), set()
        for i, w in enumerate(t):
            where[w].append(i)
        for window, names in windows.items():
            least = min(times[w] for w in window)
            for rare in {w for w in window if times[w] == least}:
                if any(all(any(abs(j - i) <= len(window) + slop for j in where[w]) for w in window) for i in where[rare]):
                    found |= names
        out.append((doc, len(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("postings,block", [(1 << 20, 250_000), (7, 40)])
def test_proximity_and_bounded_parts_against_brute_force(docs_of, odd_rows, monkeypatch, postings, block):
    """One word of each window is in few texts, so that its rarest word is plain."""
    monkeypatch.setattr(module, "POSTINGS", postings)
    monkeypatch.setattr(module, "BLOCK_WORDS", block)
    rng = random.Random(12)
    items = [(i, f"rare{i} {prose(i, 6)}") for i in range(8)] + [(3, f"rare3 {prose(50, 4)}"), (None, "rare0 stone")]
    docs = odd_rows[:-2] + [(100 + i, " ".join(rng.sample((prose(i, 30) + " " + items[i % 8][1]).split(), 37))) for i in range(40)]
    docs += [(200 + i, f"{prose(i, 9)} {items[i % 8][1]} {prose(i, 9)}") for i in range(16)]
    got = contamination(docs_of(docs), docs_of(items, "item_id"), size=7).collect()
    assert sorted([(r.doc_id, r.n_near) for r in got], key=repr) == near_brute(docs, items, 7)
    assert sorted([tuple(r)[:-1] for r in got], key=repr) == brute(docs, items, 7)


def test_a_text_of_two_words_meets_many_windows(docs_of, monkeypatch):
    monkeypatch.setattr(module, "POSTINGS", 1000)
    rng = random.Random(13)
    docs = [(1, " ".join(rng.choice("ab") for _ in range(5000)))]
    check(docs_of, docs, [(k, " ".join(rng.choice("ab") for _ in range(30))) for k in range(10)], size=6)
