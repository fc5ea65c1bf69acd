import itertools
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import auditloom.llm.quality as module
from auditloom.llm.common import byte_view
from auditloom.llm.quality import BLOCK_WORDS, BUCKETS, FORM, INSULTS, LABELLERS, Judged, Lexicon, classify, fit_labels, fit_scorer, keep_good, pattern_of, votes_of
from tests.llm.conftest import WORDS, prose

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def test_patterns_round_trip():
    votes = np.random.default_rng(1).integers(-1, 2, (50, len(LABELLERS)))
    assert (votes_of(pattern_of(votes)) == votes).all()


def test_em_finds_the_accuracies_that_votes_were_drawn_with():
    rng = np.random.default_rng(2)
    truth, right, speaks = rng.random(40_000) < 0.7, np.array([0.95, 0.9, 0.9, 0.85, 0.8, 0.9, 0.75, 0.95]), 0.8
    votes = np.where(rng.random((40_000, 8)) < right, 1, -1) * np.where(truth, 1, -1)[:, None] * (rng.random((40_000, 8)) < speaks)
    patterns, counts = np.unique(pattern_of(votes), return_counts=True)
    model = fit_labels(votes_of(patterns)[:, : len(FORM)], counts.astype(float))
    assert np.abs(np.array(list(model.accuracy().values())) - right).max() < 0.03 and abs(model.prior - 0.7) < 0.02
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.97


def test_scorer_learns_soft_targets():
    features = [(np.array([i % 2, 5]), np.array([0.5, 0.5])) for i in range(100)]
    weights = fit_scorer(features, np.array([0.9 if i % 2 else 0.1 for i in range(100)]))
    score = [1 / (1 + np.exp(-(weights[b] @ v + weights[-1]))) for b, v in features]
    assert max(score[::2]) < 0.3 and min(score[1::2]) > 0.7


def test_held_out_labels(spark):
    """The hand labels are used here only; training sees none of them."""
    got = classify(spark.read.parquet(f"{SF}/documents.parquet"))
    pairs = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("quality is not null").select("kept", "quality").collect()
    right = [r.kept == (r.quality == 1) for r in pairs]
    good = [r.kept for r in pairs if r.quality == 1]
    assert len(pairs) > 50 and np.mean(right) > 0.85 and np.mean(good) > 0.95


def test_keep_good_keeps_what_classify_keeps(docs_of, odd_rows):
    rows = odd_rows + [(500 + i, prose(i, 120)) for i in range(60)] + [(700 + i, "BUY NOW !!! $$$ | | " * 30) for i in range(20)]
    docs = docs_of(rows)
    judged, kept = classify(docs).collect(), keep_good(docs)
    assert len(judged) == len(rows) and kept.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in judged if r.kept) == sorted(repr(r.doc_id) for r in kept.collect())
    assert not any(r.kept for r in judged if r.doc_id and r.doc_id >= 700) and all(r.kept for r in judged if r.doc_id and 500 <= r.doc_id < 600)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, ""), (None, "")]])
def test_few_and_empty_rows(docs_of, rows):
    assert classify(docs_of(rows)).count() == len(rows)
    assert keep_good(docs_of(rows)).columns == docs_of(rows).columns


def plain_votes(text, insults):
    """The labellers' votes on one text, by plain reading of its bytes."""
    raw = text.encode()
    letters = [b for b in raw if chr(b).isascii() and chr(b).isalpha()]
    words = [w for w in re.split(rb"[ \t-\r]+", raw) if w]
    low, n = [w.lower() for w in words], len(words)
    share = lambda part, whole: part / max(whole, 1)
    upper = share(sum(65 <= b <= 90 for b in raw), len(letters))
    symbols = set(b"!#$%&*<=>\\^{|}~")
    odd = share(sum(w[0] in symbols or w[-1] in symbols for w in words), n)
    stutter = share(sum(a == b for a, b in zip(low, low[1:])), n)
    variety = share(sum(len(set(low[i : i + BLOCK_WORDS])) for i in range(0, n, BLOCK_WORDS)), n)
    bars = share(words.count(b"|"), n)
    letter = lambda b: b >= 128 or chr(b).isalpha()
    plain = share(sum(all(map(letter, w)) or (len(w) > 1 and w[-1] in b",.?:;" and all(map(letter, w[:-1]))) for w in words), n)
    lines = raw.lower().split(b"\n")
    distinct = len({x for x in lines if x})
    repeated = share(max(len(lines), distinct) - distinct, len(lines))
    terms = [w for w in re.split(rb"[^a-z0-9\x80-\xff]+", raw.lower()) if w]
    hits = sum(t in insults for t in terms)
    out = [
        (upper > 0.3, False), (odd > 0.1, False), (stutter > 0.15 and n >= 8, False), (variety < 0.3 and n >= 20, False), (bars > 0.08, False),
        (plain < 0.7, plain >= 0.9), (stutter > 0.15, stutter < 0.06 and variety > 0.5), (repeated > 0.5 and len(lines) >= 4, False),
    ]
    return [(-1 if bad else 1 if good else 0) if n >= 3 else 0 for bad, good in out] + [-1 if hits >= 2 and hits * 2000 >= len(terms) else 0, 0, 0]


def judged(texts):
    return Judged(*byte_view(pa.array(texts, pa.large_string())), Lexicon(np.zeros(0, np.uint64)))


def some_texts():
    rng = random.Random(4)
    out = ["", " ", "one two", "A B C d", "You IDIOT, you stupid moron!", "idiot " + "word " * 30, "scheiße und Abschaum", "x\n" * 9, "a\n\n\nb\nB", "| a | b | c |"]
    for i in range(200):
        words = [rng.choice([*WORDS, "STONE", "the,", "||", "|", "end!!", "é.", "12", "x1", "trash"]) for _ in range(rng.choice([2, 5, 19, 40, 600]))]
        out.append(" ".join(w if rng.random() > 0.2 else f"{w} {w}\n" for w in words[: rng.randrange(1, len(words) + 1)] * rng.choice([1, 1, 6])))
    return out


def test_votes_against_plain_reading():
    texts, insults = some_texts(), set(INSULTS.encode().split())
    assert judged(texts).votes.tolist() == [plain_votes(t, insults) for t in texts]


def test_scores_are_those_of_the_features_in_any_company():
    texts, weights = some_texts(), np.random.default_rng(5).normal(size=BUCKETS + 1)
    together = judged(texts)
    scores = together.scores(weights)
    assert np.allclose(scores, [weights[b] @ v + weights[-1] for b, v in together.features()])
    assert scores.tolist() == [judged([t]).scores(weights)[0] for t in texts]
    assert all(abs(v[b < BUCKETS - 3].sum() - (3 if t.split() else 0)) < 1e-9 for t, (b, v) in zip(texts, together.features()))


def test_one_round_of_em_against_loops():
    votes = np.array(list(itertools.product((-1, 0, 1), repeat=3)))
    counts = np.arange(1.0, 28)
    good = [0.05 if min(v) < 0 else 0.95 for v in votes.tolist()]
    chance = [[[(sum(c * (g if y else 1 - g) for v, g, c in zip(votes.tolist(), good, counts) if v[k] == x - 1) + 0.5) / (sum(c * (g if y else 1 - g) for g, c in zip(good, counts)) + 1.5) for x in range(3)] for k in range(3)] for y in range(2)]
    model = fit_labels(votes, counts, rounds=1)
    assert np.allclose(model.chance, chance) and model.prior == pytest.approx((sum(g * c for g, c in zip(good, counts)) + 1) / (counts.sum() + 2))
    for v, p in zip(votes.tolist(), model.posterior(votes)):
        like = [np.prod([chance[y][k][v[k] + 1] for k in range(3)]) * (model.prior if y else 1 - model.prior) for y in range(2)]
        assert p == pytest.approx(like[1] / sum(like))


def test_toxic_wording_of_held_out_rows(spark):
    """Labels of even ids teach the wording; the odd ones are judged."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = classify(docs, labelled=labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id").select("kept", "quality", "toxic").collect()
    toxic, clean = ([r.kept for r in got if (r.quality, r.toxic) == x] for x in ((1, 1), (1, 0)))
    assert len(toxic) > 15 and np.mean(toxic) < 0.5 and np.mean(clean) > 0.97


def test_an_empty_draw_takes_the_first_rows(docs_of, monkeypatch):
    monkeypatch.setattr(module, "_drawn", lambda share, *key: module.F.lit(False))
    assert classify(docs_of([(i, prose(i, 30)) for i in range(30)]), sample_rows=5).count() == 30


@pytest.mark.parametrize("ids", ["cast(null as long)", "7L", "id"])
def test_rows_alike_are_drawn_like_others(spark, monkeypatch, ids):
    """20,000 equal rows: about the sample's share of them is drawn, whatever text and id they have."""
    drawn, fit = [], module.fit_scorer
    monkeypatch.setattr(module, "fit_scorer", lambda features, labels: drawn.append(len(features)) or fit(features, labels))
    for text in (prose(1, 40), "A B C !!!", ""):
        rows = spark.range(20_000, numPartitions=3).selectExpr(f"{ids} as doc_id", f"'{text}' as text")
        rows = rows.unionByName(spark.createDataFrame([(50, "river stone"), (None, None)], "doc_id long, text string"))
        assert classify(rows, sample_rows=400).count() == 20_002
    assert all(250 < n < 600 for n in drawn)


def test_repeated_labels_do_not_thin_out_the_others(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{prose(i, 20)} {'zorgle' if i % 4 == 0 else ''}") for i in range(80)], "doc_id long, text string")
    labels = spark.range(80).selectExpr("id as doc_id", "cast(id % 4 = 0 as int) as toxic")
    many = labels.union(spark.range(5000).selectExpr("1L", "0"))
    assert len(module.toxic_terms(docs, many, labelled_rows=100)) == len(module.toxic_terms(docs, labels, labelled_rows=100)) > 0


def test_the_sample_is_bounded_whatever_the_share(spark):
    assert spark.range(200_000).filter(module._drawn(1e-3, "id")).count() in range(140, 260)
    assert spark.range(10).filter(module._drawn(1e-18, "id")).count() == 0


def test_toxic_terms_of_odd_labels(docs_of, odd_rows):
    labels = docs_of([(i, t) for i, t in odd_rows]).select("doc_id").selectExpr("doc_id", "cast(null as int) as toxic")
    assert len(module.toxic_terms(docs_of(odd_rows), labels)) == 0
    assert len(module.toxic_terms(docs_of(odd_rows), labels.selectExpr("doc_id", "1 as toxic"))) == 0
