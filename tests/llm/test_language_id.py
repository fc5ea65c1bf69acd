import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import auditloom.llm.language_id as module
from auditloom.llm.language_id import identify_languages, posterior

SOUNDS = {"xa": ["ka", "lo", "mi", "tu"], "xb": ["sch", "öl", "ung", "tu"], "xc": ["あい", "うえ", "か", "tu"]}


def say(lang, seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 4))).capitalize() for _ in range(n))


def table(spark, rows):
    df = spark.createDataFrame([(i, t, lang, "x", 1) for i, t, lang in rows], "doc_id long, text string, lang string, learnt string, n int")
    return df.repartition(3)


def symbols(text):
    out = [" "]
    for c in text:
        c = c.lower() if c.isalpha() else " "
        if c != " " or out[-1] != " ":
            out.append(c)
    return out[1:]


def grams(text):
    s = ["   "[0]] * 3 + symbols(text)
    return ["".join(s[i : i + 4]) for i in range(len(s) - 3)]


class Brute:
    """Interpolated Kneser-Ney from the definitions, one language."""

    def __init__(self, texts, alphabet):
        self.count = {4: Counter(g for t in texts for g in grams(t))}
        for m in (3, 2, 1):
            self.count[m] = Counter(g[1:] for g in self.count[m + 1])
        self.heads, self.types, self.d = {}, {}, {}
        for m, count in self.count.items():
            self.heads[m], self.types[m] = Counter(), Counter()
            for g, n in count.items():
                self.heads[m][g[:-1]] += n
                self.types[m][g[:-1]] += 1
            n1, n2 = (sum(n == k for n in count.values()) for k in (1, 2))
            self.d[m] = max(0.1, n1 / (n1 + 2 * n2)) if n1 and n2 else 0.5
        self.alphabet = alphabet

    def p(self, g):
        if not g:
            return 1 / (self.alphabet + 1)
        m, h = len(g), g[:-1]
        if not self.heads[m][h]:
            return self.p(g[1:])
        n, d = self.count[m][g], self.d[m]
        return max(n - d, 0) / self.heads[m][h] + d * self.types[m][h] / self.heads[m][h] * self.p(g[1:])

    def entropy(self, text):
        found = grams(text)
        return -sum(math.log2(self.p(g)) for g in found) / len(found)


def test_against_the_definitions(spark):
    rows = [(k, say(lang, 10 * k + j, 12), lang) for k in range(15) for j, lang in enumerate(SOUNDS)]
    learn = defaultdict(list)
    for k, t, lang in rows:
        if k % 4 != 2:
            learn[lang].append(t)
    alphabet = len({c for texts in learn.values() for t in texts for c in symbols(t)})
    brute = {lang: Brute(texts, alphabet) for lang, texts in learn.items()}
    got = identify_languages(table(spark, rows), learn=F.expr("doc_id % 4 != 2")).collect()
    want = []
    for k, t, _ in rows:
        e = sorted((b.entropy(t), lang) for lang, b in brute.items())
        want.append((k, k % 4 != 2, e[0][1], round(e[0][0], 3), round(e[1][0] - e[0][0], 3)))
    near = sorted((r.doc_id, r.learnt, r.lang_pred, r.cross_entropy, r.margin) for r in got)
    for a, b in zip(near, sorted(want), strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=2e-3)


def test_held_out_texts_get_their_language_and_a_calibrated_score(spark):
    rows = [(k, say(lang, 1000 * j + k, 1 + k % 9), lang) for k in range(300) for j, lang in enumerate(SOUNDS)]
    truth = Counter((i, lang) for i, _, lang in rows if i % 4 == 2)
    got = [r for r in identify_languages(table(spark, rows), learn=F.expr("doc_id % 4 != 2")).collect() if not r.learnt]
    right = sum((truth & Counter((r.doc_id, r.lang_pred) for r in got)).values())
    assert right / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.score for r in got) / len(got) == pytest.approx(right / len(got), abs=0.05)


def test_odd_rows_and_languages_not_learnt(spark, odd_rows):
    rows = [(k, say("xa", k, 9), "xa") for k in range(8)] + [(k, say("xb", k, 9), None if k % 2 else "xb") for k in range(8)]
    rows += [(i, t, "xa") for i, t in odd_rows] + [(50, "12 34 ... !", "xb"), (51, "\U00010400\U00010401 ́", "xa"), (52, "́", "xb"), (None, "ka lo", None)]
    got = identify_languages(table(spark, rows), learn=F.expr("doc_id % 7 != 2")).collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(map(repr, (i for i, _, _ in rows)))
    empty = {i for i, t, _ in rows if not any(c.isalpha() for c in t or "")}
    for r in got:
        assert r.lang_pred in ("xa", "xb", "und") and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (r.cross_entropy is None) == (r.margin is None)
    assert {r.doc_id for r in got if r.lang_pred == "und"} <= empty
    assert sum(r.lang_pred == "und" for r in got) == sum(not any(c.isalpha() for c in t or "") for _, t, _ in rows)


def test_empty_table_nothing_learnt_and_one_language(spark):
    assert identify_languages(table(spark, [])).count() == 0
    assert [(r.lang_pred, r.score) for r in identify_languages(table(spark, [(1, "abc", None)])).collect()] == [("und", 0.0)]
    assert [(r.lang_pred, r.score, r.margin) for r in identify_languages(table(spark, [(1, "abc", "q"), (2, "x", None)])).collect()] == [("q", 1.0, 0.0)] * 2


def test_repeated_rows_of_one_id(spark):
    """Rows alike are set aside together, and as one; the language is learnt all the same."""
    rows = [(7, "ka lo mi", "xa")] * 3000 + [(7, "sch öl", "xb")] * 3 + [(8, "ungöl", None)]
    got = identify_languages(table(spark, rows)).groupBy("doc_id", "lang_pred").count().collect()
    assert sorted(map(tuple, got)) == [(7, "xa", 3000), (7, "xb", 3), (8, "xb", 1)]


@pytest.mark.parametrize("size", [7, 64, 1001])
def test_long_texts_are_cut_without_loss(monkeypatch, size):
    text = say("xc", 5, 300) + "... \U00010400 12 " + say("xb", 6, 300)
    batch = pa.RecordBatch.from_arrays([pa.array(["q"]), pa.array([text])], names=["lang", "text"])
    whole = [(w, n) for _, w, _, _, _ in module._texts([batch], 1) for n in [len(w)]]
    monkeypatch.setattr(module, "TEXT_BYTES", size)
    cut = [w for _, w, _, _, _ in module._texts([batch], 1)]
    assert len(whole) == 1 and len(cut) > 2
    assert np.array_equal(np.concatenate(cut), whole[0][0]) and whole[0][1] == len(symbols(text.replace("\U00010400", "x")))


def test_places_are_bounded_and_the_frequent_win(spark):
    texts = spark.createDataFrame([("xa", say("xa", k, 30)) for k in range(20)] + [("xb", say("xb", k, 30)) for k in range(20)], "lang string, text string")
    assert len(module.train(texts, ["xa", "xb"], slots=50).keys) <= 50


def test_posterior_is_a_distribution_and_ties_take_the_first():
    p = posterior(np.array([[1.0, 1.0], [3.0, 1.0], [0.0, 9000.0]]), np.array([1.0, 5.0, 1e9]), 2.0, 0.5)
    assert p.sum(1) == pytest.approx([1, 1, 1]) and p[0].argmax() == 0
