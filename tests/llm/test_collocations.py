import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import auditloom.llm.collocations as module
from auditloom.llm.collocations import collocations
from tests.llm.conftest import prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n\v\f\r]", (text or "").translate(LOWER))]


def brute(docs, least, first, most=5):
    f, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            total[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    candidates = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    dropped = {(lang, w[i:j]) for (lang, w), a in candidates.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and f[lang, w[i:j]] <= a}
    out = []
    for lang in total:
        rows = []
        for (own, w), a in candidates.items():
            if own == lang and (lang, w) not in dropped:
                score, _, x, y = min((1000 * a * total[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
                rows.append((-score, -a, " ".join(w).encode(), x, y))
        for rank, (score, a, phrase, x, y) in enumerate(sorted(rows)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, x, y, total[lang], -score))
    return sorted(out)


def table(spark, docs):
    df = spark.createDataFrame([(i, lang, t, "x", "y") for i, (lang, t) in enumerate(docs)], "doc_id long, lang string, text string, key string, n string")
    return df.repartition(3)


@pytest.mark.parametrize("least,first,most", [(3, 2000, 5), (10, 7, 5), (2, 50, 3)])
def test_against_brute_force(spark, odd_rows, least, first, most):
    rng = random.Random(3)
    fixed = ["amber lantern meadow", "quiet river stone garden", "the Very same five words Here", "x, y. z", "ÄÖ äö Straße"]
    docs = [(rng.choice(["en", "de", None, "und"]), " ".join(rng.choice(fixed + [prose(k, 6)]) + rng.choice([" ", ". ", "\n", "\t", " ,", ": "]) for _ in range(rng.randrange(8)))) for k in range(120)]
    docs += [("en", t) for _, t in odd_rows[:-2]] + [("en", "a " * 500), ("fr", "...;;!"), ("", "amber lantern")]
    got = collocations(table(spark, docs), least=least, first=first, most_words=most).drop("k", "cut").collect()
    assert sorted(map(tuple, got)) == brute(docs, least, first, most)


def test_empty_table_and_nothing_frequent(spark):
    assert collocations(table(spark, [])).count() == 0
    assert collocations(table(spark, [("en", "one two three"), (None, None)])).count() == 0


def test_counts_beyond_64_bits_of_product(spark):
    """1000 * a * n and l * r are multiplied as decimals of 36 digits."""
    big = spark.createDataFrame([(10**13, 10**14, 10**13, 10**13)], "a long, n long, l long, r long")
    wide = big.selectExpr(*[f"cast({c} as decimal(15,0)) {c}" for c in "anlr"]).selectExpr("(a * n * cast(1000 as decimal(4,0))) div (l * r) s")
    assert wide.first().s == 10**4


class Sent:
    class value:  # noqa: N801
        @staticmethod
        def has(words):
            return np.ones(len(words), bool)


def streamed(texts, langs=None):
    batch = pa.RecordBatch.from_arrays([pa.array(langs or ["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    rows = []
    for b in module._encode(Sent)([batch]):
        rows += zip(b.column(0).to_pylist(), b.column(1).to_pylist())
    return rows


def counted(rows, k):
    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int32()), pa.array([y for _, y in rows])], names=["lead", "data"])
    out = Counter()
    for b in module._exact(k, Sent, Sent)([batch]):
        out.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
    return out


@pytest.mark.parametrize("text_bytes,row_words", [(64, 7), (1 << 20, 5), (200, 1000)])
def test_long_texts_and_rows_are_cut_without_loss(monkeypatch, text_bytes, row_words):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["amber", "stone", "river" * 30, "q"]) + rng.choice([" ", "  ", ". ", ",", "\n", "\t"]) for _ in range(n)) for n in (900, 3, 0, 40, 400)] + ["...", " "]
    whole = streamed(texts)
    monkeypatch.setattr(module, "TEXT_BYTES", text_bytes)
    monkeypatch.setattr(module, "ROW_WORDS", row_words)
    cut = streamed(texts)
    for k in range(1, 6):
        want = sum(max(0, len(w) - k + 1) for t in texts for w in pieces(t))
        assert counted(cut, k) == counted(whole, k)
        assert sum(counted(cut, k).values()) == want
