"""Texts of megabytes in one row, beside short ones, and rows that repeat in mass through the whole pipeline."""

import hashlib
import random
from collections import Counter

import pytest

import corpus_pipeline
from auditloom.llm.collocations import collocations
from auditloom.llm.exact_dedup import exact_duplicates
from auditloom.llm.language_id import identify_languages
from auditloom.llm.near_dedup import near_duplicates
from auditloom.llm.quality import classify
from auditloom.llm.queries import tokenizer_path
from auditloom.llm.sentencepiece_bpe import encode_decode
from auditloom.llm.token_counts import pretoken_counts, token_counts
from tests.llm.conftest import prose
from tests.llm.test_collocations import brute as phrases
from tests.llm.test_pipeline import prose as good, written
from tests.llm.test_suffix_dedup import brute as repeats, check as check_repeats

MODEL = tokenizer_path("piece_bpe_32k.model")


def distinct_words(n, seed=1):
    rng = random.Random(seed)
    return " ".join(f"{rng.getrandbits(40):x}" for _ in range(n))


def test_suffix_dedup_of_a_megabyte(docs_of, odd_rows):
    text = prose(11, 150_000, 900)
    check_repeats(docs_of, [(1, text), (2, text[300_000:700_000] + prose(12, 50)), (3, prose(13, 40) + text[-5000:]), *odd_rows], 100)
    assert len(text) > 1_000_000 and repeats([(1, "")], 100)


def test_token_counts_of_megabytes(docs_of):
    rows = [(1, distinct_words(600_000)), (2, "q" * 3_000_000 + " end"), (3, "short text")]
    assert len(rows[0][1]) > 5_000_000
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in token_counts(docs_of(rows), MODEL).collect()}
    for i, text in rows:
        each = pretoken_counts(docs_of([(i, text)]), MODEL).selectExpr("sum(n) n", "sum(n * n_tokens) t").first()
        assert got[i] == (each.n, each.t)
    assert got[1][0] == 600_000


def test_encoding_of_megabytes(docs_of):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL)
    text = distinct_words(150_000, 2)
    (r,) = encode_decode(docs_of([(1, text)]), MODEL).collect()
    ids = library.encode(text, add_eos=True)
    assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_near_copies_of_megabytes(docs_of):
    text = distinct_words(200_000, 3)
    rows = [(5, text), (6, text + " one word more"), (7, text[: len(text) // 2]), (8, "short")]
    got = {r.doc_id: (r.component_id, r.kept) for r in near_duplicates(docs_of(rows), k=5).collect()}
    assert got == {5: (5, True), 6: (5, False), 7: (7, True), 8: (8, True)}
    assert {r.doc_id: r.keep_id for r in exact_duplicates(docs_of([*rows, (9, text.upper())]), keep="largest").collect()} == {5: 9, 6: 6, 7: 7, 8: 8, 9: 9}


def test_quality_of_megabytes(docs_of):
    rows = [(i, good(i, 60)) for i in range(60)] + [(100 + i, "BUY NOW !!! $$$ | | " * 20) for i in range(10)]
    rows += [(200, good(900, 300_000)), (201, "BUY NOW !!! $$$ | | " * 200_000), (202, "x" * 3_000_000)]
    got = {r.doc_id: r.kept for r in classify(docs_of(rows)).collect()}
    assert got[200] and not got[201] and all(got[i] for i in range(60)) and not any(got[i] for i in range(100, 110))


def test_phrases_and_language_of_megabytes(spark):
    """Above 8 MB a text is read in slices."""
    text = f"{prose(21, 700_000, 300)}. {'w' * 2_000_000} {prose(22, 400_000, 300)}"
    assert len(text) > 9_000_000
    docs = spark.createDataFrame([(1, text, "xa"), (2, "stone river. stone river", "xa"), (3, "ungöl schöl " * 50, "xb")], "doc_id long, text string, lang string")
    got = sorted(map(tuple, collocations(docs, least=4000, most_words=2, first=50).drop("k", "cut").collect()))
    assert got == phrases([("xa", text), ("xa", "stone river. stone river"), ("xb", "ungöl schöl " * 50)], 4000, 50, 2)
    assert {r.doc_id: r.lang_pred for r in identify_languages(docs).collect()} == {1: "xa", 2: "xa", 3: "xb"}


def test_rows_alike_in_mass_through_the_pipeline(spark, tmp_path):
    """A third of the rows share a null id and text, a third one id and text, and the rest are distinct."""
    rows = [(None, good(1, 60))] * 1500 + [(7, good(2, 60))] * 1500 + [(100 + i, good(100 + i, 60)) for i in range(1500)]
    got = corpus_pipeline.run(spark, written(spark, tmp_path, rows, [(1, good(9000, 40))])).collect()
    counts = Counter(r.doc_id for r in got)
    assert counts[None] == counts[7] == 1 and max(counts.values()) == 1
    assert len(counts) > 1400  # the classifier may reject some
