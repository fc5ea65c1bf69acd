import hashlib
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditloom.llm.queries import tokenizer_path
from auditloom.llm.sentencepiece_bpe import PrefixTable, encode_decode, load_model

MODEL = tokenizer_path("piece_bpe_32k.model")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def table():
    return PrefixTable(load_model(MODEL))


def ids_of(table, text):
    found = [table.word(w) for w in table.words(text.replace("▁", " "))]
    return [int(i) for i in b"".join(f[0] for f in found).split()], "".join(f[2] for f in found)[1:]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(" ▁ab\n\tethéß😀0", max_size=60), st.text(" ", max_size=70)))
def test_ids_and_text_as_the_library(table, library, text):
    ids, decoded = ids_of(table, text)
    assert ids == library.encode(text)
    assert decoded == library.decode(library.encode(text))


def test_documents_as_the_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_decode(docs, MODEL).collect()}
    want = {}
    for r in docs.collect():
        ids = library.encode(r.text or "", add_eos=True)
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert got == want


def test_odd_rows_and_empty_table(docs_of, odd_rows, library):
    got = encode_decode(docs_of(odd_rows), MODEL, with_text=True).collect()
    assert sorted([(r.doc_id, r.ids, r.decoded) for r in got], key=repr) == sorted([(i, " ".join(map(str, ids := library.encode(t or "", add_eos=True))), library.decode(ids)) for i, t in odd_rows], key=repr)
    assert encode_decode(docs_of([]), MODEL).count() == 0
