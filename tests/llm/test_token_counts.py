import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import auditloom.llm.token_counts as module
from auditloom.llm.queries import tokenizer_path
from auditloom.llm.token_counts import SPACE, UNIT, PrefixTrie, pretoken_counts, pretokens, sliced, token_counts, unigram_scores
from tests.llm.conftest import prose

MODEL = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def scores():
    return unigram_scores(MODEL)


def best(word, scores):
    """Tokens of the best segmentation of one word, without any sharing: (-score, tokens) least."""
    unknown, table = min(scores.values(), default=0) - 10 * UNIT, [(0, 0)]
    for end in range(1, len(word) + 1):
        ways = [(table[s][0] - scores[word[s:end]], table[s][1] + 1) for s in range(end) if word[s:end] in scores]
        if word[end - 1] not in scores:
            ways.append((table[end - 1][0] - unknown, table[end - 1][1] + len(word[end - 1].encode())))
        table.append(min(ways))
    return table[-1][1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc😀", max_size=12), max_size=12), st.dictionaries(st.text("abc", min_size=1, max_size=4), st.integers(-9 * UNIT, -1), max_size=12))
def test_trie_against_single_words(words, scores):
    trie = PrefixTrie(scores)
    trie.insert(words[:5])
    trie.insert(words)
    assert {w: trie.terminal[w] for w in words} == {w: best(w, scores) for w in words}


@settings(max_examples=100, deadline=None)
@given(st.text("abc😀", min_size=201, max_size=400), st.dictionaries(st.text("abc", min_size=1, max_size=4), st.integers(-9 * UNIT, -1), max_size=12))
def test_long_words(word, scores):
    assert PrefixTrie(scores).counts([word, word[:9]])[word] == best(word, scores)


def test_a_shared_prefix_is_scored_once(scores):
    trie = PrefixTrie(scores)
    trie.insert(["abc", "abd"])
    assert len(trie.best) == 3  # "", "a", "ab"
    trie.insert(["ab", "abcd", "abce"])
    assert len(trie.best) == 4  # "abc"
    trie.insert(["x" * 100_000, "abcf"])
    assert len(trie.best) == 4


@pytest.mark.parametrize("words", [["x" * 1300, "x" * 1000, "x" * 1300 + "y"], [f"{i:05d}{prose(i, 3, 99)}" for i in range(3000)]])
def test_nodes_and_words_are_bounded(scores, monkeypatch, words):
    monkeypatch.setattr(module, "NODES", 900)
    monkeypatch.setattr(module, "WORDS", 2000)
    monkeypatch.setattr(module, "HELD", 64)
    trie, found = PrefixTrie(scores), {}
    for at in range(0, len(words), 500):
        found.update({w: trie.counts(words[at : at + 500])[w] for w in words[at : at + 500]})
        assert len(trie.best) <= 900 + 1 and len(trie.terminal) <= 2000
    assert found == {w: best(w, scores) for w in words}


@pytest.mark.parametrize("text", ["a  b\tc\u00a0d " * 50, "x" * 300, " " * 300, "", "word " * 100 + "y" * 500, "é\u2003" * 99])
def test_slices_have_the_words_of_the_whole(monkeypatch, text):
    monkeypatch.setattr(module, "SLICE", 37)
    assert [w for part in sliced(text) for w in pretokens(part)] == pretokens(text)


def test_against_brute_force(docs_of, odd_rows, scores):
    rows = odd_rows + [(200 + i, f"{prose(i, 60, 30)} {chr(0x4E00 + i)}ß\t😀x\n{prose(i, 5)}") for i in range(50)] + [(300, "x" * 3000), (301, "word " * 20_000)]
    want = sorted([(i, len((t or "").split()), sum(best(SPACE + w, scores) for w in (t or "").split()) if i != 301 else 20_000 * best(SPACE + "word", scores)) for i, t in rows], key=repr)
    assert sorted(map(tuple, token_counts(docs_of(rows), MODEL).collect()), key=repr) == want
    assert token_counts(docs_of([]), MODEL).count() == 0


def test_counts_of_pretokens_add_up(docs_of, scores):
    rows = [(i, prose(i, 40, 9)) for i in range(60)] + [(99, None)]
    got = pretoken_counts(docs_of(rows), MODEL).collect()
    assert {r.pretoken: r.n_tokens for r in got} == {r.pretoken: best(r.pretoken, scores) for r in got}
    assert sum(r.n * r.n_tokens for r in got) == sum(r.n_tokens for r in token_counts(docs_of(rows), MODEL).collect())
