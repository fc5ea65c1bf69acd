import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditloom.llm.pii import FINDERS, KINDS, find_private, sanitise
from tests.llm.conftest import prose

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(digits):
    doubled = [int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def counts_as(kind, match):
    digits = "".join(c for c in match if c in "0123456789")
    if kind == 0:
        return True
    if kind == 1:
        return all(int(p) <= 255 for p in match.split("."))
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 8 <= len(digits) <= 15


def base(text):
    return [(k, *m.span()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if counts_as(k, m[0])]


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text("ab@.-_0 ", max_size=30), st.text("0125.+ -()", max_size=50), st.text("04 -", max_size=60), st.text(max_size=40)))
def test_base_spans(text):
    assert [(k, a, b) for k, find in enumerate(FINDERS) for a, b in find(text)] == base(text)


def card(rng):
    head = "".join(rng.choice("0123456789") for _ in range(15))
    return next(head + c for c in "0123456789" if luhn(head + c))


def test_base_columns_of_odd_rows(docs_of, odd_rows):
    got = find_private(docs_of(odd_rows)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()
    want = []
    for i, text in odd_rows:
        spans = base(text or "")
        joined = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
        want.append((i, *[sum(s[0] == k for s in spans) for k in range(4)], hashlib.sha256(joined.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("offset", [0, 50_000])
def test_very_long_text_and_sanitising(docs_of, offset):
    text = "é" * offset + " mail a@b.de now"
    (r,) = find_private(docs_of([(1, text)]), with_text=True).collect()
    at = offset + 6
    assert r.spans == f"email:{at}:{at + 6}" and r.sanitised == text.replace("a@b.de", "[EMAIL]")


def want_whole(rows, alpha=1.25, support=1):
    """Spans by plain counting over whole texts; any word outside base spans may be a term."""
    n, df_t, df_e, df_te, places = len(rows), Counter(), Counter(), Counter(), []
    for _, text in rows:
        text = text or ""
        spans = base(text)
        found = [(m[0].lower() if m[0].isascii() else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[0]), *m.span()) for m in re.finditer("[0-9A-Za-z\x80-\U0010ffff]+", text)]
        found = [(t, x, y) for t, x, y in found if not any(s < y and x < e for _, s, e in spans)]
        entities = {(k, text[a:b].lower() if k == 0 else re.sub("[^0-9.]" if k == 1 else "[^0-9]", "", text[a:b])) for k, a, b in spans}
        terms = {t for t, _, _ in found}
        df_t.update(terms)
        df_e.update(entities)
        df_te.update((e, t) for e in entities for t in terms)
        places.append((spans, found))
    telling = {t for (e, t), both in df_te.items() if both >= support and df_e[e] < n and math.log2(n * both / (df_t[t] * df_e[e])) >= -math.log2(df_e[e] / n) / alpha - 1e-9}
    out = []
    for (i, _), (spans, found) in zip(rows, places):
        rest = [f"term:{x}:{y}" for t, x, y in found if t in telling]
        out.append((i, ",".join([f"{KINDS[k]}:{a}:{b}" for k, a, b in spans] + rest), len(rest)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("many", [False, True])  # above 1000 documents some terms are not frequent
def test_terms_of_whole_texts(docs_of, odd_rows, many):
    rng = random.Random(4)
    owners = [(f"Zorblax{k}", f"z{k}.x@mail-{k}.example.org", card(rng), f"+49 (30) 55{k:05d}") for k in range(12)]
    rows = list(odd_rows)
    for i in range(2500 if many else 150):
        name, mail, number, phone = rng.choice(owners)
        given_ = rng.choice([f"{mail} é {prose(i, 40)} {name}", f"{name} {prose(i, 60)} {number} or {phone}", f"{name} again", f"v{i} of 10.0.0.{i % 9} and all@one.example.org", "nothing to see"])
        rows.append((100 + i, f"{prose(i, 5, 300)} {given_} {prose(i + 500, 3)}"))
    rows.append((9000, ". ".join(f"amber{i} u{i}@left{i}.example.org" for i in range(300))))
    far = f"Quibbleton {prose(5, 100)} only@here.example.org"
    rows += [(9001, far), (9002, f"so said QUIBBLETON {prose(6, 20)}")]
    got = {(r.doc_id, r.spans, r.n_term) for r in find_private(docs_of(rows)).collect()}
    assert got == set(want_whole(rows))
    spans = {i: s for i, s, _ in got}
    assert "term:0:10" in spans[9001] and spans[9002].startswith("term:8:18")
    assert find_private(docs_of([])).count() == 0
    (r,) = find_private(docs_of([(1, "mail a@b.de now")])).collect()
    assert r.n_term == 0


def test_a_text_of_very_many_addresses(docs_of):
    """5,000 addresses, each of another group of documents, and 3,000 words in one text: only words of middling
    frequency are paired with them."""
    rng = random.Random(6)
    mails = [f"u{i}@h{i}.example.org" for i in range(5000)]
    rows = [(1, ". ".join(f"w{rng.randrange(3000)} {m}" for m in mails))]
    rows += [(10 + i, f"{prose(i, 12, 40)} {mails[7 * i]} w{i % 900} {mails[7 * i + 1 + i % 5]}") for i in range(700)]
    began = time.time()
    got = {(r.doc_id, r.spans, r.n_term) for r in find_private(docs_of(rows)).collect()}
    assert time.time() - began < 60 and got == set(want_whole(rows))


@pytest.mark.parametrize("support,alpha", [(2, 1.25), (1, 1.0), (3, 2.0)])
def test_other_supports_and_thresholds(docs_of, support, alpha):
    rng = random.Random(support)
    rows = [(i, f"{prose(i, 15, 12)} {rng.choice(['a@b.de', 'c@d.fr', '10.0.0.1', ''])} {prose(i + 900, 15, 12)}") for i in range(120)]
    got = {(r.doc_id, r.spans, r.n_term) for r in find_private(docs_of(rows), support=support, alpha=alpha).collect()}
    assert got == set(want_whole(rows, alpha, support))


def test_overlapping_spans_leave_nothing():
    for text, want in [("at 192.168.10.12@corp.example.com now", "at [EMAIL] now"), ("+4930123456@ex.de", "[EMAIL]"), ("4111 1111 1111 1111 and a@b.cd", "[CARD] and [EMAIL]")]:
        assert sanitise(text, [(k, a, b) for k, find in enumerate(FINDERS) for a, b in find(text)]) == want
    assert sanitise("abcdef", [(4, 0, 2), (0, 1, 4), (1, 4, 5)]) == "[EMAIL][IP]f"


def test_the_digest_is_of_the_sanitised_text(docs_of, odd_rows):
    rows = odd_rows + [(100 + i, f"Anna{chr(97 + i % 26)}{chr(97 + i // 26)} wrote from a{i % 9}@ex.org and 192.168.{i}.1@corp.example.com, {prose(i, 30)}") for i in range(40)]
    got = find_private(docs_of(rows), with_text=True).collect()
    assert len(got) == len(rows)
    for r in got:
        assert hashlib.sha256(r.sanitised.encode()).hexdigest() == r.sanitised_sha256
        assert not any(find(r.sanitised) for find in FINDERS)
    assert sum("[NAME]" in r.sanitised for r in got) > 20
