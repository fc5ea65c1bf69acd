import hashlib
import random
import re
import time
from collections import defaultdict

from pyspark.sql import functions as F

from auditloom.llm.secret_scan import scan_secrets
from tests.llm.conftest import prose

PATTERNS = (
    ("assign", r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: (m[2], len(m[2]) >= 6)),
    ("access", "AKIA[A-Z0-9]+", 0, lambda m: (m[0], len(m[0]) >= 20)),
    ("hex", "[0-9a-f]+", 0, lambda m: (m[0], len(m[0]) >= 24)),
    ("opaque", "[A-Za-z0-9+/_-]{20,}", 0, lambda m: (m[0], bool(re.search("[A-Za-z]", m[0]) and re.search("[0-9]", m[0])))),
)


def brute(rows, max_owners=2, max_repos=3):
    spans, owners, repos = [], defaultdict(set), defaultdict(set)
    for _, text, source, lang in rows:
        mine = []
        for k, (_, pattern, flags, judge) in enumerate(PATTERNS):
            for m in re.finditer(pattern, text or "", flags):
                value, ok = judge(m)
                if ok:
                    mine.append((m.start(), k, m.end(), value))
                    owners[value].add(source or "")
                    repos[value].add((source, lang))
        spans.append(sorted(mine))
    out = []
    for (doc, *_), mine in zip(rows, spans):
        example = [len(owners[v]) > max_owners or len(repos[v]) > max_repos for *_, v in mine]
        base = [s for s in mine if s[1] < 3]
        shown = [s for s, e in zip(mine, example) if s[1] < 3 or not e and not any(b[0] < s[2] and s[0] < b[2] for b in base)]
        text = [",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b, _ in x) for x in (base, shown)]
        out.append((doc, *[sum(s[1] == k for s in base) for k in range(3)], hashlib.sha256(text[0].encode()).hexdigest(), text[1], sum(s[1] == 3 for s in shown), example.count(False), example.count(True)))
    return sorted(out, key=repr)


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    got = scan_secrets(df.select("*", *[F.lit("x").alias(c) for c in ("_row", "_id", "_text", "owner", "repo", "found", "hash", "spans", "all")])).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    return got


def test_against_brute_force(spark):
    rng = random.Random(7)
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    shared = [f"token={some('abcXYZ019', 12)}", "AKIA" + some("ABC123", 16), some("0123456789abcdef", 32), some("abcXYZ0123+/", 40)]
    rows = []
    for i in range(300):
        own = [f'{rng.choice(["Password", "api_key", "APIKEY", "passwd", "secret"])}{rng.choice([": ", "=", " = ", chr(34) + ": " + chr(34)])}{some("abcXYZ019._-", rng.randrange(1, 20))}', "AKIA" + some("ABC123", rng.randrange(1, 30)), some("0123456789abcdef", rng.randrange(15, 45)), some("abcXYZ0123+/", rng.randrange(10, 60))]
        parts = [prose(i, 10), *rng.sample(own + shared, rng.randrange(5)), "é😀", prose(i + 900, 5), *rng.sample(own, 1)]
        rng.shuffle(parts)
        rows.append((i, rng.choice([" ", "\n", ",", ""]).join(parts), rng.choice(["a", "b", "c", "d", None]), rng.choice(["en", "de", None])))
    got = check(spark, rows)
    assert any(r.n_example for r in got) and any(r.n_opaque for r in got)


def test_odd_rows_and_empty_table(spark, odd_rows):
    long_ = "word " * 20_000
    check(spark, [(i, t, None if i is None else "a", "en") for i, t in odd_rows] + [(50, f"{long_}secret=abcdef {long_}AKIA{'A' * 40}", "a", None), (51, "password=" + "x" * 100_000, "b", None), (52, "token=token=abcdefg password=abc secret:  'hunter22'", "b", "en")])
    assert scan_secrets(spark.createDataFrame([], "doc_id long, text string, source string, lang string")).count() == 0


def test_words_of_megabytes_cost_no_more_than_their_length(spark):
    """A word of one class only, and one with its only digit at the end."""
    words = ["a" * 10_000_000, "Z" * 5_000_000, "q" * 5_000_000 + "7", "5" * 3_000_000]
    df = spark.createDataFrame([(i, f"{w} secret=abcdefg1", "a", "en") for i, w in enumerate(words)], "doc_id long, text string, source string, lang string")
    began = time.time()
    got = {r.doc_id: r.spans for r in scan_secrets(df).collect()}
    assert time.time() - began < 30
    at = [len(w) for w in words]
    assign = [f"assign:{n + 1}:{n + 16}" for n in at]
    assert got == {0: f"hex:0:{at[0]},{assign[0]}", 1: assign[1], 2: f"opaque:0:{at[2]},{assign[2]}", 3: f"hex:0:{at[3]},{assign[3]}"}


def test_opaque_strings_beside_very_many_base_spans(spark):
    """A text of 20,000 base spans and as many opaque strings, every second one across a base span."""
    words = [f"Abc{i:017d}/x" if i % 2 else f"token=Abc{i:017d}" for i in range(20_000)]
    df = spark.createDataFrame([(1, " ".join(words), "a", "en")], "doc_id long, text string, source string, lang string")
    got = scan_secrets(df).first()
    assert (got.n_assign, got.n_opaque) == (10_000, 10_000) and got.spans.count(",") == 19_999
