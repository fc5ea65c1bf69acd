"""Personal data in texts, and the terms near it that give it away."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import ALNUM, NULL_ID, byte_view, fixed, materialise, mix, pieces_of, placed_words, record_batch, with_id

KINDS = ("email", "ip", "card", "phone")
TERM = len(KINDS)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9][0-9.]{6,}")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain: the local part is the run of its characters right
    before an @, as far as the previous match lets it reach."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            free = match.end()
            out.append((start, free))
        else:
            free = max(free, at)  # an @ is in no local part
        at = text.find("@", max(at + 1, free))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    out = []
    for run in _DOTTED.finditer(text):
        for m in _IP.finditer(run[0]):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((run.start() + m.start(), run.start() + m.end()))
    return out


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37 and 16 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and passes_luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]


FINDERS = (emails, ips, cards, phones)


def _merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover together."""
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


_COUNT = pa.schema([("term", pa.int64()), ("n", pa.int64())])


# --------------------------------------------------------------------------- terms of whole texts

#: A term that more than one document in so many has is frequent. There are at most so many
#: times the distinct words of an average document of them, whatever the number of documents.
FREQUENT = 1000


def _base(text: str) -> list[tuple[int, int, int]]:
    return [(k, a, b) for k, find in enumerate(FINDERS) for a, b in find(text)]


def _entities(text: str, spans: list[tuple[int, int, int]]) -> list[int]:
    """The distinct protected entities that the spans stand for."""
    out = set()
    for k, a, b in spans:
        value = f"{k}:{text[a:b].lower()}" if k == 0 else f"{k}:{_NOT_DIGIT.sub('' if k > 1 else '.', text[a:b])}"
        out.add(int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True))
    return sorted(out)


def _whole_words(column: pa.Array, spans: list[list[tuple[int, int, int]]]) -> tuple[np.ndarray, ...]:
    """All words of some texts that overlap no base span: (text, term, start, end), in order;
    start and end count code points from the beginning of the text."""
    data, offsets = byte_view(column)
    hashes, firsts, starts, lengths = placed_words(data, offsets, ALNUM)
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))  # code points before each byte
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    start, end = points[starts], points[starts + lengths]
    free = np.ones(len(starts), bool)
    for i, own in enumerate(spans):
        if own:
            here, base = slice(firsts[i], firsts[i + 1]), points[offsets[i]]
            begins, ends = (base + np.array(x, np.int64) for x in _merged(own))
            at = np.searchsorted(begins, end[here], "left")  # stretches that begin before the word ends
            free[here] = (at == 0) | (ends[np.maximum(at, 1) - 1] <= start[here])
    text, start, end = text[free], start[free], end[free]
    base = points[offsets[:-1]][text]
    return text, mix(hashes[free]).view(np.int64), start - base, end - base


def _distinct(text: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (text, term) once, by text and term."""
    order = np.lexsort((term, text))
    text, term = text[order], term[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (term[1:] != term[:-1])
    return text[fresh], term[fresh]


class _Sums:
    """Counts of keys (structured or plain), folded as they come and given out in bounded parts."""

    def __init__(self, most: int = 2_000_000):
        self.held, self.size, self.most = [], 0, most

    def add(self, keys: np.ndarray):
        """Count the keys; yields what no longer fits."""
        self.held.append(np.unique(keys, return_counts=True))
        self.size += len(self.held[-1][0])
        if self.size > self.most * 3 // 2:
            self._fold()
            if self.size > self.most:
                yield from self.rest()

    def _fold(self):
        unique, at = np.unique(np.concatenate([k for k, _ in self.held]), return_inverse=True)
        self.held = [(unique, np.bincount(at, np.concatenate([n for _, n in self.held]), len(unique)).astype(np.int64))]
        self.size = len(unique)

    def rest(self):
        if self.held:
            self._fold()
            keys, counts = self.held[0]
            self.held, self.size = [], 0
            for i in range(0, len(keys), 50_000):
                yield keys[i : i + 50_000], counts[i : i + 50_000]


def _whole_counts(batches):
    """How many texts of the task have each term outside base spans."""
    sums = _Sums()
    for batch in pieces_of(batches, 0):
        text, term, *_ = _whole_words(batch.column(0), [_base(t) for t in batch.column(0).to_pylist()])
        for keys, counts in sums.add(_distinct(text, term)[1]):
            yield record_batch(_COUNT, keys, counts)
    for keys, counts in sums.rest():
        yield record_batch(_COUNT, keys, counts)


_WHOLE = pa.schema([("_row", pa.int64()), ("entities", pa.list_(pa.int64())), ("terms", pa.binary())])
_WHOLE_DDL = "_row long, entities array<bigint>, terms binary"


def _whole_scan(batches):
    """The entities and distinct terms of each text that has entities."""
    for batch in pieces_of(batches, 1):
        texts = batch.column(1).to_pylist()
        spans = [_base(t) for t in texts]
        terms = [b""] * len(texts)
        holding = [i for i, own in enumerate(spans) if own]
        if holding:
            text, term = _distinct(*_whole_words(batch.column(1).take(pa.array(holding)), [spans[i] for i in holding])[:2])
            cuts = np.searchsorted(text, np.arange(len(holding) + 1))
            for i, a, b in zip(holding, cuts[:-1], cuts[1:]):
                terms[i] = fixed(term[a:b])
        yield record_batch(_WHOLE, batch.column(0).take(pa.array(holding, pa.int64())), [_entities(texts[i], spans[i]) for i in holding], [terms[i] for i in holding])


_TOGETHER = np.dtype([("kin", "<i8"), ("df_e", "<i8"), ("term", "<i8")])
_TOGETHERS = pa.schema([("kin", pa.int64()), ("df_e", pa.int64()), ("term", pa.int64()), ("n", pa.int64())])


_MET = pa.schema([("term", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])


def _kin_of_terms(batches):
    """For each term of the task the least and the greatest df_e among the kins of its texts."""
    held, size = [], 0

    def folded():
        term, low, high = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(term, kind="stable")
        term, low, high = term[order], low[order], high[order]
        heads = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
        return term[heads], *(f.reduceat(x, heads) if len(heads) else x for f, x in ((np.minimum, low), (np.maximum, high)))

    def out(parts):
        for i in range(0, len(parts[0]), 50_000):
            yield record_batch(_MET, *[x[i : i + 50_000] for x in parts])

    for batch in batches:
        for kins, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            term, df = np.frombuffer(raw, np.int64), [k["df_e"] for k in kins]
            held.append((term, np.full(len(term), min(df)), np.full(len(term), max(df))))
            size += len(term)
            if size > 3_000_000:
                held = [folded()]
                size = len(held[0][0])
                if size > 2_000_000:
                    yield from out(held[0])
                    held, size = [], 0
    if held:
        yield from out(folded())


def _marked(terms: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the bit of each term is set in a table of _bits_of()."""
    at = terms.view(np.uint64)
    return (bits[(at >> np.uint64(46)).astype(np.int64)] >> ((at >> np.uint64(40)) & np.uint64(63)) & np.uint64(1)).astype(bool)


def _together(frequent, open_, n: int, alpha: float):
    """How many texts of the task have each kin of entities and each open term; input (kins, terms).

    PMI(t; e) >= IC(e) / alpha means df_te >= df_t * (df_e / n) ** (1 - 1 / alpha), and df_te is
    df_e at most: a frequent term whose df_t is above df_e * (n / df_e) ** (1 - 1 / alpha)
    can't disclose e and isn't counted with it."""

    def count(batches):
        often, df_often = frequent.value
        sums = _Sums(1_000_000)

        def out(parts):
            for keys, counts in parts:
                yield record_batch(_TOGETHERS, *[np.ascontiguousarray(keys[k]).astype(np.int64) for k in ("kin", "df_e", "term")], counts)

        for batch in batches:
            for kins, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                term = np.frombuffer(raw, np.int64)
                term = term[_marked(term, open_.value)]
                df = np.zeros(len(term), np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, term), len(often) - 1)
                    df = np.where(often[at] == term, df_often[at], 0)
                for kin in kins:
                    most = kin["df_e"] * (n / kin["df_e"]) ** (1 - 1 / alpha) * (1 + 1e-6)
                    part = np.zeros(int((df <= most).sum()), _TOGETHER)
                    part["kin"], part["df_e"], part["term"] = kin["kin"], kin["df_e"], term[df <= most]
                    yield from out(sums.add(part))
        yield from out(sums.rest())

    return count


_PLACES = pa.schema([("_a", pa.int64()), ("_b", pa.int64()), ("term", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _bits_of(terms: DataFrame) -> np.ndarray:
    """A table of 2 ** 24 bits, those set that terms fall on; as large whatever the terms."""
    word, bit = F.shiftrightunsigned("term", 46).alias("word"), F.expr("shiftleft(1L, cast(shiftrightunsigned(term, 40) & 63 as int))").alias("bit")
    found = terms.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2 ** 18 rows at most
    out = np.zeros(1 << 18, np.uint64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
    return out


def _places_of_terms(dull, telling):
    """The places outside base spans of all terms whose bit is set, but of frequent ones that
    disclose nothing."""

    def places(batches):
        for batch in pieces_of(batches, 2):
            text, term, start, end = _whole_words(batch.column(2), [_base(t) for t in batch.column(2).to_pylist()])
            keep = _marked(term, telling.value) & ~np.isin(term, dull.value)
            a, b = (batch.column(i).to_numpy()[text[keep]] for i in range(2))
            term, start, end = term[keep], start[keep], end[keep]
            for i in range(0, len(a), 100_000):
                yield record_batch(_PLACES, *[x[i : i + 100_000] for x in (a, b, term, start, end)])

    return places


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.xxhash64("_text").alias("_a"), F.xxhash64(F.lit(1), "_text").alias("_b"))


def _whole_texts(rows: DataFrame, alpha: float, support: int) -> DataFrame:
    """The places (_a, _b, start, end) of the terms that disclose, counted over whole texts.

    Places are found in a pass of their own, and a table that is read again may give its rows
    in another order; so they are tied to two hashes of the text, not to the row's number.

    Entities that stand in the same documents are kin: they have the same counts with every
    term and are counted as one, so that a text of very many addresses is not paired with its
    words once for each. An entity that every document has holds no information to give away.

    A term that is rare enough discloses the rarest entity of its documents by standing there
    once; and one that is frequent enough can't disclose any. Both are told from the least and the
    greatest document frequency of the entities that a term has met, and only the terms
    between are paired with the entities of their documents.
    """
    spark = rows.sparkSession
    n = max(1, rows.count())
    hashed = _hashed(rows)
    term_df = materialise(rows.select("_text").mapInArrow(_whole_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("df_t")), "terms")
    often = term_df.filter(F.col("df_t") * FREQUENT > n).toArrow()
    order = np.argsort(often.column(0).to_numpy())
    often_term, often_df = often.column(0).to_numpy()[order], often.column(1).to_numpy()[order]
    scanned = materialise(hashed.select("_row", "_text").mapInArrow(_whole_scan, _WHOLE_DDL), "private")
    held = scanned.select("_row", F.explode("entities").alias("entity"))
    mark = [F.bit_xor(F.xxhash64("_row", F.lit(i))).alias(f"x{i}") for i in range(2)]
    entity_df = held.groupBy("entity").agg(F.count("*").alias("df_e"), *mark).filter(F.col("df_e") < n)
    kin = entity_df.select("entity", F.struct(F.xxhash64("df_e", "x0", "x1").alias("kin"), "df_e").alias("k"))
    kins = held.join(kin, "entity").groupBy("_row").agg(F.collect_set("k").alias("kins"))
    paired = materialise(kins.join(scanned.select("_row", "terms"), "_row").select("kins", "terms"), "paired")
    frequent = spark.sparkContext.broadcast((often_term, often_df))

    def discloses(both: Column, df_e: Column) -> Column:
        pmi, information = F.log2(F.lit(float(n)) * both / (F.col("df_t") * df_e)), -F.log2(df_e / F.lit(float(n)))
        return pmi >= information / alpha - 1e-9

    met = paired.mapInArrow(_kin_of_terms, "term long, low long, high long").groupBy("term").agg(F.min("low").alias("low"), F.max("high").alias("high")).join(term_df, "term")
    at_once = discloses(F.lit(1), F.col("low")) if support <= 1 else F.lit(False)
    most = F.col("high") * F.pow(F.lit(float(n)) / F.col("high"), 1 - 1 / alpha) * (1 + 1e-6)
    met = materialise(met.select("term", at_once.alias("at_once"), (F.col("df_t") <= most).alias("open")), "met")
    open_ = spark.sparkContext.broadcast(_bits_of(met.filter("not at_once and open")))
    together = paired.mapInArrow(_together(frequent, open_, n, alpha), "kin long, df_e long, term long, n long").groupBy("kin", "df_e", "term").agg(F.sum("n").alias("df_te")).filter(F.col("df_te") >= support)
    counted = together.join(term_df, "term").filter(discloses(F.col("df_te"), F.col("df_e"))).select("term")
    telling = materialise(met.filter("at_once").select("term").unionByName(counted).distinct(), "telling")
    told = telling.join(term_df.filter(F.col("df_t") * FREQUENT > n), "term", "left_semi").toArrow().column(0).to_numpy()
    dull = spark.sparkContext.broadcast(np.setdiff1d(often_term, told))
    places = hashed.select("_a", "_b", "_text").mapInArrow(_places_of_terms(dull, spark.sparkContext.broadcast(_bits_of(telling))), "_a long, _b long, term long, start long, end long")
    return places.join(telling, "term", "left_semi").select("_a", "_b", "start", "end")


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 1.25, support: int = 1, with_text: bool = False) -> DataFrame:
    """For each row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, sanitised_sha256.

    Base spans are e-mail and IP addresses, card and telephone numbers. A piece of personal
    data is a protected entity e of the corpus. The terms of its documents are weighed by what
    they disclose: any word outside base spans is a term t, at any distance from e, and with document
    frequencies over all documents, PMI(t; e) = log2(n * df(t, e) / (df(t) * df(e))) is the share of
    e's information IC(e) = -log2(df(e) / n) that t gives away. Where PMI >= IC / alpha, and t
    and e are both in `support` documents or more, every occurrence of t outside base spans, in any
    document, is a span of kind `term`.

    sanitised_sha256 is a digest of the sanitised text, which with_text adds as `sanitised`: base spans replaced
    by their kinds, terms with digits generalised to [NUMBER], capitalised ones to [NAME], others
    removed; see sanitise().

    All documents are counted: term frequencies are summed in each task before the shuffle,
    entities and pairs on the map side. Offsets are in code points, the end exclusive.

    Null text: empty, no spans. A null doc_id stays null, rows that repeat a doc_id each count
    as a document and get a row, an empty table gives none.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"),
    )
    return _finished(rows, _whole_texts(rows, alpha, support), with_text)


def _finished(rows: DataFrame, places: DataFrame, with_text: bool) -> DataFrame:
    """The result for each row, from the places (_a, _b, start, end) of its text's terms. Only texts
    that have such terms are in the places; Spark knows how large they are before it joins."""
    terms = materialise(places.groupBy("_a", "_b").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("terms")), "terms")
    joined = _hashed(rows).select("_id", "_text", "_a", "_b").join(terms, ["_a", "_b"], "left").select("_id", "_text", "terms")
    fields = [("_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_term", pa.int64()), ("sanitised_sha256", pa.string())]
    schema = pa.schema(fields + [("sanitised", pa.string())] * with_text)

    def named(spans):
        return ",".join(f"{(*KINDS, 'term')[k]}:{a}:{b}" for k, a, b in spans)

    def finish(batches):
        for batch in pieces_of(batches, 1):
            columns: list[list] = [[] for _ in schema.names[1:]]
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                base = _base(text)
                every = base + [(TERM, t["start"], t["end"]) for t in found or []]
                clean = sanitise(text, every)
                values = [*[sum(k == i for k, _, _ in base) for i in range(TERM)], hashlib.sha256(named(base).encode()).hexdigest(), named(every), len(every) - len(base), hashlib.sha256(clean.encode()).hexdigest(), clean]
                for column, value in zip(columns, values):
                    column.append(value)
            yield record_batch(schema, batch.column(0), *columns)

    out = joined.mapInArrow(finish, "_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long, sanitised_sha256 string" + ", sanitised string" * with_text)
    return out.select(with_id(), *schema.names[1:])


def sanitise(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Replace spans (kind, start, end). Spans that overlap are replaced together, by the kind of
    the longest, so that nothing of any is left. Personal data become their kind, terms with
    digits [NUMBER], capitalised ones [NAME]; other terms go."""
    out, at, ordered = [], 0, sorted((a, b, k) for k, a, b in spans)
    for i, (start, end, kind) in enumerate(ordered):
        if start < at:
            continue
        longest, j = (end - start, -kind), i + 1
        while j < len(ordered) and ordered[j][0] < end:
            longest, end, j = max(longest, (ordered[j][1] - ordered[j][0], -ordered[j][2])), max(end, ordered[j][1]), j + 1
        out.append(text[at:start])
        kind, word = -longest[1], text[start:end]
        out.append(f"[{KINDS[kind].upper()}]" if kind < TERM else "[NUMBER]" if any(c.isdigit() for c in word) else "[NAME]" if word[0].isupper() else "")
        at = end
    return "".join([*out, text[at:]])
