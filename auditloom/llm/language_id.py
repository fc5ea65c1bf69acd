"""Language identification by character language models with interpolated Kneser-Ney smoothing.

Texts become symbols: lower-cased letters, with one space for whatever stands between them. The
learnt texts' windows of four symbols are counted by language, in each task first. From these
counts alone DataFrame aggregates derive all orders: the count of a shorter gram is the number
of distinct symbols before it. With the absolute discount D of a language and order,

    P(c | h) = max(count(hc) - D, 0) / count(h) + D * types(h) / count(h) * P(c | h less its first symbol)

and both parts of each gram go into arrays sorted by the hash of language and gram. The model is
bounded whatever the corpus: grams share SLOTS places, and of those that fall on one the most
frequent is kept, so rare ones back off. Texts get the language of least cross-entropy per symbol. A
softmax of the cross-entropies, whose two parameters are fitted on texts that were set aside from
counting, is the score, and below the score that a precision on these texts asks for a prediction
is marked as rejected.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import NULL_ID, byte_view, materialise, mix, pieces_of, record_batch, small_batches, with_id

_U = np.uint64
#: Symbols of a window, of 16 bits each.
ORDER = 4
#: Places that the grams of all languages share; languages that are learnt, the most frequent ones.
SLOTS, MOST_LANGS = 1 << 23, 1000
#: Texts set aside for calibration: at most about so many, and at most this share; of languages
#: with fewer distinct texts than the last number, none.
ASIDE_ROWS, ASIDE_SHARE, ASIDE_LEAST = 4000, 1 / 16, 64
#: Bytes of text that are looked at together; windows whose probabilities a worker remembers.
TEXT_BYTES, REMEMBERED = 4 << 20, 500_000


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(symbol of each code point below 65536, whether it is a letter)."""
    symbol, letter = np.full(1 << 16, 32, np.uint16), np.zeros(1 << 16, bool)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            symbol[i], letter[i] = ord(low) if len(low) == 1 else i, True
        elif unicodedata.category(c)[0] == "M":
            symbol[i] = i
    return symbol, letter


SYMBOL, LETTER = _tables()
PAD = np.full(ORDER - 1, 32, np.uint64)


def _code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets in them) of UTF-8 texts; bytes that are no UTF-8 are replaced."""
    raw = data.tobytes()
    try:
        text = raw.decode("utf-8")
        heads = np.append(0, np.cumsum((data & 0xC0) != 0x80, dtype=np.int64))
        return np.frombuffer(text.encode("utf-32-le"), np.uint32), heads[offsets]
    except UnicodeDecodeError:
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32), np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64))


def windows(data: np.ndarray, offsets: np.ndarray, before: np.ndarray = PAD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a window for each symbol, bounds of each text, whether it has a letter, the last symbols).

    The window holds the symbol and those before it; `before` are the symbols before each text."""
    points, bounds = _code_points(data, offsets)
    low = np.minimum(points, 65535)
    symbol, letter = SYMBOL[low], LETTER[low]
    far = np.flatnonzero(points > 65535)
    if len(far):  # letters beyond 16 bits share the private zone
        some, back = np.unique(points[far], return_inverse=True)
        yes = np.array([chr(p).isalpha() for p in some.tolist()])
        letter[far] = yes[back]
        symbol[far] = np.where(yes, 0xE000 + some % 0x1900, 32)[back]
    n = len(bounds) - 1
    last = np.append(np.uint16(32), symbol[:-1]) if len(symbol) else symbol
    filled = bounds[:-1][np.diff(bounds) > 0]
    last[filled] = before[-1]
    kept = (symbol != 32) | (last != 32)
    to = np.append(0, np.cumsum(kept))[bounds]
    every = np.full(int(to[-1]) + (ORDER - 1) * n, 32, np.uint64)
    begins = to[:-1] + (ORDER - 1) * np.arange(n)  # of the symbols before each text
    for i in range(ORDER - 1):
        every[begins + i] = before[i]
    place = np.arange(int(to[-1])) + (ORDER - 1) * (np.repeat(np.arange(n), np.diff(to)) + 1)
    every[place] = symbol[kept]
    out = every[place]
    for i in range(1, ORDER):
        out = out | every[place - i] << _U(16 * i)
    seen = np.append(0, np.cumsum(letter))[bounds]
    return out, to, seen[1:] > seen[:-1], every[-(ORDER - 1) :] if len(every) else before


def _texts(batches, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(rows, windows, bounds, has a letter, whether they go on); a long text comes in slices, as
    a batch of one row each time."""
    for batch in pieces_of(batches, column, TEXT_BYTES):
        data, offsets = byte_view(batch.column(column))
        if batch.num_rows > 1 or len(data) <= 2 * TEXT_BYTES:
            yield batch, *windows(data, offsets)[:3], False
            continue
        begin, before = 0, PAD
        while begin < len(data):
            end = min(begin + TEXT_BYTES, len(data))
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
            found = windows(data[begin:end], np.array([0, end - begin]), before)
            before = found[3]
            yield batch, *found[:3], begin > 0
            begin = end


def _count(batches):
    """(lang, window, count) of the texts that a task reads."""
    schema = pa.schema([("lang", pa.string()), ("g", pa.int64()), ("n", pa.int64())])
    held: dict[str, list] = {}
    size = 0

    def told(parts):
        grams, counts = np.concatenate([g for g, _ in parts]), np.concatenate([n for _, n in parts])
        some, back = np.unique(grams, return_inverse=True)
        return some, np.bincount(back, counts, len(some)).astype(np.int64)

    def out():
        for lang, parts in held.items():
            grams, counts = told(parts)
            for at in range(0, len(grams), 100_000):
                yield record_batch(schema, [lang] * len(grams[at : at + 100_000]), grams[at : at + 100_000].view(np.int64), counts[at : at + 100_000])

    for batch, found, bounds, _, _ in _texts(batches, 1):
        langs = np.array(batch.column(0).to_pylist(), object)
        for lang in set(langs.tolist()):
            own = found[np.repeat(langs == lang, np.diff(bounds))]
            held.setdefault(lang, []).append(np.unique(own, return_counts=True))
            size += len(held[lang][-1][0])
        if size > 2_000_000:
            held = {lang: [told(parts)] for lang, parts in held.items()}
            size = sum(len(p[0][0]) for p in held.values())
            if size > 1_000_000:
                yield from out()
                held, size = {}, 0
    yield from out()


class Models:
    """The models of all languages: keys sorted, with the discounted share of each gram (a)
    and, where it is a context, the weight of what lies below it (b; else negative)."""

    def __init__(self, langs: list[str], grams: pa.Table, floor: np.ndarray) -> None:
        """grams: lang (its number), m, g, a, b. floor: what each language gives any symbol."""
        self.langs, self.floor = langs, floor
        lang, m, g = (grams.column(c).to_numpy() for c in ("lang", "m", "g"))
        keys = np.zeros(len(g), np.uint64)
        for number in range(len(langs)):
            for order in range(1, ORDER + 1):
                own = np.flatnonzero((lang == number) & (m == order))
                keys[own] = self._keys(number, order, g[own].view(np.uint64))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.a = grams.column("a").to_numpy()[order].astype(np.float32)
        self.b = grams.column("b").to_numpy()[order].astype(np.float32)

    def _keys(self, number: int, order: int, grams: np.ndarray) -> np.ndarray:
        return mix(grams ^ _U(xxhash.xxh64_intdigest(f"{order} {self.langs[number]}".encode())))

    def _found(self, number: int, order: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a, b) of grams; 0 and -1 where the gram is unknown."""
        keys = self._keys(number, order, grams)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return np.where(known, self.a[at], 0).astype(np.float64), np.where(known, self.b[at], -1).astype(np.float64)

    def bits(self, found: np.ndarray) -> np.ndarray:
        """For each window and language, the bits that its last symbol costs after the others."""
        out = np.zeros((len(found), len(self.langs)), np.float32)
        for number in range(len(self.langs)):
            p = np.full(len(found), self.floor[number])
            for m in range(1, ORDER + 1):
                own = self._found(number, m, found & _U((1 << 16 * m) - 1))[0]
                if m == 1:
                    p = own + p
                    continue
                weight = self._found(number, m - 1, found >> _U(16) & _U((1 << 16 * (m - 1)) - 1))[1]
                p = np.where(weight >= 0, own + weight * p, p)  # an unknown context tells nothing
            out[:, number] = -np.log2(np.maximum(p, 1e-12))
        return out


class Scorer:
    """Bits of windows, remembered from batch to batch."""

    def __init__(self, models: Models) -> None:
        self.models, self.known, self.rows = models, np.zeros(0, np.uint64), np.zeros((0, len(models.langs)), np.float32)

    def totals(self, found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each text and language, the sum of bits."""
        some, back = np.unique(found, return_inverse=True)
        fresh = np.setdiff1d(some, self.known, assume_unique=True)
        if len(fresh):
            if len(self.known) + len(fresh) > REMEMBERED:
                self.known, self.rows, fresh = self.known[:0], self.rows[:0], some
            every, rows = np.concatenate([self.known, fresh]), np.concatenate([self.rows, self.models.bits(fresh)])
            order = np.argsort(every)
            self.known, self.rows = every[order], rows[order]
        at = np.searchsorted(self.known, some)[back]
        out = np.zeros((len(bounds) - 1, len(self.models.langs)))
        filled = np.flatnonzero(np.diff(bounds))
        if len(filled):
            for i in range(out.shape[1]):
                out[filled, i] = np.add.reduceat(self.rows[at, i].astype(np.float64), bounds[:-1][filled])
        return out


def cross_entropies(models: Models, batches, column: int = 1) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bits a symbol for each language, symbols, has a letter)."""
    scorer, part = Scorer(models), None
    for batch, found, bounds, letter, joined in _texts(batches, column):
        bits, n = scorer.totals(found, bounds), np.diff(bounds)
        if joined:  # the next slice of a long text
            part = (batch, part[1] + bits, part[2] + n, part[3] | letter)
            continue
        if part:
            yield part[0], part[1] / np.maximum(part[2], 1)[:, None], part[2], part[3]
        part = (batch, bits, n, letter)
    if part:
        yield part[0], part[1] / np.maximum(part[2], 1)[:, None], part[2], part[3]


def posterior(entropy: np.ndarray, n: np.ndarray, beta: float, gamma: float) -> np.ndarray:
    """Softmax over languages of -beta * n ** gamma * cross-entropy."""
    x = -beta * (np.maximum(n, 1.0) ** gamma)[:, None] * (entropy - entropy.min(1, keepdims=True))
    x = np.exp(np.maximum(x, -700))
    return x / x.sum(1, keepdims=True)


def calibrated(entropy: np.ndarray, n: np.ndarray, truth: np.ndarray, precision: float) -> tuple[float, float, float]:
    """(beta, gamma, least score of an accepted prediction) from texts whose language is known."""
    if not len(truth) or entropy.shape[1] < 2:
        return 4.0, 0.5, 0.0

    def loss(beta, gamma):
        return -np.log(np.maximum(posterior(entropy, n, beta, gamma)[np.arange(len(truth)), truth], 1e-9)).mean()

    _, beta, gamma = min((loss(b, g), b, g) for g in (0.0, 0.25, 0.5, 0.75, 1.0) for b in np.geomspace(0.05, 50, 25).tolist())
    p = posterior(entropy, n, beta, gamma)
    right, score = p.argmax(1) == truth, p.max(1)
    order = np.argsort(-score, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(share >= precision)
    return beta, gamma, float(score[order[good[-1]]]) if len(good) else 1.0


def train(texts: DataFrame, langs: list[str], slots: int = SLOTS) -> Models:
    """Models of the languages from rows (lang, text) without nulls."""
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)])[F.col("lang")].cast("int")
    counts = texts.select("lang", "text").mapInArrow(_count, "lang string, g long, n long").groupBy(number.alias("lang"), "g").agg(F.sum("n").alias("n"))
    orders = {ORDER: materialise(counts, "windows")}
    for m in range(ORDER - 1, 0, -1):
        orders[m] = orders[m + 1].groupBy("lang", F.col("g").bitwiseAND(F.lit((1 << 16 * m) - 1)).alias("g")).agg(F.count("*").alias("n"))
    parts, base = [], None
    for m, own in orders.items():
        context = F.shiftrightunsigned("g", 16)
        ones = own.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"))
        discount = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.greatest(F.lit(0.1), F.col("n1") / (F.col("n1") + 2 * F.col("n2")))).otherwise(0.5)
        ones = F.broadcast(ones.select("lang", discount.alias("d")))  # a row a language
        heads = own.groupBy("lang", context.alias("h")).agg(F.sum("n").alias("den"), F.count("*").alias("types"))
        shares = own.select("lang", "g", context.alias("h"), "n").join(heads, ["lang", "h"]).join(ones, "lang")
        parts.append(shares.select("lang", F.lit(m).alias("m"), "g", ((F.col("n") - F.col("d")) / F.col("den")).alias("a"), F.lit(-1.0).alias("b"), "n"))
        heads = heads.join(ones, "lang").select("lang", F.col("h").alias("g"), (F.col("d") * F.col("types") / F.col("den")).alias("b"), F.col("den").alias("n"))
        if m > 1:
            parts.append(heads.select("lang", F.lit(m - 1).alias("m"), "g", F.lit(0.0).alias("a"), "b", "n"))
        else:
            base = {r["lang"]: r["b"] for r in heads.collect()}  # a row a language
    grams = parts[0]
    for part in parts[1:]:
        grams = grams.unionByName(part)
    grams = grams.groupBy("lang", "m", "g").agg(F.max("a").alias("a"), F.max("b").alias("b"), F.max("n").alias("n"))
    slot = F.pmod(F.xxhash64("lang", "m", "g"), F.lit(slots))
    kept = grams.groupBy(slot.alias("slot")).agg(F.max_by(F.struct("lang", "m", "g", "a", "b"), F.struct("n", F.negate("m"), "lang", "g")).alias("x")).select("x.*")
    symbols = orders[1].agg(F.count_distinct("g")).first()[0]
    floor = np.array([base.get(i, 1.0) / (symbols + 1) for i in range(len(langs))])
    return Models(langs, kept.toArrow(), floor)  # SLOTS rows at most


def identify_languages(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", precision: float = 0.99) -> DataFrame:
    """For each row: doc_id, learnt, lang_pred, score, cross_entropy, margin, rejected.

    Models are learnt from all rows with a language and a text where `learn` is true (a condition on
    docs; by default everywhere). lang_pred is the language of least cross-entropy, of equals the first
    in order of names, and score its calibrated probability; cross_entropy are the bits a
    symbol, margin those that the next language needs more, and rejected says that the score is
    below what `precision` asks for. ASIDE_ROWS bounds the texts that calibrate these; they are not
    counted for the models.

    A text without a letter, or null, is `und` with score 0 and no cross-entropy; so is every
    text if nothing was learnt. Repeated rows count again, but are set aside as one; a null id stays
    null; an empty table gives no rows. The language column is read of learnt rows only. Texts
    of any length are read whole, in slices.
    """
    spark = docs.sparkSession
    learnt = F.coalesce(learn, F.lit(False)) if learn is not None else F.lit(True)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"), F.col(text_col).cast("string").alias("text"), F.when(learnt, F.col(lang_col).cast("string")).alias("lang"), learnt.alias("learnt"))
    some = rows.filter("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    found = some.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("texts")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()
    langs = sorted(r["lang"] for r in found)
    fields = [("_id", pa.int64()), ("learnt", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_())]
    if not langs:
        none = F.lit(None).cast("double")
        return rows.select(with_id(), "learnt", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), none.alias("cross_entropy"), none.alias("margin"), F.lit(True).alias("rejected"))
    share = min(ASIDE_SHARE, ASIDE_ROWS / sum(r["n"] for r in found))
    many = [r["lang"] for r in found if r["texts"] >= ASIDE_LEAST]
    aside = F.col("lang").isin(many) & (F.shiftrightunsigned(F.xxhash64("h"), 11) < F.lit(int(share * 2**53)))
    some = some.filter(F.col("lang").isin(langs))
    models = train(some.filter(~aside), langs)
    sent = spark.sparkContext.broadcast(models)  # SLOTS grams at most
    beta, gamma, least = _calibration(some.filter(aside).dropDuplicates(["h"]).limit(2 * ASIDE_ROWS), sent, precision)
    schema = pa.schema(fields)

    def predict(batches):
        for batch, entropy, n, letter in cross_entropies(sent.value, _filled(batches)):
            best = entropy.argmin(1)
            p = posterior(entropy, n, beta, gamma)[np.arange(len(best)), best]
            least_bits = entropy[np.arange(len(best)), best]
            margin = np.partition(entropy, 1, axis=1)[:, 1] - least_bits if entropy.shape[1] > 1 else np.zeros(len(best))
            names = [langs[i] if yes else "und" for i, yes in zip(best.tolist(), letter.tolist())]
            nothing = ~letter
            yield record_batch(schema, batch.column(0), batch.column(2), names, np.where(letter, p, 0.0), pa.array(least_bits, mask=nothing), pa.array(margin, mask=nothing), nothing | (p < least))

    out = rows.select("_id", "text", "learnt").mapInArrow(predict, "_id long, learnt boolean, lang_pred string, score double, cross_entropy double, margin double, rejected boolean")
    return out.select(with_id(), *[name for name, _ in fields[1:]])


def _filled(batches):
    """Batches with empty texts for null ones."""
    for batch in batches:
        yield batch.set_column(1, "text", batch.column(1).fill_null("")) if batch.column(1).null_count else batch


def _calibration(texts: DataFrame, sent: Broadcast, precision: float) -> tuple[float, float, float]:
    schema = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("bits", pa.list_(pa.float64()))])

    def run(batches):
        for batch, entropy, n, _ in cross_entropies(sent.value, batches):
            yield record_batch(schema, batch.column(0), n, pa.array(entropy.tolist(), pa.list_(pa.float64())))

    langs = sent.value.langs
    with small_batches(texts.sparkSession):
        got = texts.select("lang", "text").mapInArrow(run, "lang string, n long, bits array<double>").toArrow()  # ASIDE_ROWS rows
    got = got.sort_by([("lang", "ascending"), ("n", "ascending")])
    entropy = np.array(got.column("bits").to_pylist(), float).reshape(-1, len(langs))
    truth = np.array([langs.index(x) for x in got.column("lang").to_pylist()], int)
    return calibrated(entropy, got.column("n").to_numpy().astype(float), truth, precision)
