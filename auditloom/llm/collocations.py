"""Phrase collocations by Apriori passes over levels of phrase lengths.

1. Words are counted by language; frequent ones make level 1.
2. Texts are rewritten once as a stream of word numbers, with a zero wherever a piece of text or
   a run of frequent words ends. A word's number is a 64-bit hash of word and language, so
   a stream may hold all languages.
3. Level k: a k-gram is emitted where both of its (k-1)-grams are frequent, as a hash with the
   count that its task found. Frequent hashes go into a table of bits, which is broadcast; its
   size follows from the number of words and has an upper bound. A bit that is set by chance
   lets a k-gram through that the exact counts, keyed by the word numbers, then drop.
4. Cuts are scored from the level tables, candidates inside an equally frequent longer one
   are dropped, and the best of each language are ranked in rounds of ever fewer groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditloom.llm.common import byte_view, materialise, mix, pieces_of, placed_words, record_batch, small_batches

_U = np.uint64
#: Bytes that end a piece of text, and bytes that end a word.
BREAKS = np.zeros(256, bool)
BREAKS[list(b".,;:!?\n\v\f\r")] = True
IN_WORD = ~BREAKS
IN_WORD[[32, 9]] = False
#: Bytes of text that are looked at together, and of a long text's slices.
TEXT_BYTES = 2 << 20
#: Words of a row of the stream; grams that a task holds before it emits their counts.
ROW_WORDS, HELD_GRAMS = 1000, 1_000_000
#: Words for each task of the exact counts: every task tells all the frequent grams that it has met.
TASK_WORDS = 10_000_000
#: Least and largest number of bits of a level's table (2 ** 30 bits are 128 MB).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30
#: Groups a language's candidates are ranked in, round by round.
RANK_GROUPS = (4096, 64, 1)

_WORDS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
_WORDS_DDL = "lang string, word string, n long"


def _slices(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(bytes, offsets, whether they go on with the text before) of a batch; one long text is cut
    before a byte that ends a word, so no word lies in two slices unless it alone is longer."""
    if len(offsets) > 2 or len(data) <= 2 * TEXT_BYTES:
        yield data, offsets, False
        return
    begin = 0
    while begin < len(data):
        end = begin + TEXT_BYTES
        while end < len(data):  # to the next byte that ends a word
            ends = np.flatnonzero(~IN_WORD[data[end : end + TEXT_BYTES]])
            if len(ends):
                end += int(ends[0])
                break
            end += TEXT_BYTES
        end = min(end, len(data))
        yield data[begin:end], np.array([0, end - begin], np.int64), begin > 0
        begin = end


def _read(batches, lang: int = 0, text: int = 1):
    """(language of each text, bytes, offsets, goes on, word hashes, first word of each text, starts, lengths)"""
    for batch in pieces_of(batches, text, TEXT_BYTES):
        langs = batch.column(lang).to_pylist()
        for data, offsets, joined in _slices(*byte_view(batch.column(text))):
            yield langs, data, offsets, joined, *placed_words(data, offsets, IN_WORD)


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _count_words(batches):
    """Each batch's distinct words by language, and with a null word how many words there are."""
    for langs, data, _, _, hashes, firsts, starts, lengths in _read(batches):
        names = sorted(set(langs))
        number = np.array([names.index(x) for x in langs], np.int64)
        each = np.repeat(number, np.diff(firsts))
        for i, name in enumerate(names):
            own = np.flatnonzero(each == i)
            _, first, counts = np.unique(hashes[own], return_index=True, return_counts=True)
            first = own[first]
            begin, size = starts[first], lengths[first]
            low = data.tobytes().translate(_LOWER)
            words = [low[a : a + n].decode("utf-8", "replace") for a, n in zip(begin.tolist(), size.tolist())]
            for at in range(0, len(words), 20_000):
                yield record_batch(_WORDS, [name] * len(words[at : at + 20_000]), words[at : at + 20_000], counts[at : at + 20_000])
            yield record_batch(_WORDS, [name], [None], [len(own)])


def _salt(lang: str) -> np.uint64:
    return _U(xxhash.xxh64_intdigest(lang.encode("utf-8", "replace")))


def _numbers(hashes: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """Word numbers, never 0, from the hashes of words and of their languages."""
    return np.maximum(mix(hashes ^ salts), _U(1))


def _number_words(batches):
    schema = pa.schema([*_WORDS, ("g", pa.int64()), ("key", pa.binary())])
    for batch in pieces_of(batches, 1, TEXT_BYTES):
        hashes, firsts, _, _ = placed_words(*byte_view(batch.column(1)), IN_WORD)
        number = _numbers(hashes[firsts[:-1]], np.array([int(_salt(x)) for x in batch.column(0).to_pylist()], np.uint64))
        yield record_batch(schema, *batch.columns, number.view(np.int64), [x.tobytes() for x in number])


class Bits:
    """A table of bits that frequent grams have set; as large as the number of words asks for,
    and never above MOST_BITS."""

    def __init__(self, frequent: DataFrame, words: int, least: int) -> None:
        """frequent has a column g; there are `words` // least of them at most."""
        size = LEAST_BITS
        while size < min(MOST_BITS, 32 * words // least):
            size *= 2
        place = F.col("g").bitwiseAND(F.lit(size - 1)) + 1
        found = frequent.select(F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).toArrow()
        self.mask, self.table, self.any = _U(size - 1), np.zeros(size // 8, np.uint8), found.num_rows > 0
        for b, m in zip(found.column(0).to_pylist(), found.column(1).to_pylist()):
            self.table[(b - 1) * 4096 : b * 4096] = np.frombuffer(m, np.uint8)

    def has(self, grams: np.ndarray) -> np.ndarray:
        place = (grams & self.mask).astype(np.int64)
        return (self.table[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def _encode(frequent: Broadcast):
    """Streams of word numbers in rows of ROW_WORDS; a row begins with `lead` words of the one before."""
    schema = pa.schema([("lead", pa.int32()), ("data", pa.binary())])

    def stream(batches) -> Iterator[np.ndarray]:
        pending = True  # whether a piece ends between the last word and the next
        for langs, data, offsets, joined, hashes, firsts, starts, _ in _read(batches):
            breaks = np.flatnonzero(BREAKS[data])
            if not len(hashes):
                pending = pending or not joined or len(breaks) > 0
                continue
            salts = np.repeat(np.array([int(_salt(x)) for x in langs], np.uint64), np.diff(firsts))
            word = _numbers(hashes, salts)
            before = np.searchsorted(breaks, starts)
            fresh = np.ones(len(word), bool)
            fresh[1:] = before[1:] != before[:-1]
            fresh[firsts[:-1][np.diff(firsts) > 0]] = True
            if joined:
                fresh[0] = pending or before[0] > 0
            pending = bool(len(breaks) and breaks[-1] > starts[-1])
            word[~frequent.value.has(word)] = 0
            out = np.zeros(len(word) + int(fresh.sum()), np.uint64)
            out[np.arange(len(word)) + np.cumsum(fresh)] = word
            yield out

    def run(batches):
        last, held, n, lead = np.zeros(1, np.uint64), [], 0, 0
        for part in stream(batches):
            part = np.concatenate([last[-1:], part])
            kept = part[1:][(part[1:] != 0) | (part[:-1] != 0)]  # of zeros in a row, one
            last = part
            held.append(kept)
            n += len(kept)
            if n >= 200 * ROW_WORDS:
                whole = np.concatenate(held)
                rows = (len(whole) - lead) // ROW_WORDS
                yield record_batch(schema, [lead] + [4] * (rows - 1), [whole[max(0, lead + i * ROW_WORDS - 4) if i else 0 : lead + (i + 1) * ROW_WORDS].tobytes() for i in range(rows)])
                end = lead + rows * ROW_WORDS
                held, lead = [whole[end - 4 :]], 4
                n = len(held[0])
        whole = np.concatenate([*held, np.zeros(0, np.uint64)])
        for at in range(lead, len(whole), ROW_WORDS):
            begin = max(0, at - 4)
            yield record_batch(schema, [at - begin], [whole[begin : at + ROW_WORDS].tobytes()])

    return run


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each place on; 0 where a zero is among them."""
    if k == 1:
        return words
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, whole = words[:n].copy(), words[:n] != 0
    with np.errstate(over="ignore"):
        for j in range(1, k):
            out = mix(out * _U(0x9FB21C651E98DF25) + words[j : j + n])
            whole &= words[j : j + n] != 0
    return np.where(whole, np.maximum(out, _U(1)), _U(0))


def _placed_grams(batches, k: int, known: Broadcast):
    """(grams of k words whose two parts of k - 1 words are known, the k words of each gram)."""
    for batch in pieces_of(batches, 1, TEXT_BYTES):
        data, offsets = byte_view(batch.column(1))
        leads = batch.column(0).to_numpy()
        words, bounds = np.frombuffer(data.tobytes(), np.uint64), offsets // 8
        gram = _grams(words, k)
        row = np.repeat(np.arange(len(leads)), np.diff(bounds))[: len(gram)]
        place = np.arange(len(gram)) - bounds[:-1][row]
        # whole in its row, ending behind the words that the row before has told
        at = np.flatnonzero((gram != 0) & (place + k <= np.diff(bounds)[row]) & (place + k > leads[row]))
        if k > 2:
            part = _grams(words, k - 1)
            at = at[known.value.has(part[at])]
            at = at[known.value.has(part[at + 1])]
        yield gram[at], at, words


def _hashed(k: int, known: Broadcast):
    """(hash, count) of the k-grams with frequent parts."""
    schema = pa.schema([("g", pa.int64()), ("n", pa.int64())])

    def told(held):
        grams, counts = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
        order = np.argsort(grams, kind="stable")
        grams, counts = grams[order], counts[order]
        heads = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
        return grams[heads], np.add.reduceat(counts, heads) if len(heads) else counts

    def run(batches):
        held, n = [], 0

        def out():
            grams, counts = told(held)
            for at in range(0, len(grams), 200_000):
                yield record_batch(schema, grams[at : at + 200_000].view(np.int64), counts[at : at + 200_000])

        for gram, _, _ in _placed_grams(batches, k, known):
            held.append(np.unique(gram, return_counts=True))
            n += len(held[-1][0])
            if n >= HELD_GRAMS:
                held = [told(held)]
                n = len(held[0][0])
                if 2 * n >= HELD_GRAMS:
                    yield from out()
                    held, n = [], 0
        if held:
            yield from out()

    return run


def _exact(k: int, known: Broadcast, frequent: Broadcast):
    """(word numbers, count) of the k-grams that are frequent by their hash."""
    schema = pa.schema([("key", pa.binary()), ("n", pa.int64())])

    def run(batches):
        held: dict[bytes, int] = {}
        for gram, at, words in _placed_grams(batches, k, known):
            own = frequent.value.has(gram)
            gram, at = gram[own], at[own]
            order = np.argsort(gram, kind="stable")
            every = words[at[order][:, None] + np.arange(k)]
            heads = np.flatnonzero(np.append(True, (every[1:] != every[:-1]).any(1))) if len(every) else np.zeros(0, np.int64)
            counts = np.diff(np.append(heads, len(every)))
            for key, n in zip(every[heads], counts.tolist()):
                held[b] = held.get(b := key.tobytes(), 0) + n
            if len(held) * k >= HELD_GRAMS:
                yield record_batch(schema, list(held.keys()), list(held.values()))
                held = {}
        if held:
            keys, counts = list(held.keys()), list(held.values())
            for i in range(0, len(keys), 50_000):
                yield record_batch(schema, keys[i : i + 50_000], counts[i : i + 50_000])

    return run


def phrase_levels(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most_words: int = 5, least: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, levels, totals): frequent words (lang, word, n, key); all frequent phrases of 1 to
    most_words words (key, k, n), the key being the word numbers; (lang, total) occurrences."""
    spark = docs.sparkSession
    if not 1 <= most_words <= 5:
        raise ValueError("phrases have 1 to 5 words: rows of the stream share four words")
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("_lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    counted = rows.mapInArrow(_count_words, _WORDS_DDL).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = materialise(counted.filter(F.col("word").isNull() | (F.col("n") >= least)), "words")
    totals = counted.filter("word is null").select("lang", F.col("n").alias("total"))
    every = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    words = materialise(counted.filter("word is not null").mapInArrow(_number_words, _WORDS_DDL + ", g long, key binary"), "numbered")
    known = spark.sparkContext.broadcast(Bits(words, every, least))
    levels = [words.select("key", F.lit(1).alias("k"), "n")]
    if known.value.any:
        stream = materialise(rows.mapInArrow(_encode(known), "lead int, data binary"), "stream")
        for k in range(2, most_words + 1):
            hashed = stream.mapInArrow(_hashed(k, known), "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
            with small_batches(spark):
                frequent = spark.sparkContext.broadcast(Bits(hashed, every, least))
            if not frequent.value.any:
                break
            few = stream.coalesce(max(spark.sparkContext.defaultParallelism, every // TASK_WORDS))
            exact = few.mapInArrow(_exact(k, known, frequent), "key binary, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
            levels.append(materialise(exact.select("key", F.lit(k).alias("k"), "n"), f"level-{k}"))
            known = frequent
    return words, reduce(DataFrame.unionByName, levels), totals


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most_words: int = 5, least: int = 100, first: int = 2000) -> DataFrame:
    """The best collocations of each language: lang, rank, phrase, a, l, r, n, score, k, cut.

    A candidate is a phrase of 2 to most_words words that occurs `least` times or more within
    pieces of text; a is its count, n the language's words. Its score is the least of
    floor(1000 * a * n / (l * r)) over its cuts into a first part, of count l, and a rest, of
    count r; the first cut with that score is told. A candidate goes if a candidate that is a
    word longer contains it and is as frequent; such a chain leads to any longer one. Of the
    others the `first` of each language by score, count and phrase stay.

    A-Z is lower-cased. Null text: empty. Null language: `und`, with the texts of that name.
    Ties end with the phrase in byte order, so ranks don't repeat. Repeated rows count again;
    an empty table, or one without frequent phrases, gives no rows. Further columns are not read.
    """
    words, levels, totals = phrase_levels(docs, lang_col, text_col, most_words, least)
    candidates = levels.filter("k > 1")
    inside = candidates.filter("k > 2").select(F.explode(F.array(F.substring(F.col("key"), F.lit(1), 8 * (F.col("k") - 1)), F.substring(F.col("key"), F.lit(9), 8 * (F.col("k") - 1)))).alias("key"), "n").distinct()
    left = materialise(candidates.join(inside, ["key", "n"], "left_anti"), "candidates")
    cuts = left.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("*", F.substring(F.col("key"), F.lit(1), 8 * F.col("cut")).alias("head"), F.substring(F.col("key"), 8 * F.col("cut") + 1, 8 * (F.col("k") - F.col("cut"))).alias("tail"))
    cuts = cuts.join(levels.select(F.col("key").alias("head"), F.col("n").alias("l")), "head").join(levels.select(F.col("key").alias("tail"), F.col("n").alias("r")), "tail")
    named = words.select(F.col("key").alias("word_key"), "lang", "word")
    texts = left.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.substring(F.col("key"), 8 * i + 1, F.lit(8)))).alias("at", "word_key")).join(named, "word_key")
    texts = texts.groupBy("key").agg(F.min("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    scored = cuts.withColumnRenamed("n", "a").join(texts, "key").join(totals, "lang").withColumnRenamed("total", "n")
    wide = {c: F.col(c).cast("decimal(15,0)") for c in "alrn"}  # products have 31 digits, times 1000 there are 36
    scored = scored.withColumns({f"wide_{c}": x for c, x in wide.items()}).withColumn("score", F.expr("(wide_a * wide_n * cast(1000 as decimal(4,0))) div (wide_l * wide_r)"))
    best = scored.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score", "k", "cut"), F.struct("score", "cut")).alias("x")).select("lang", "phrase", "x.*")
    best = materialise(best, "scored")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    for groups in RANK_GROUPS:
        own = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(groups))).orderBy(*order)
        best = best.withColumn("rank", F.row_number().over(own).cast("long")).filter(F.col("rank") <= first)
    return best.select("lang", "rank", "phrase", *[F.col(c).cast("long") for c in ("a", "l", "r", "n", "score", "k", "cut")])


def oracle_sql() -> str:
    """The contract's result from `documents`."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), listed AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), grams AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM listed, range(1, 6) ks(k), unnest(range(1, len(w) - k + 2)) AS t(i)
), counted AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (SELECT lang, sum(f) AS n FROM counted WHERE k = 1 GROUP BY lang
), often AS (SELECT * FROM counted WHERE f >= 100
), cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM often WHERE k > 1
), inside AS (
    SELECT DISTINCT lang, a, array_to_string(w[i:i + j - 1], ' ') AS phrase FROM cand, range(2, 5) js(j), unnest(range(1, k - j + 2)) AS t(i) WHERE j < k
), cuts AS (
    SELECT c.lang, c.phrase, c.a, cut, l.f AS l, r.f AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand c WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND i.a = c.a)) c
    JOIN often l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ')
    JOIN often r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1:], ' ')
    JOIN totals t ON t.lang = c.lang
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score FROM ranked WHERE rank <= 2000
"""
