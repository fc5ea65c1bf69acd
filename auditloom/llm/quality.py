"""A quality classifier from weak labels: heuristic labellers, EM, and a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import ALNUM, LOWER, NOT_SPACE, byte_view, fixed, id_and_text, mix, pieces_of, placed_words, record_batch, with_id

BUCKETS = 1 << 14
#: Bytes of text that are judged at a time.
PIECE_BYTES = 512 << 10
#: The buckets of texts with bad wording, one for each labeller of it.
BAD_WORDING = BUCKETS - 3
#: Words in a block in which distinct words are counted.
BLOCK_WORDS = 256
_U = np.uint64
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "!#$%&*<=>\\^{|}~"])
#: Bytes of plain words: letters and what lies beyond ASCII; and what may end one.
_PLAIN = _LETTER | (np.arange(256) >= 128)
_ENDS = np.isin(np.arange(256), [ord(","), ord("."), ord("?"), ord(":"), ord(";")])
_NOT_LINE_END = np.arange(256) != 10
#: The class of a byte in a word's shape.
_CLASS = np.full(256, 1, np.uint64)
_CLASS[65:91], _CLASS[48:58] = 2, 3
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _CLASS[_c] = 4 + _c
#: Insults in four languages (fixed values): the base of the wording labeller.
INSULTS = (
    "idiot idiots moron morons imbecile stupid loser losers pathetic worthless disgusting trash scum clown bastard bitch asshole fuck fucking shit whore slut cunt vermin "
    "arschloch dummkopf hurensohn wichser scheiße abschaum fotze missgeburt schlampe trottel vollidiot "
    "connard connasse salope putain merde abruti crétin ordure imbécile débile enculé "
    "idiota imbécil estúpido gilipollas puta mierda cabrón pendejo maricón escoria asqueroso"
)
#: Lengths in bytes of the beginnings of words that may be telling.
BEGINNINGS = (4, 5, 6, 7)

#: Labellers of a text's form, and of its wording; each sort has a model of its own, since
#: a text may be bad in one and good in the other.
FORM = ("shouting", "symbols", "stutter", "variety", "bars", "plain", "steady", "lines")
WORDING = ("insults", "words", "beginnings")
LABELLERS = FORM + WORDING


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of the values between the bounds are true; the bounds span all values."""
    out = np.zeros(len(bounds) - 1, np.int64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = np.add.reduceat(values.view(np.uint8), bounds[:-1][some], dtype=np.int64)
    return out


def _is_plain(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Words of letters only, but for one mark at the end."""
    if not len(starts):
        return np.zeros(0, bool)
    last = starts + lengths - 1
    odd = ~_PLAIN[data]
    odd[last[_ENDS[data[last]] & (lengths > 1)]] = False
    bounds = np.stack([starts, starts + lengths], axis=1).reshape(-1)
    end = bounds[-1]
    return np.add.reduceat(odd[:end].view(np.uint8), bounds[:-1] if end == bounds[-1] else bounds, dtype=np.int64)[::2] == 0


def _in_blocks(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Distinct words in blocks of BLOCK_WORDS words, summed over all of a text's blocks, so that
    the share is measured alike at every length."""
    out = np.zeros(len(firsts) - 1, np.int64)
    for i, (begin, end) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist())):
        for at in range(begin, end, BLOCK_WORDS):
            block = np.sort(hashes[at : min(at + BLOCK_WORDS, end)])
            out[i] += 1 + np.count_nonzero(block[1:] != block[:-1])
    return out


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lines of each text, how many of them repeat another)."""
    hashes, firsts, _, _ = placed_words(data, offsets, _NOT_LINE_END)
    lines = _sums(data == 10, offsets) + 1
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist())], np.int64)
    return lines, np.maximum(lines, distinct) - distinct


def term_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, their terms), kind after kind: whole words, then the beginnings of longer ones."""
    every = np.arange(len(starts))
    yield every, mix(hashes)
    code, done = np.zeros(len(starts), np.uint64), 0
    for size in BEGINNINGS:
        longer = lengths[every] > size
        every, code = every[longer], code[longer]
        for i in range(done, size):
            code = code << _U(8) | LOWER[data[starts[every] + i]].astype(np.uint64)
        done = size
        yield every, mix(code ^ _U(size * 0x9FB21C651E98DF25 % 2**64))


def insult_terms() -> np.ndarray:
    """The terms of INSULTS."""
    data, offsets = byte_view(pa.array([INSULTS], pa.large_string()))
    hashes, _, starts, lengths = placed_words(data, offsets, ALNUM)
    return np.unique(next(iter(term_hashes(data, starts, lengths, hashes)))[1])


class Lexicon:
    """Terms of bad wording: INSULTS, and what labelled texts showed; a table of bits answers for
    most other terms."""

    def __init__(self, shown: np.ndarray) -> None:
        self.base, self.shown = insult_terms(), np.unique(shown.astype(np.uint64))
        self.bits = np.zeros(1 << 16, bool)
        for terms in (self.base, self.shown):
            self.bits[(terms & _U(0xFFFF)).astype(np.int64)] = True

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """(for each of WORDING, the words in each text that have such a term; all words)."""
        hashes, firsts, starts, lengths = placed_words(data, offsets, ALNUM)
        found = [np.zeros(len(starts), bool) for _ in WORDING]
        for kind, (at, terms) in enumerate(term_hashes(data, starts, lengths, hashes)):
            maybe = np.flatnonzero(self.bits[(terms & _U(0xFFFF)).astype(np.int64)])
            at, terms = at[maybe], terms[maybe]
            if not kind:
                found[0][at] = np.isin(terms, self.base)
            found[1 + (kind > 0)][at[np.isin(terms, self.shown)]] = True
        return [_sums(x, firsts) for x in found], np.diff(firsts)


class Judged:
    """Votes on some texts (one row a text, one column a labeller; 1 good, -1 bad, 0 silent), and
    the words with what the scorer sees of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> None:
        self.data, self.offsets = data, offsets
        self.hashes, self.firsts, self.starts, self.lengths = placed_words(data, offsets, NOT_SPACE)
        hashes, firsts, starts, lengths = self.hashes, self.firsts, self.starts, self.lengths
        n = self.n = np.diff(firsts)
        last = starts + lengths - 1
        self.same = np.append(False, hashes[1:] == hashes[:-1])[: len(hashes)]
        self.same[firsts[:-1][n > 0]] = False
        upper, letters = _sums(_UPPER[data], offsets), _sums(_LETTER[data], offsets)
        odd = _sums(_SYMBOL[data[last]] | _SYMBOL[data[starts]], firsts)
        stutter = _share(_sums(self.same, firsts), n)
        variety = _share(_in_blocks(hashes, firsts), n)
        bars = _share(_sums((data[starts] == ord("|")) & (lengths == 1), firsts), n)
        plain = _share(_sums(_is_plain(data, starts, lengths), firsts), n)
        lines, repeated = _lines(data, offsets)
        hits, terms = lexicon.hits(data, offsets)
        self.wording = np.stack([(x >= 2) & (x * 2000 >= terms) for x in hits], axis=1)
        some, never = n >= 3, np.zeros(len(n), bool)

        def vote(bad, good=never):
            return np.where(some & bad, -1, np.where(some & good, 1, 0))

        self.votes = np.stack(
            [
                vote(_share(upper, letters) > 0.3),
                vote(_share(odd, n) > 0.1),
                vote((stutter > 0.15) & (n >= 8)),
                vote((variety < 0.3) & (n >= 20)),
                vote(bars > 0.08),
                vote(plain < 0.7, plain >= 0.9),
                vote(stutter > 0.15, (stutter < 0.06) & (variety > 0.5)),
                vote((_share(repeated, lines) > 0.5) & (lines >= 4)),
                *-self.wording.T.astype(np.int64),
            ],
            axis=1,
        )

    def _cells(self, begin: int, end: int) -> Iterator[np.ndarray]:
        """Buckets of the words begin..end - 1: the word, its shape, whether it repeats the one before."""
        starts, data = self.starts[begin:end], self.data
        last = starts + self.lengths[begin:end] - 1
        yield (mix(self.hashes[begin:end]) >> _U(51)).astype(np.int64)  # the lower half of the buckets
        shape = _CLASS[data[starts]]
        for i in range(3):
            shape = shape | _CLASS[data[np.maximum(last - i, starts)]] << _U(8 * i + 8)
        yield BUCKETS // 2 + (mix(shape) >> _U(52)).astype(np.int64)  # a quarter
        yield BUCKETS * 3 // 4 + self.same[begin:end].astype(np.int64)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """What the scorer gives each text, the same in whatever company it comes: the sums go
        word by word within a text."""
        total, every = np.zeros(len(self.n)), np.repeat(np.arange(len(self.n), dtype=np.int32), self.n)
        for at in range(0, len(every), 1 << 18):
            some = every[at : at + (1 << 18)]
            np.add.at(total, some, sum(weights[cells] for cells in self._cells(at, at + len(some))))
        return total / np.maximum(self.n, 1) + self.wording @ weights[BAD_WORDING : BAD_WORDING + len(WORDING)] + weights[-1]

    def features(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The buckets of each text and the shares of its words in them."""
        out = []
        for i, (begin, end) in enumerate(zip(self.firsts[:-1].tolist(), self.firsts[1:].tolist())):
            counts = np.zeros(BUCKETS, np.int64)
            for at in range(begin, end, 1 << 18):
                for cells in self._cells(at, min(end, at + (1 << 18))):
                    counts += np.bincount(cells, minlength=BUCKETS)
            some, bad = np.flatnonzero(counts), np.flatnonzero(self.wording[i])
            out.append((np.append(some, BAD_WORDING + bad), np.append(counts[some] / max(1, end - begin), np.ones(len(bad)))))
        return out


def pattern_of(votes: np.ndarray) -> np.ndarray:
    """A row of votes as one number, in base 3; silence is 0."""
    return votes % 3 @ (3 ** np.arange(votes.shape[1]))


def votes_of(pattern: np.ndarray) -> np.ndarray:
    return (pattern[:, None] // 3 ** np.arange(len(LABELLERS)) + 1) % 3 - 1


@dataclass
class LabelModel:
    """prior of a good text, and chance[y, labeller, vote + 1] of each vote in class y."""

    prior: float
    chance: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The chance that each row of votes belongs to a good text."""
        rows = np.arange(votes.shape[1])
        logs = np.log(self.chance[:, rows, votes + 1]).sum(axis=2)
        odds = np.log(self.prior) - np.log1p(-self.prior) + logs[1] - logs[0]
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def accuracy(self) -> dict[str, float]:
        """Of a labeller's votes, the share that is right."""
        good, bad = self.prior * self.chance[1], (1 - self.prior) * self.chance[0]
        right, all_ = good[:, 2] + bad[:, 0], (good + bad)[:, [0, 2]].sum(axis=1)
        return dict(zip(LABELLERS, (right / all_).tolist()))


def fit_labels(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over vote patterns, each weighted by how many texts show it.

    Votes, silence too, are independent given the class. It starts from the belief
    that a text with any bad vote is bad, as these heuristics are meant to be seldom wrong."""
    good = np.where((votes < 0).any(axis=1), 0.05, 0.95)
    model = LabelModel(0.5, np.zeros((2, votes.shape[1], 3)))
    for _ in range(rounds):
        chance = np.empty((2, votes.shape[1], 3))
        for y, weight in ((0, (1 - good) * counts), (1, good * counts)):
            for v in range(3):
                chance[y, :, v] = (weight @ (votes == v - 1) + 0.5) / (weight.sum() + 1.5)
        prior = (good @ counts + 1) / (counts.sum() + 2)
        model = LabelModel(float(np.clip(prior, 1e-4, 1 - 1e-4)), chance)
        new = model.posterior(votes)
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return model


def fit_scorer(features: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 200, penalty: float = 1e-5) -> np.ndarray:
    """Weights of a logistic scorer of soft targets (the last is the bias), by Adagrad on all rows."""
    row = np.repeat(np.arange(len(features)), [len(b) for b, _ in features])
    col = np.concatenate([b for b, _ in features]) if features else np.zeros(0, np.int64)
    value = np.concatenate([v for _, v in features]) if features else np.zeros(0)
    weights, squares = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-8)
    for _ in range(rounds if len(features) else 0):
        score = np.bincount(row, value * weights[col], len(features)) + weights[-1]
        error = 1 / (1 + np.exp(-np.clip(score, -50, 50))) - target
        slope = np.append(np.bincount(col, value * error[row], BUCKETS), error.sum()) / len(features) + penalty * weights
        squares += slope**2
        weights -= 0.5 * slope / np.sqrt(squares)
    return weights


@dataclass
class Classifier:
    form: LabelModel
    wording: LabelModel
    weights: np.ndarray
    lexicon: Lexicon

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The chance that a text is good in form and in wording."""
        return self.form.posterior(votes[:, : len(FORM)]) * self.wording.posterior(votes[:, len(FORM) :])

    def scores(self, judged: Judged) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(judged.scores(self.weights), -50, 50)))


_VOTED = pa.schema([("pattern", pa.int64()), ("n", pa.int64())])
_SAMPLED = pa.schema([("pattern", pa.int64()), ("buckets", pa.binary()), ("shares", pa.binary())])
_SCORED = pa.schema([("_id", pa.int64()), ("pattern", pa.int64()), ("posterior", pa.float64()), ("score", pa.float64())])
_TERMS = pa.schema([("term", pa.int64()), ("toxic", pa.bool_()), ("n", pa.int64())])


def _drawn(share: float, *key) -> Column:
    """True for about `share` of the rows: the hash of the key, of 62 bits, is below that share."""
    return F.shiftrightunsigned(F.xxhash64(*key), 2) < F.lit(min(1 << 62, int(share * (1 << 62)) + 1))


def toxic_terms(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", labelled_rows: int = 4000, least: float = 25.0) -> np.ndarray:
    """Terms that tell toxic wording: words, and beginnings of words, of labelled documents.

    About `labelled_rows` rows of labelled (doc_id, toxic 0 or 1) are drawn by a hash of the
    id, so what is broadcast, and the texts that are looked at, are bounded. Of each distinct
    text the distinct terms count once. A term is telling if it is in three toxic texts or more,
    in a share of toxic texts at least five times that of the others, and G squared, the
    likelihood ratio of the two shares, is `least` or more. Null labels are left out.
    """
    rows = labelled.select(F.col(id_col).cast("long").alias("_l"), (F.col(toxic_col).cast("double") > 0).alias("_toxic")).dropna()
    rows = rows.groupBy("_l").agg(F.max("_toxic").alias("_toxic"))
    total = rows.count()
    if not total:
        return np.zeros(0, np.uint64)
    some = rows.filter(_drawn(min(1.0, labelled_rows / total), "_l", F.lit(9)))
    texts = id_and_text(docs, id_col, text_col).join(F.broadcast(some), F.col("_id") == F.col("_l"))
    texts = texts.groupBy(F.xxhash64("_text").alias("_h"), F.xxhash64(F.lit(1), "_text").alias("_g")).agg(F.first("_text").alias("_text"), F.max("_toxic").alias("_toxic")).select("_text", "_toxic")

    def terms(batches):
        for batch in pieces_of(batches, 0, PIECE_BYTES):
            data, offsets = byte_view(batch.column(0))
            hashes, firsts, starts, lengths = placed_words(data, offsets, ALNUM)
            text = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
            toxic = np.array(batch.column(1).to_pylist(), bool)
            for at, found in term_hashes(data, starts, lengths, hashes):
                order = np.lexsort((found, text[at]))
                found, of = found[order], text[at][order]
                new = np.ones(len(found), bool)
                new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
                for side in (False, True):
                    unique, n = np.unique(found[new & (toxic[of] == side)], return_counts=True)
                    yield record_batch(_TERMS, unique.view(np.int64), [side] * len(unique), n)

    counted = texts.mapInArrow(terms, "term long, toxic boolean, n long").groupBy("term").agg(F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(~F.col("toxic"), F.col("n")).otherwise(0)).alias("b"))
    sides = {r["_toxic"]: r["n"] for r in texts.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = float(sides.get(True, 0)), float(sides.get(False, 0))
    if not bad or not good:
        return np.zeros(0, np.uint64)
    share = (F.col("a") + F.col("b")) / (bad + good)

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    ratio = 2 * (part(F.col("a"), bad * share) + part(F.col("b"), good * share) + part(bad - F.col("a"), bad * (1 - share)) + part(good - F.col("b"), good * (1 - share)))
    telling = counted.filter((F.col("a") >= 3) & (F.col("a") * good > 5 * F.col("b") * bad)).filter(ratio >= least).select("term").toArrow()
    return telling.column(0).to_numpy().view(np.uint64)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 8000, labelled: DataFrame | None = None, labelled_rows: int = 4000) -> Classifier:
    """Estimate the labellers from the votes on all documents, then fit the scorer.

    The labellers of wording know INSULTS and, where `labelled` (doc_id, toxic) is given, the
    toxic_terms() of about `labelled_rows` of its rows. The votes are counted by pattern, of
    which there are 3 ** 8 * 2 ** 3 at most, whatever the number of documents; EM runs on these
    counts. The scorer learns the posterior labels of some `sample_rows` documents, and twice as
    many at most. They are drawn by a hash of id, text and the row's place in its task, so that of
    rows alike about the same share is drawn as of others; only their features reach the
    driver. If none is drawn, the first `sample_rows` rows are taken.
    """
    rows, spark = id_and_text(docs, id_col, text_col), docs.sparkSession
    more = toxic_terms(docs, labelled, id_col, text_col, labelled_rows=labelled_rows) if labelled is not None else np.zeros(0, np.uint64)
    lexicon = Lexicon(more)
    sent = spark.sparkContext.broadcast(lexicon)  # terms of labelled_rows texts at most

    def count_patterns(batches):
        total: dict[int, int] = {}
        for batch in pieces_of(batches, 1, PIECE_BYTES):
            found = np.unique(pattern_of(Judged(*byte_view(batch.column(1)), sent.value).votes), return_counts=True)
            for p, n in zip(*[x.tolist() for x in found]):
                total[p] = total.get(p, 0) + n
        yield record_batch(_VOTED, list(total), list(total.values()))

    def sampled(batches):
        for batch in pieces_of(batches, 1, PIECE_BYTES):
            judged = Judged(*byte_view(batch.column(1)), sent.value)
            features = judged.features()
            yield record_batch(_SAMPLED, pattern_of(judged.votes), [fixed(b.astype(np.int16)) for b, _ in features], [fixed(v) for _, v in features])

    counted = rows.mapInArrow(count_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    pattern, counts = np.array([r.pattern for r in counted], np.int64), np.array([r.n for r in counted], np.float64)
    if not len(counted):
        none = [LabelModel(0.5, np.full((2, len(x), 3), 1 / 3)) for x in (FORM, WORDING)]
        return Classifier(*none, np.zeros(BUCKETS + 1), lexicon)
    order = np.argsort(pattern)
    votes, counts = votes_of(pattern[order]), counts[order]
    model = Classifier(fit_labels(votes[:, : len(FORM)], counts), fit_labels(votes[:, len(FORM) :], counts), np.zeros(0), lexicon)
    place = F.monotonically_increasing_id()
    drawn = rows if counts.sum() <= sample_rows else rows.filter(_drawn(sample_rows / counts.sum(), "_id", F.substring("_text", 1, 64), place, F.lit(8)))
    for chosen in (drawn, rows.limit(sample_rows)):
        sample = chosen.mapInArrow(sampled, "pattern long, buckets binary, shares binary").limit(2 * sample_rows).toArrow()
        if sample.num_rows:
            break
    features = [(np.frombuffer(b, np.int16), np.frombuffer(v)) for b, v in zip(sample.column(1).to_pylist(), sample.column(2).to_pylist())]
    model.weights = fit_scorer(features, model.posterior(votes_of(sample.column(0).to_numpy())))
    return model


def classify(docs: DataFrame, model: Classifier | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, sample_rows: int = 8000, labelled: DataFrame | None = None) -> DataFrame:
    """For each row: doc_id, posterior (of the label model), score (of the scorer), kept.

    Eleven heuristics vote good, bad or nothing on each text, eight on its form and three on its
    wording. EM finds, for form and for wording, from the votes on all documents how far each
    can be trusted and what share of texts is good; a text is good if it is so in both. The
    posterior labels train a linear scorer of hashed words, word shapes, stutter and wording; a document
    is kept if the scorer gives it `threshold` or more. Nothing is shuffled but counts of vote
    patterns; each text is judged where it is read, in whole.

    Null or empty text, or no words: no votes and no features, so the prior and the scorer's
    bias decide, which keep it where most documents are good. A null doc_id stays null, rows
    that repeat a doc_id each get a row, an empty table gives none.
    """
    model = model or train(docs, id_col, text_col, sample_rows, labelled)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** 14 weights and the lexicon

    def score(batches):
        for batch in pieces_of(batches, 1, PIECE_BYTES):
            judged = Judged(*byte_view(batch.column(1)), sent.value.lexicon)
            yield record_batch(_SCORED, batch.column(0), pattern_of(judged.votes), sent.value.posterior(judged.votes), sent.value.scores(judged))

    scored = id_and_text(docs, id_col, text_col).mapInArrow(score, "_id long, pattern long, posterior double, score double")
    return scored.select(with_id(), F.round("posterior", 6).alias("posterior"), F.round("score", 6).alias("score"), (F.col("score") >= threshold).alias("kept"))


def keep_good(docs: DataFrame, model: Classifier | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, sample_rows: int = 8000, labelled: DataFrame | None = None) -> DataFrame:
    """The rows of docs, with all columns, that classify() keeps; they stay where they are read."""
    model = model or train(docs, id_col, text_col, sample_rows, labelled)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    field = docs.schema[text_col].dataType.typeName()

    def keep(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(_TEXT) if field != "string" else batch.schema.get_field_index(text_col)).fill_null("")
            kept = [np.zeros(0, bool)]
            for piece in pieces_of([pa.RecordBatch.from_arrays([texts], names=["t"])], 0, PIECE_BYTES):
                kept.append(sent.value.scores(Judged(*byte_view(piece.column(0)), sent.value.lexicon)) >= threshold)
            yield batch.select(range(len(docs_columns))).filter(pa.array(np.concatenate(kept)))

    docs_columns = docs.columns
    with_text = docs if field == "string" else docs.select("*", F.col(text_col).cast("string").alias(_TEXT))
    return with_text.mapInArrow(keep, docs.schema)


_TEXT = "auditloom text"
