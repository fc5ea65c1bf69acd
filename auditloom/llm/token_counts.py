"""Token counts of unigram segmentations, with one score for each shared prefix of words."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm.common import id_and_text, pieces_of, record_batch, with_id
from auditloom.llm.sentencepiece_bpe import load_model

SPACE = "▁"
#: Log-probabilities are whole numbers of this size, so that sums of them are exact.
UNIT = 1 << 20
#: Nodes of the trie, and words with their counts, that a Python worker keeps, some 100 MB; when
#: there are more, it starts afresh.
NODES, WORDS = 400_000, 400_000
#: Characters of text whose words go in at a time; scores of a word's last places that are held.
SLICE, HELD = 1 << 20, 4096
#: Bytes of text that are read at a time.
PIECE_BYTES = 1 << 20


def unigram_scores(path: str) -> dict[str, int]:
    """Pieces and log-probabilities in units: the vocabulary of a model file, whose pieces are
    ranked, under Zipf's law, p = 1 / (rank + 1) / H. Nothing is trained here."""
    model = load_model(path)
    ranked = [p for _, _, p in sorted((-s, i, p) for i, (p, s, t) in enumerate(zip(model["pieces"], model["scores"], model["types"])) if t == 1)]
    total = math.log(sum(1 / (r + 2) for r in range(len(ranked))))
    return {p: round((-math.log(r + 2) - total) * UNIT) for r, p in enumerate(ranked)}


def shared(a: str, b: str) -> int:
    """How many characters two words begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while a[low] == b[low]:
        low += 1
    return low


class PrefixTrie:
    """A trie of words. A node is a prefix, and holds the best score of a segmentation of it (the
    forward score) and its number of tokens; both are computed once, when the first words with
    that prefix come, and stay for all words to come. Prefixes that only one of the words has
    get no nodes: their scores roll on, as many as the longest piece asks for, to the word's
    terminal count. So no word, of whatever length, needs more memory than others. Pieces that
    end at a place are found by an automaton.

    A character that no piece holds counts as its UTF-8 bytes, at a score below all pieces'. Of
    equal scores, fewer tokens win.
    """

    def __init__(self, scores: dict[str, int]) -> None:
        import ahocorasick

        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0) - 10 * UNIT
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # node << 21 | character: node
        self.best, self.count = [0], [0]
        self.terminal: dict[str, int] = {}

    def insert(self, words: list[str]) -> None:
        """Put distinct words in and store their terminal counts. They go in sorted, so that what
        a word shares with any other it shares with a neighbour."""
        child, words = self.child, sorted(words)
        path, before = [0], 0
        for i, word in enumerate(words):
            after = shared(word, words[i + 1]) if i + 1 < len(words) else 0
            del path[before + 1 :]
            depth, n = len(path) - 1, len(word)
            while depth < n and (node := child.get(path[-1] << 21 | ord(word[depth]))) is not None:
                path.append(node)
                depth += 1
            self.terminal[word] = self._extended(word, path, min(after, depth + NODES - len(self.best))) if depth < n else self.count[path[-1]]
            before = after

    def _extended(self, word: str, path: list[int], keep: int) -> int:
        """The token count of a word; path are the nodes that it has. Its prefixes of up to `keep`
        characters become nodes."""
        scores, longest, depth = self.scores, self.longest, len(path) - 1
        first = max(0, depth - longest)  # the place of the first score that is held
        best, count = [self.best[x] for x in path[first:]], [self.count[x] for x in path[first:]]
        pieces = self.automaton.iter(word, max(0, depth + 1 - longest)) if len(scores) else iter(())
        at, piece = next(pieces, (len(word), None))
        while at < depth:
            at, piece = next(pieces, (len(word), None))
        for end in range(depth + 1, len(word) + 1):
            c = word[end - 1]
            top, fewest = (best[-1] + self.unknown, count[-1] + len(c.encode())) if c not in scores else (None, 0)
            while at == end - 1:
                size, score = piece
                j = end - size - first
                score += best[j]
                if top is None or score > top or (score == top and count[j] + 1 < fewest):
                    top, fewest = score, count[j] + 1
                at, piece = next(pieces, (len(word), None))
            if end <= keep:
                self.child[path[-1] << 21 | ord(c)] = len(self.best)
                path.append(len(self.best))
                self.best.append(top)
                self.count.append(fewest)
            best.append(top)
            count.append(fewest)
            if len(best) > HELD + longest:
                del best[:-longest], count[:-longest]
                first = end - longest + 1
        return count[-1]

    def counts(self, words: list[str]) -> dict[str, int]:
        """Terminal counts of distinct words; those not yet known are put in."""
        missing = [w for w in words if w not in self.terminal]
        if len(self.best) >= NODES or len(self.terminal) + len(missing) > WORDS:
            self.clear()
            missing = words
        self.insert(missing)
        return self.terminal


_TRIES: dict[tuple[int, int], PrefixTrie] = {}


def _trie(key: tuple[int, int], scores: dict[str, int]) -> PrefixTrie:
    if key not in _TRIES:
        _TRIES.clear()
        _TRIES[key] = PrefixTrie(scores)
    return _TRIES[key]


def _sent(spark: SparkSession, path: str):
    """The vocabulary for the executors: as large as the model file, whatever the documents."""
    scores = unigram_scores(path)
    return spark.sparkContext.broadcast(scores), (len(scores), hash(tuple(sorted(scores.items()))))


_WHITE = re.compile(r"\s")


def pretokens(text: str) -> list[str]:
    """The words between white space, each after a space mark."""
    return [SPACE + w for w in text.split()]


def sliced(text: str) -> Iterator[str]:
    """Parts of a text, cut at white space, of some SLICE characters, or a word if that is longer."""
    begin = 0
    while len(text) - begin > SLICE and (white := _WHITE.search(text, begin + SLICE)):
        yield text[begin : white.end()]
        begin = white.end()
    yield text[begin:] if begin else text


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, n_pretokens, n_tokens: the sum of its pre-tokens' token counts in
    their best unigram segmentations.

    Distinct pre-tokens of some 1 MB of text at a time go into the trie that a Python worker
    keeps from batch to batch and task to task, so a shared prefix is scored once a worker, as
    long as NODES hold all of them. A long text goes in by slices. Rows are independent: no
    shuffle, only the vocabulary is sent. Null or empty text: 0 and 0. A null doc_id stays null, rows that
    repeat a doc_id each get a row, an empty table gives none.
    """
    sent, key = _sent(docs.sparkSession, model_path)
    schema = pa.schema([("_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        trie = _trie(key, sent.value)
        for batch in pieces_of(batches, 1, PIECE_BYTES):
            texts = batch.column(1).to_pylist()
            if len(texts) == 1:  # it may be long
                parts, number, tokens = sliced(texts.pop()), 0, 0
                for part in parts:
                    own = pretokens(part)
                    found = trie.counts(list(set(own)))
                    number, tokens = number + len(own), tokens + sum(map(found.__getitem__, own))
                yield record_batch(schema, batch.column(0), [number], [tokens])
                continue
            words = [pretokens(t) for t in texts]
            found = trie.counts(list({w for t in words for w in t}))
            yield record_batch(schema, batch.column(0), [len(t) for t in words], [sum(map(found.__getitem__, t)) for t in words])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "_id long, n_pretokens long, n_tokens long").select(with_id(), "n_pretokens", "n_tokens")


def pretoken_counts(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """For each distinct pre-token of all documents: pretoken, n (occurrences), n_tokens (of
    one). Occurrences are summed in each piece of text before the shuffle."""
    sent, key = _sent(docs.sparkSession, model_path)
    schema = pa.schema([("pretoken", pa.string()), ("n", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        from collections import Counter

        trie = _trie(key, sent.value)
        for batch in pieces_of(batches, 0, PIECE_BYTES):
            texts = batch.column(0).to_pylist()
            for part in sliced(texts[0]) if len(texts) == 1 else ["\n".join(texts)]:
                times = Counter(pretokens(part))
                found = trie.counts(list(times))
                yield record_batch(schema, list(times), list(times.values()), [found[w] for w in times])

    counted = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).mapInArrow(run, "pretoken string, n long, n_tokens long")
    return counted.groupBy("pretoken").agg(F.sum("n").alias("n"), F.first("n_tokens").alias("n_tokens"))
