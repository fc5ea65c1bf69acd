"""SentencePiece BPE encoding and decoding by a table of each prefix's last token."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm.common import id_and_text, pieces_of, record_batch, with_id

SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
#: Distinct words, of LONG characters at most, and pairs of tokens that a Python worker remembers
#: (some 80 and 50 MB); it forgets them all when there are more, and the words when a task ends.
REMEMBERED, PAIRS, LONG = 250_000, 500_000, 64


def load_model(path: str) -> dict:
    """Pieces, scores and types of a BPE model with byte fallback and identity normalisation."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
        raise ValueError("only BPE models with byte fallback, identity normalisation and a dummy prefix are read")
    if any(p.type not in (_NORMAL, _UNKNOWN, _CONTROL, _BYTE) for p in model.pieces):
        raise ValueError("user-defined and unused pieces are not read")
    if any(SPACE in p.piece.lstrip(SPACE) for p in model.pieces):
        raise ValueError("a piece holds a space after other characters; words are not independent")
    return {"pieces": [p.piece for p in model.pieces], "scores": [p.score for p in model.pieces], "types": [p.type for p in model.pieces], "end": next(i for i, p in enumerate(model.pieces) if p.piece == "</s>")}


class PrefixTable:
    """Encodes words of one model.

    In BPE the encoding of a prefix of a word is fixed, and so is its last token. A run of
    tokens is the encoding of its text if and only if each token encodes itself and each two
    neighbours encode to just these two. So for each end of a prefix the tokens that end there
    (an Aho-Corasick automaton finds them) are tested against the last token of what is left
    before them; one passes. The ids are read from the table backwards.
    """

    def __init__(self, model: dict) -> None:
        import ahocorasick

        self.pieces, self.end = model["pieces"], model["end"]
        self.score = {p: s for p, s, t in zip(model["pieces"], model["scores"], model["types"]) if t == _NORMAL}
        self.id = {p: i for i, (p, t) in enumerate(zip(model["pieces"], model["types"])) if t == _NORMAL}
        self.bytes = {int(p[1:-1], 16): i for i, (p, t) in enumerate(zip(model["pieces"], model["types"])) if t == _BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.types, self.decimal = model["types"], [f" {i}" for i in range(len(model["pieces"]))]
        self.chars = {p for p in self.id if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if len(p) == 1 or self.merged(p) == [p]:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.known: dict[str, tuple[bytes, int, str]] = {}
        self.runs = re.compile(f"{SPACE}{{2,}}")

    def merged(self, text: str) -> list[str]:
        """Plain merging, best score first and leftmost among equals; for short texts."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def pair_fits(self, left: int, right: int) -> bool:
        key = left << 20 | right
        fits = self.fits.get(key)
        if fits is None:
            a, b = self.pieces[left], self.pieces[right]
            fits = self.fits[key] = self.merged(a + b) == [a, b]
            if len(self.fits) > PAIRS:
                self.fits.clear()
        return fits

    def ids(self, word: str) -> list[int]:
        """Ids of a text that has no space after another character."""
        spaces = len(word) - len(word.lstrip(SPACE))
        if spaces > 1:  # pieces of spaces only share one score, so they merge by place: see spaces_first
            return self.spaces_first(word, spaces)
        last, length = [0] * (len(word) + 1), [0] * (len(word) + 1)
        last[0] = -1
        if not self.chars.issuperset(word):  # a character that no piece has ends all merges: what follows starts afresh
            for i, c in enumerate(word):
                if c not in self.chars:
                    last[i + 1] = -1
        known = self.fits.get
        for at, (token, n) in self.automaton.iter(word):
            end = at + 1
            if not length[end]:
                before = last[end - n]
                fits = before < 0 or known(before << 20 | token)
                if fits is None:
                    fits = self.pair_fits(before, token)
                if fits:
                    last[end], length[end] = token, n
        return self.backwards(word, last, length)

    def backwards(self, word: str, last: list[int], length: list[int]) -> list[int]:
        out, end = [], len(word)
        while end:
            if length[end]:
                out.append(last[end])
                end -= length[end]
            else:
                out += [self.bytes[b] for b in reversed(word[end - 1].encode())]
                end -= 1
        return out[::-1]

    def spaces_first(self, word: str, spaces: int) -> list[int]:
        """The last space may go to the letters; the others, all of one score, merge from the
        left: each takes the next ones for as long as that makes a piece."""
        rest = self.ids(word[spaces - 1 :])
        if spaces < len(word) and self.pieces[rest[0]] != SPACE:
            spaces -= 1
        else:
            rest = rest[1:]
        return self.space_run(spaces) + rest

    def space_run(self, n: int) -> list[int]:
        """Ids of n spaces: a queue of pairs, leftmost first among the equal scores."""
        import heapq

        nxt, prv, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
        queue: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = nxt[i]
            if 0 <= i and j < n and (s := self.score.get(SPACE * (size[i] + size[j]))) is not None:
                heapq.heappush(queue, (-s, i, size[i], size[j]))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = nxt[i] if size[i] else n
            if size[i] != a or j >= n or size[j] != b:
                continue
            size[i], size[j], nxt[i] = a + b, 0, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            if prv[i] >= 0:
                offer(prv[i])
            offer(i)
        return [self.id[SPACE * s] for s in size if s]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, as far as no ids before them matter."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw = bytearray()
            if self.types[i] == _NORMAL:
                out.append(self.pieces[i])
        if raw:
            out.append(raw.decode(errors="replace"))
        return "".join(out).replace(SPACE, " ")

    def word(self, word: str) -> tuple[bytes, int, str]:
        """(ids in decimal, each after a space; how many; the text they decode to)."""
        found = self.known.get(word)
        if found is None:
            ids = self.ids(word)
            plain = self.byte_of.keys().isdisjoint(ids)  # then the tokens are the word
            found = ("".join(map(self.decimal.__getitem__, ids)).encode(), len(ids), word.replace(SPACE, " ") if plain else self.decode(ids))
            if len(word) <= LONG:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[word] = found
        return found

    def words(self, text: str) -> list[str]:
        """Cut a text, with its dummy space, before each space that follows another character,
        and around line ends where no piece has one; no merge crosses these places."""
        if not text:
            return []
        lines = text.split("\n") if "\n" not in self.id else [text]
        out = []
        for k, line in enumerate(lines):
            if k:
                out.append("\n")
            parts = line.split(" ")
            if k == 0:
                parts.insert(0, "")  # the dummy space
            head, pending = parts[0], 0
            if head:
                out.append(head)
            for part in parts[1:]:
                pending += 1
                if part:
                    out.append(SPACE * pending + part)
                    pending = 0
            if pending:
                out.append(SPACE * pending)
        return out


_TABLES: dict[tuple[int, int], PrefixTable] = {}


def table_of(key: tuple[int, int], model: dict) -> PrefixTable:
    """One table for each Python worker and model."""
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = PrefixTable(model)
    return _TABLES[key]


def broadcast_model(spark: SparkSession, path: str):
    """The vocabulary for the executors: as large as the model file, whatever the documents."""
    model = load_model(path)
    if len(model["pieces"]) > 1_000_000:
        raise ValueError("the vocabulary has more than a million pieces")
    return spark.sparkContext.broadcast(model), (len(model["pieces"]), hash(tuple(model["pieces"])))


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """For each row: doc_id, n_tokens, ids_sha256, decoded_sha256; with_text adds ids and decoded.

    The ids are those that the model's own library gives for the whole text, plus the end id.
    decoded is the text of these ids. Rows are independent: no shuffle, and the only thing
    sent around is the vocabulary. Null text: empty, with the end id only. A null id stays
    null, rows that repeat an id each get a row, an empty table gives no rows.
    """
    sent, key = broadcast_model(docs.sparkSession, model_path)
    fields = [("_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.string()), ("decoded", pa.string())] if with_text else []
    schema = pa.schema(fields)

    def run(batches):
        table = table_of(key, sent.value)
        end, known = b" %d" % table.end, table.known.get
        for batch in pieces_of(batches):
            rows: list[list] = [[] for _ in fields[1:]]
            for text in batch.column(1).to_pylist():
                found = [known(w) or table.word(w) for w in table.words(text.replace(SPACE, " "))]
                ids = (b"".join([f[0] for f in found]) + end)[1:]
                decoded = "".join([f[2] for f in found])[1:]  # without the dummy space
                row = [sum(f[1] for f in found) + 1, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ids.decode(), decoded]
                for column, value in zip(rows, row):
                    column.append(value)
            yield record_batch(schema, batch.column(0), *rows)
        table.known.clear()

    out = id_and_text(docs, id_col, text_col).mapInArrow(run, "_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids string, decoded string" if with_text else ""))
    return out.select(with_id(), *[F.col(n) for n, _ in fields[1:]])
