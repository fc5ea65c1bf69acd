"""Benchmark passages in documents, by a positional inverted index over the documents."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import ALNUM, byte_view, fixed, id_and_text, materialise, pieces_of, record_batch, small_batches, with_id, words

#: Benchmark words in one block of queries: a block's windows take some 13 * 8 bytes a word.
BLOCK_WORDS = 250_000
#: Postings that are followed at a time, and segments that a Python worker gets at a time.
POSTINGS, SEGMENTS = 1 << 20, 4

_SEGMENT = pa.schema([("segment", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary()), ("terms", pa.binary()), ("bounds", pa.binary()), ("postings", pa.binary())])
_SEGMENT_DDL = "segment long, ids binary, counts binary, terms binary, bounds binary, postings binary"


# --------------------------------------------------------------------------- the index


def _segments(batches):
    for number, batch in enumerate(pieces_of(batches, most=2 << 20)):
        hashes, firsts = words(*byte_view(batch.column(1)), ALNUM)
        counts = np.diff(firsts)
        # between two documents one place stays free, so that no phrase runs across
        place = np.arange(len(hashes)) + np.repeat(np.arange(len(counts)), counts)
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        new = np.ones(len(ordered), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        heads = np.flatnonzero(new)
        packed = [batch.column(0).to_numpy(), counts.astype(np.int32), ordered[heads], np.append(heads, len(ordered)).astype(np.int32), place[order].astype(np.int32)]
        yield record_batch(_SEGMENT, [TaskContext.get().partitionId() << 32 | number], *[pa.array([fixed(x)], pa.binary()) for x in packed])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments of a positional index, one for some 2 MB of text, each with all the words of
    its documents: its number; ids and word counts of the documents; the distinct terms as sorted hashes;
    for each term its postings, the ascending places where it stands."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_segments, _SEGMENT_DDL)


class Segment:
    """One segment, unpacked; keys holds (term number, place) of each posting, ascending."""

    def __init__(self, ids: bytes, counts: bytes, terms: bytes, bounds: bytes, postings: bytes) -> None:
        self.ids, self.counts = np.frombuffer(ids, np.int64), np.frombuffer(counts, np.int32).astype(np.int64)
        self.terms, self.bounds = np.frombuffer(terms, np.uint64), np.frombuffer(bounds, np.int32).astype(np.int64)
        self.postings = np.frombuffer(postings, np.int32).astype(np.int64)
        self.keys = np.repeat(np.arange(len(self.terms)) << 32, np.diff(self.bounds)) | self.postings
        self.base = np.cumsum(self.counts + 1) - self.counts - 1  # the place of each document's first word

    def number_of(self, terms: np.ndarray) -> np.ndarray:
        """The number of each term in this segment, or -1."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)


# --------------------------------------------------------------------------- the queries


def _windows(size: int):
    """Rows (window, item): the windows of items as packed word hashes, padded with zeros, after a
    byte that holds how many words they are of."""
    schema = pa.schema([("window", pa.binary()), ("item", pa.string())])

    def run(batches):
        for batch in pieces_of(batches, 1, 1 << 20):
            hashes, firsts = words(*byte_view(batch.column(1)), ALNUM)
            padded, names = np.append(hashes, np.zeros(size, np.uint64)), batch.column(0).to_pylist()
            for name, begin, end in zip(names, firsts[:-1].tolist(), firsts[1:].tolist()):
                n = min(size, end - begin)
                for at in range(begin, end - n + 1 if n else begin, 20_000):
                    starts = np.arange(at, min(at + 20_000, end - n + 1))
                    rows = np.zeros((len(starts), 8 * size + 1), np.uint8)
                    rows[:, 0] = n
                    rows[:, 1 : 8 * n + 1] = padded[starts[:, None] + np.arange(n)].view(np.uint8).reshape(len(starts), -1)
                    yield record_batch(schema, [r.tobytes() for r in rows], [name] * len(rows))

    return run


class Block:
    """Some windows, each once, and the items that each belongs to."""

    def __init__(self, windows: list[bytes], items: list[str], size: int) -> None:
        rows = np.frombuffer(b"".join(windows), np.uint8).reshape(-1, 8 * size + 1)
        _, first, which = np.unique(rows.view(f"V{8 * size + 1}").reshape(-1), return_index=True, return_inverse=True)
        self.names, self.most = items, POSTINGS
        self.owners, self.bounds = np.argsort(which, kind="stable"), np.append(0, np.cumsum(np.bincount(which, minlength=len(first))))
        rows = rows[first]
        self.length = rows[:, 0].astype(np.int64)
        self.vocabulary, self.window = np.unique(np.ascontiguousarray(rows[:, 1:]).view(np.uint64), return_inverse=True)
        self.window = self.window.reshape(-1, size)

    def rarest_first(self, frequency: np.ndarray) -> None:
        """Fix the order in which each window's terms are looked up."""
        times = np.where(np.arange(self.window.shape[1]) < self.length[:, None], frequency[self.window], np.iinfo(np.int64).max)
        self.order = np.argsort(times, axis=1, kind="stable")

    def items_of(self, window: int) -> list[str]:
        return [self.names[i] for i in self.owners[self.bounds[window] : self.bounds[window + 1]]]

    def matches(self, segment: Segment, slop: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, place) of the exact occurrences, by intersecting the postings of the terms,
        moved back by their offsets, from the rarest on. With slop: places of the rarest term
        with all other terms of the window, in any order, at most length + slop words away.

        The postings of the rarest terms are followed POSTINGS at a time, whatever window they
        belong to, and what is found is given out in as many parts."""
        number = segment.number_of(self.vocabulary)[self.window]
        width = self.window.shape[1]
        alive = np.flatnonzero(np.all((number >= 0) | (np.arange(width) >= self.length[:, None]), axis=1))
        term = number[alive, self.order[alive, 0]]
        begins = segment.bounds[term]
        ends = np.cumsum(segment.bounds[term + 1] - begins)
        for at in range(0, int(ends[-1]) if len(ends) else 0, self.most):
            posting = np.arange(at, min(at + self.most, int(ends[-1])))
            which = np.searchsorted(ends, posting, "right")
            place = segment.postings[begins[which] + posting - np.append(0, ends[:-1])[which]]
            yield self._intersected(segment, number, alive[which], place, slop)

    def _intersected(self, segment: Segment, number: np.ndarray, window: np.ndarray, place: np.ndarray, slop: int | None) -> tuple[np.ndarray, np.ndarray]:
        if slop is None:
            place = place - self.order[window, 0]
        for k in range(1, self.window.shape[1]):
            if not len(window):
                break
            j = self.order[window, k]
            beyond = k >= self.length[window]
            term = np.where(beyond, 0, number[window, j]) << 32
            if slop is None:
                low = high = place + j
            else:
                text = np.searchsorted(segment.base, place, "right") - 1
                reach = self.length[window] + slop
                low = np.maximum(place - reach, segment.base[text])
                high = np.minimum(place + reach, segment.base[text] + segment.counts[text] - 1)
            at = np.searchsorted(segment.keys, term | np.maximum(low, 0))
            found = (at < len(segment.keys)) & (low >= 0)
            found[found] = segment.keys[at[found]] <= (term | high)[found]
            keep = beyond | found
            window, place = window[keep], place[keep]
        return window, place


def _blocks(items: DataFrame, id_col: str, text_col: str, size: int) -> Iterator[Block]:
    """The distinct (window, item) rows, BLOCK_WORDS of them at a time or somewhat more. Executors
    make and sort them; the driver only hands each block on. A window that very many items
    share may be in several blocks."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    owned = materialise(rows.mapInArrow(_windows(size), "window binary, item string").distinct(), "windows")
    n = -(-owned.count() // BLOCK_WORDS)
    if not n:
        return
    dealt = materialise(owned.repartitionByRange(n, "window", "item").sortWithinPartitions("window", "item").withColumn("part", F.spark_partition_id()), "blocks")
    for part in range(n):
        block = dealt.filter(F.col("part") == part).select("window", "item").toArrow()
        if block.num_rows:
            yield Block(block.column(0).to_pylist(), block.column(1).to_pylist(), size)


def _frequency(index: DataFrame, block: Block) -> np.ndarray:
    """How often the documents have each term of the block."""
    sent = index.sparkSession.sparkContext.broadcast(block.vocabulary)
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def count(batches):
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for terms, bounds in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                terms, n = np.frombuffer(terms, np.uint64), np.diff(np.frombuffer(bounds, np.int32))
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, sent.value), len(terms) - 1)
                    total += np.where(terms[at] == sent.value, n[at], 0)
        some = np.flatnonzero(total)
        yield record_batch(schema, some, total[some])

    out = np.zeros(len(block.vocabulary), np.int64)
    with small_batches(index.sparkSession, SEGMENTS):
        for row in index.select("terms", "bounds").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
            out[row.term] = row.n  # no more rows than the block has terms
    return out


_FOUND = pa.schema([("segment", pa.int64()), ("pos", pa.int64()), ("_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.binary()), ("items", pa.list_(pa.string())), ("near_items", pa.list_(pa.string()))])
_FOUND_DDL = "segment long, pos long, _id long, n_words long, hits binary, items array<string>, near_items array<string>"


def _search(index: DataFrame, block: Block, slop: int) -> DataFrame:
    """For each document of the index: a bit for each of its words that is hit (none if no word
    is), and the items with exact and proximity matches."""
    sent = index.sparkSession.sparkContext.broadcast(block)  # bounded by BLOCK_WORDS

    def search(batches):
        block = sent.value
        for batch in batches:
            for number, *row in zip(*[c.to_pylist() for c in batch.columns]):
                segment = Segment(*row)
                n = len(segment.ids)
                steps = np.zeros(int(segment.counts.sum()) + n + 1, np.int32)  # where covers begin, less where they end
                items = []
                for within in (None, slop):
                    pairs = np.zeros((0, 2), np.int64)
                    for window, place in block.matches(segment, within):
                        if within is None:
                            np.add.at(steps, place, 1)
                            np.add.at(steps, place + block.length[window], -1)
                        text = np.searchsorted(segment.base, place, "right") - 1
                        pairs = np.unique(np.concatenate([pairs, np.stack([text, window], axis=1)]), axis=0)
                    names: list[set[str]] = [set() for _ in range(n)]
                    for text, window in pairs.tolist():
                        names[text].update(block.items_of(window))
                    items.append([list(x) for x in names])
                hit = np.cumsum(steps) > 0
                bits = [np.packbits(hit[a : a + k]).tobytes() if found else b"" for a, k, found in zip(segment.base.tolist(), segment.counts.tolist(), items[0])]
                yield record_batch(_FOUND, [number] * n, np.arange(n), segment.ids, segment.counts, bits, *items)

    return index.mapInArrow(search, _FOUND_DDL)


def _n_hit(every: list[bytes]) -> int:
    """Words that any of the blocks hit."""
    some = [np.frombuffer(b, np.uint8) for b in every if b]
    return int(np.bitwise_count(np.bitwise_or.reduce(some)).sum()) if some else 0


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 13, slop: int = 5, one_in: int = 20) -> DataFrame:
    """For each row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    A word is hit if it stands inside an occurrence of a window, `size` consecutive words of an
    item (all words of a shorter one). n_items counts the items with occurrences, and a
    document is contaminated if at least one word in `one_in` is hit. n_near counts items with
    a window whose words all stand close together, in any order: proximity matches.

    The documents are indexed once; the index is written to the shared folder. The items'
    distinct windows are made by the executors and come in blocks of some BLOCK_WORDS, and each
    block goes to every segment of the index, where the postings of a window's terms are intersected from the term that is rarest
    in all documents. So what is sent is bounded, whatever the number of items, and each
    document's index stays where it was built: nothing is shuffled by word, so no word can be
    too frequent.

    Null or empty text: no words, not contaminated. Null or empty item: no windows. A null
    item_id counts as the empty string; rows of one item_id are one item. A null doc_id stays
    null; rows that repeat a doc_id each get their own row. Empty tables: no rows, or no hits.
    """
    index = materialise(build_index(docs, id_col, text_col), "index")
    blocks = []
    for block in _blocks(items, item_id, item_text, size):
        block.rarest_first(_frequency(index, block))
        blocks.append(materialise(_search(index, block, slop), "found", SEGMENTS))
    blocks = blocks or [materialise(_search(index, _none(size), slop), "found", SEGMENTS)]
    schema = pa.schema([("_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("n_near", pa.int64())])

    def summed(batches):
        for batch in batches:
            names = [sorted(set(x)) for x in batch.column(3).to_pylist()]
            near = [len(set(x)) for x in batch.column(4).to_pylist()]
            yield record_batch(schema, batch.column(0), batch.column(1), [_n_hit(h) for h in batch.column(2).to_pylist()], [len(x) for x in names], [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], near)

    found = blocks[0].select("_id", "n_words", F.array("hits").alias("hits"), "items", "near_items") if len(blocks) == 1 else _together(blocks)
    out = found.mapInArrow(summed, "_id long, n_words long, n_hit long, n_items long, items_sha256 string, n_near long")
    return out.select(
        with_id(), "n_words", "n_hit", "n_items", "items_sha256",
        ((F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words"))).alias("contaminated"),
        "n_near",
    )


def _none(size: int) -> Block:
    block = Block([], [], size)
    block.rarest_first(np.zeros(len(block.vocabulary), np.int64))
    return block


def _together(blocks: list[DataFrame]) -> DataFrame:
    """Put together what several blocks found: every block has a row for each document, which is
    its place in a segment of the index."""
    every = functools.reduce(DataFrame.union, blocks)
    return every.groupBy("segment", "pos").agg(
        F.first("_id").alias("_id"), F.first("n_words").alias("n_words"), F.collect_list("hits").alias("hits"),
        F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("near_items")).alias("near_items"),
    ).drop("segment", "pos")
