"""Repeated passages by threshold-bounded interval expansion on Burrows-Wheeler transforms.

The corpus is far larger than one transform, so the work is dealt out by content. Each window
of `length` bytes has a minimiser, its least hashed 32-byte gram, and equal windows have equal
minimisers. A maximal run of windows with one minimiser is a piece of text. Only windows with
the same minimiser can be equal, so

1. pieces are compared by hash, first in each task, then by minimiser across tasks: a copy of
   an earlier whole piece is repeated whole, and a minimiser with one piece is done with;
2. the distinct pieces that share a minimiser with others are cut once more, by how far before
   the minimiser a window starts. All windows of such a strip hold the same stretch of text
   around the minimiser, its core, of 83 bytes for windows of 100. Equal windows have equal
   cores, so strips are dealt out by the core's hash, as text, and one that is alone with its
   core is done with;
3. of strips that share a core a transform is built, and intervals are expanded by one byte to
   the front at a time, level by level, so that common prefixes come up by increasing length;
   intervals of one row are dropped, and the expansion stops at `length`. What is left are the
   sets of equal windows. Strips that are too many for one transform are cut in narrower ones.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import byte_view, fixed, materialise, mix, partitions, pieces_of, record_batch, unique_rows, with_id

_U = np.uint64
GRAM = 32
#: Strips of a piece; bytes of all texts for each part that pieces and strips are dealt into, of
#: which a task holds one at a time.
STRIPS, PART_BYTES = 4, 4 << 20
#: Bytes of all texts for each task of a shuffle, where the session has fewer partitions.
TASK_BYTES = 64 << 20
#: Pieces that a task compares at a time, and bytes of text in one transform.
TASK_PIECES, TRANSFORM_BYTES = 1_000_000, 3 << 20
_BYTE = mix(np.arange(256, dtype=np.uint64) + _U(31_337))
_STEP = mix(np.arange(8, dtype=np.uint64) + _U(777)) | _U(1)

#: A piece: minimiser's hash, hash of the piece, document, place of the minimiser, first and
#: last window (places of their first bytes).
PIECE = np.dtype([("hash", "<u8"), ("piece", "<u8"), ("doc", "<i8"), ("at", "<i4"), ("first", "<i4"), ("last", "<i4")])
#: Windows first..last of a document that occur earlier.
RUN = np.dtype([("doc", "<i8"), ("first", "<i4"), ("last", "<i4")])
_DEALT = pa.schema([("part", pa.int64()), ("kind", pa.int64()), ("data", pa.binary())])
_DEALT_DDL = "part long, kind long, data binary"
_PIECES, _RUNS, _TEXTS = 0, 1, 2


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on, by doubling."""
    h, size, level = _BYTE[data], 1, 0
    with np.errstate(over="ignore"):
        while size < GRAM:
            h = mix(h[:-size] * _STEP[level] + h[size:]) if size == 4 else h[:-size] * _STEP[level] + h[size:]
            size, level = 2 * size, level + 1
    return mix(h)


def cut(data: np.ndarray, offsets: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """The pieces of some documents, in order."""
    if len(data) < length:
        return np.zeros(0, PIECE)
    h = grams(data)
    bits = _U(len(data).bit_length())
    low = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equals is least
    width, size = length - GRAM + 1, 1
    while 2 * size <= width:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    if width > size:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    n = np.maximum(np.diff(offsets) - length + 1, 0)  # windows of each document
    doc = np.repeat(np.arange(len(n)), n)
    start = offsets[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    at = (low[start] & ((_U(1) << bits) - _U(1))).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(new)
    out = np.zeros(len(heads), PIECE)
    first, last, at, doc = start[heads], start[np.append(heads[1:], len(start)) - 1] if len(heads) else start, at[heads], doc[heads]
    end = last + length
    total = mix((at - first).astype(np.uint64) << _U(32) | (end - first).astype(np.uint64))
    with np.errstate(over="ignore"):
        for step in range(0, 2 * length, GRAM):  # grams that cover the piece, the last at its end
            total = mix(total * _U(0x9FB21C651E98DF25) + h[np.minimum(first + step, end - GRAM)])
    base = offsets[:-1][doc]
    out["hash"], out["piece"], out["doc"] = h[at], total, docs[doc]
    out["at"], out["first"], out["last"] = at - base, first - base, last - base
    return out


def settle(pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the earliest of each distinct piece, sorted by minimiser; runs of all later ones)."""
    pieces = pieces[np.lexsort((pieces["first"], pieces["doc"], pieces["piece"], pieces["hash"]))]
    new = np.ones(len(pieces), bool)
    new[1:] = (pieces["hash"][1:] != pieces["hash"][:-1]) | (pieces["piece"][1:] != pieces["piece"][:-1])
    later = pieces[~new]
    return pieces[new], joined(later["doc"], later["first"], later["last"])


def joined(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Runs with neighbours made one."""
    order = np.lexsort((first, doc))
    doc, first, last = doc[order], first[order], last[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (first[1:] != last[:-1] + 1)
    heads = np.flatnonzero(new)
    out = np.zeros(len(heads), RUN)
    out["doc"], out["first"] = doc[heads], first[heads]
    out["last"] = last[np.append(heads[1:], len(last)) - 1] if len(heads) else last
    return out


def _dealt(kind: int, key: np.ndarray, rows: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows packed by the part that their key falls into."""
    part = (mix(key.astype(np.uint64)) % _U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, rows = part[order], rows[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    some = [x for x in np.split(rows, cuts) if len(x)]
    return record_batch(_DEALT, part[np.append(0, cuts)] if some else [], [kind] * len(some), [fixed(x) for x in some])


def _cutting(length: int, parts: int):
    def run(batches):
        held, n = [], 0

        def flush():
            first, runs = settle(np.concatenate(held))
            yield _dealt(_PIECES, first["hash"], first, parts)
            yield _dealt(_RUNS, runs["doc"], runs, parts)

        for batch in pieces_of(batches, 1, 2 << 20):
            held.append(cut(*byte_view(batch.column(1)), batch.column(0).to_numpy(), length))
            n += len(held[-1])
            if n >= TASK_PIECES:
                yield from flush()
                held, n = [], 0
        if held:
            yield from flush()

    return run


class _Dealer:
    """Pieces and runs that a task has found, dealt out by document many at a time."""

    def __init__(self, parts: int) -> None:
        self.parts, self.held, self.n = parts, {_PIECES: [], _RUNS: []}, 0

    def add(self, kind: int, rows: np.ndarray):
        if len(rows):
            self.held[kind].append(rows)
            self.n += len(rows)
            if self.n >= TASK_PIECES:
                yield from self.rest()

    def rest(self):
        for kind, some in self.held.items():
            if some:
                rows = np.concatenate(some)
                self.held[kind] = []
                yield _dealt(kind, rows["doc"], rows, self.parts)
        self.n = 0


def _by_part(batches):
    """(part, its rows (kind, data)) of rows in the order of their parts."""
    part, held = None, []
    for batch in batches:
        for p, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if p != part and held:
                yield held
                held = []
            part = p
            held.append((kind, data))
    if held:
        yield held


def _settling(parts: int):
    """Parts of dealt pieces, one after the other: all pieces of a minimiser are in one."""

    def settled(rows, out):
        for kind, data in rows:
            if kind == _RUNS:
                yield from out.add(_RUNS, np.frombuffer(data, RUN))
        held = [np.frombuffer(data, PIECE) for kind, data in rows if kind == _PIECES]
        if not held:
            return
        first, runs = settle(np.concatenate(held))
        yield from out.add(_RUNS, runs)
        same = first["hash"][1:] == first["hash"][:-1]
        yield from out.add(_PIECES, first[np.append(same, False) | np.append(False, same)])

    def run(batches):
        out = _Dealer(parts)
        for rows in _by_part(batches):
            yield from settled(rows, out)
        yield from out.rest()

    return run


def _by_document(dtype: np.dtype):
    """Parts of rows dealt by document: a row of packed entries for each document."""
    schema = pa.schema([("doc", pa.int64()), ("data", pa.binary())])

    def run(batches):
        for held in _by_part(batches):
            rows = np.concatenate([np.frombuffer(data, dtype) for _, data in held])
            rows = rows[np.argsort(rows["doc"], kind="stable")]
            cuts = np.flatnonzero(np.diff(rows["doc"])) + 1
            some = np.split(rows, cuts)
            for at in range(0, len(some), 5000):
                yield record_batch(schema, np.array([x["doc"][0] for x in some[at : at + 5000]], np.int64), [fixed(x) for x in some[at : at + 5000]])

    return run


def strips(piece: tuple, low: int, high: int, parts: int, length: int, text: bytes, base: int) -> list[tuple[int, int, int, int, int]]:
    """(low, high, core's hash, first, last window) of `parts` strips of a piece or strip: its windows
    that start low..high bytes before the minimiser. text holds the document from `base` on."""
    _, _, _, at, first, last = piece
    width, out = -(-(high - low + 1) // parts), []
    for near in range(low, high + 1, width):
        far = min(near + width - 1, high)
        begin, end = max(first, at - far), min(last, at - near)
        if begin <= end:
            core = text[at - near - base : at - far + length - base]
            out.append((near, far, xxhash.xxh3_64_intdigest(core, near), begin, end))
    return out


def _with_text(length: int, parts: int):
    def run(batches):
        for batch in pieces_of(batches, 0, 4 << 20):
            held: dict[int, list[bytes]] = {}
            for text, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw, pieces = text.encode(), np.frombuffer(data, PIECE).copy()
                cut = [(*x, i) for i, p in enumerate(pieces.tolist()) for x in strips(p, 0, length - GRAM, STRIPS, length, raw, 0)]
                out = pieces[[x[5] for x in cut]]
                out["hash"], out["first"], out["last"] = (np.array([x[k] for x in cut], np.uint64 if k == 2 else np.int64) for k in (2, 3, 4))
                out["piece"] = [x[0] << 32 | x[1] for x in cut]  # its place before the minimiser
                part, packed = (mix(out["hash"]) % _U(parts)).tolist(), out.tobytes()
                for i, (p, x) in enumerate(zip(part, cut)):
                    held.setdefault(p, []).append(packed[i * PIECE.itemsize : (i + 1) * PIECE.itemsize] + raw[x[3] : x[4] + length])
            some = list(held.items())
            for at in range(0, len(some), 5000):
                yield record_batch(_DEALT, [p for p, _ in some[at : at + 5000]], [_TEXTS] * len(some[at : at + 5000]), [b"".join(x) for _, x in some[at : at + 5000]])

    return run


def transform(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in the order of their first `depth` codes or more, the row of each suffix)."""
    n = len(codes)
    key = np.zeros(n, np.uint64)
    padded = np.append(codes, np.zeros(8, np.uint8)).astype(np.uint64)
    for i in range(8):
        key = key << _U(8) | padded[i : i + n]
    size = 8
    while True:
        order = np.argsort(key)
        ordered = key[order]
        new = np.ones(n, bool)
        new[1:] = ordered[1:] != ordered[:-1]
        if size >= depth or new.all():
            row = np.empty(n, np.int32)
            row[order] = np.arange(n, dtype=np.int32)
            return order.astype(np.int32), row
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new).astype(np.uint64)
        key = rank << _U(32)
        key[: n - size] |= rank[size:]
        size *= 2


def expand(codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, set) of all windows of `length` codes that occur twice or more; no window has a
    separator (code 0).

    The interval of a string in the suffix order is split by the codes that come before its
    suffixes, which gives the intervals of all strings one code longer. Level after level,
    intervals of one row are dropped, so what is left on level `length` are the windows.
    """
    order, row = transform(codes, length)
    n = len(codes)
    front = np.where(order > 0, codes[order - 1], 0)  # the transform
    back = row[order - 1]  # the row of the suffix that starts one earlier
    head = codes[order]
    rows, group = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
    place = np.full(n, -1, np.int32)
    for _ in range(length):
        some = front[rows] > 0
        rows, group = back[rows[some]], group[some]
        place[rows] = group
        rows = np.sort(rows)
        label = place[rows]
        if not len(rows):
            break
        new = np.ones(len(rows), bool)
        new[1:] = (label[1:] != label[:-1]) | (head[rows[1:]] != head[rows[:-1]])
        many = np.append(~new[1:], False) | ~new  # not alone in its interval
        group = (np.cumsum(new) - 1).astype(np.int32)[many]
        rows = rows[many]
    return order[rows].astype(np.int64), group


def _expanding(length: int, parts: int, most: int):
    """Parts of the texts of strips, all strips of a core in one."""

    def windows(pieces: np.ndarray, texts: list[bytes]) -> np.ndarray:
        codes = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8) + np.uint8(1)  # UTF-8 has no byte 255: it turns into 0
        places, group = expand(codes, length)
        sizes = pieces["last"].astype(np.int64) - pieces["first"] + length + 1
        bounds = np.cumsum(sizes) - sizes
        of = np.searchsorted(bounds, places, "right") - 1
        doc, start = pieces["doc"][of], pieces["first"][of] + (places - bounds[of])
        sort = np.lexsort((start, doc, group))
        later = np.append(False, group[sort][1:] == group[sort][:-1]) if len(sort) else np.zeros(0, bool)
        return joined(doc[sort][later], start[sort][later], start[sort][later])

    def equals(group) -> np.ndarray:
        first: dict[bytes, tuple[int, int]] = {}
        at = [(int(p["doc"][0]), int(p["first"][0])) for _, p, _ in group]
        for place, (*_, text) in zip(at, group):
            first[text] = min(place, first.get(text, place))
        later = np.array([place for place, (*_, text) in zip(at, group) if place != first[text]], np.int64).reshape(-1, 2)
        return joined(later[:, 0], later[:, 1], later[:, 1])

    def unpacked(data: bytes):
        at = 0
        while at < len(data):
            piece = np.frombuffer(data, PIECE, 1, at)
            end = at + PIECE.itemsize + int(piece["last"][0] - piece["first"][0]) + length
            yield int(piece["hash"][0]), piece, data[at + PIECE.itemsize : end]
            at = end

    def narrower(group):
        """Strips of one core, each cut in two, under their own cores."""
        for _, piece, text in group:
            p = piece[0].tolist()
            for near, far, key, first, last in strips(p, p[1] >> 32, p[1] & 0xFFFFFFFF, 2, length, text, p[4]):
                part = piece.copy()
                part["hash"], part["piece"], part["first"], part["last"] = key, near << 32 | far, first, last
                yield key, part, text[first - p[4] : last - p[4] + length]

    def expanded(found):
        """Transforms of bounded size over the strips whose core others have too."""
        found.sort(key=lambda x: x[0])
        held, size = [], 0
        for _, group in itertools.groupby(found, key=lambda x: x[0]):
            group = list(group)
            own = sum(len(t) + 1 for *_, t in group)
            if len(group) == 1:
                continue
            near, far = int(group[0][1]["piece"][0]) >> 32, int(group[0][1]["piece"][0]) & 0xFFFFFFFF
            if own > most and near < far:
                yield from expanded(list(narrower(group)))
                continue
            if own > most:  # strips of one window, which is the core: nothing is left to expand
                yield equals(group)
                continue
            if size and size + own > most:
                yield windows(np.concatenate([x for _, x, _ in held]), [t for *_, t in held])
                held, size = [], 0
            held += group
            size += own
        if held:
            yield windows(np.concatenate([x for _, x, _ in held]), [t for *_, t in held])

    def run(batches):
        out = _Dealer(parts)
        for rows in _by_part(batches):
            for runs in expanded([x for _, data in rows for x in unpacked(data)]):
                yield from out.add(_RUNS, runs)
        yield from out.rest()

    return run


_KEPT = pa.schema([("_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _keeping(length: int, with_text: bool):
    def run(batches):
        for batch in pieces_of(batches, 1, 8 << 20):
            columns: list[list] = [[], [], [], [], []]
            for text, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw, removed, spans, kept = text.encode(), 0, 0, []
                if data:
                    runs = np.frombuffer(data, RUN)
                    runs = runs[np.argsort(runs["first"], kind="stable")]
                    end = np.maximum.accumulate(runs["last"].astype(np.int64) + length)
                    new = np.append(True, runs["first"][1:] > end[:-1])
                    begins, ends = runs["first"][new].tolist(), end[np.append(np.flatnonzero(new)[1:], len(end)) - 1].tolist()
                    at = 0
                    for a, b in zip(begins, ends):
                        kept.append(raw[at:a])
                        removed, spans, at = removed + b - a, spans + 1, b
                    kept = b"".join([*kept, raw[at:]])
                else:
                    kept = raw
                for column, value in zip(columns, (len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else b"")):
                    column.append(value)
            yield record_batch(_KEPT, batch.column(0), *columns)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, with_text: bool = False) -> DataFrame:
    """For each row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text adds kept.

    A byte of a text in UTF-8 is removed if a string of `length` bytes that covers it also
    starts earlier: in a document with a smaller doc_id, or earlier in the same one. Strings
    lie in one document and are judged on the input. n_spans counts the maximal removed runs;
    kept (binary) is what remains, joined.

    Packed rows of pieces, about one for every 35 bytes of text, are shuffled once by
    minimiser; a task first folds its own copies, so that a passage that every document has
    is one piece a task. Only pieces that share a minimiser with different ones are shuffled
    as text, in strips. A task holds one part of some PART_BYTES at a time. Texts are shuffled to join the pieces and, at the end, the runs to remove.

    Null or empty text: 0 bytes. A null doc_id counts as smaller than any other. Rows that
    repeat a doc_id are documents of their own, ordered by text. Texts shorter than `length`
    lose nothing. Empty table: no rows.
    """
    if not 2 * GRAM <= length <= 1 << 20:
        raise ValueError(f"length must be at least {2 * GRAM}")
    texts, _ = unique_rows(docs, id_col, text_col)
    size = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    n = max(partitions(docs.sparkSession), size // TASK_BYTES)
    parts = max(4 * n, size // PART_BYTES)

    def by_part(rows: DataFrame) -> DataFrame:
        return rows.repartition(n, "part").sortWithinPartitions("part")

    pieces = texts.select("_key", "_text").mapInArrow(_cutting(length, parts), _DEALT_DDL)
    settled = materialise(by_part(pieces).mapInArrow(_settling(parts), _DEALT_DDL), "settled")
    open_ = by_part(settled.filter(F.col("kind") == _PIECES)).mapInArrow(_by_document(PIECE), "doc long, data binary")
    shared = texts.select("_key", "_text").join(open_.hint("shuffle_hash"), F.col("_key") == F.col("doc")).select("_text", "data")
    expanded = by_part(shared.mapInArrow(_with_text(length, parts), _DEALT_DDL)).mapInArrow(_expanding(length, parts, TRANSFORM_BYTES), _DEALT_DDL)
    runs = settled.filter(F.col("kind") == _RUNS).union(materialise(expanded, "expanded"))
    by_doc = by_part(runs).mapInArrow(_by_document(RUN), "doc long, data binary")
    final = texts.join(by_doc.hint("shuffle_hash"), F.col("_key") == F.col("doc"), "left").select("_id", "_text", F.coalesce("data", F.lit(b"")).alias("data"))
    out = final.mapInArrow(_keeping(length, with_text), "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.select(with_id(), "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text)
