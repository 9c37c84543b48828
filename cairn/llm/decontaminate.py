"""Benchmark decontamination by latent semantic retrieval (operator 7).

1. Document frequencies of hashed words over all documents give TF-IDF weights.
2. A randomised SVD (Halko, Martinsson and Tropp 2011) of the passages of all
   documents and all benchmark items gives the latent space: tasks sum A^T(A Q)
   over their passages, read as stored slots of words, and the driver
   orthogonalises ``SLOTS`` x ``RANK`` matrices of fixed size.
3. Every document is searched: its windows of ``WINDOW`` words, from every word on,
   are compared by cosine with the windows of all items.  A window is passed over
   for an item only where the words around it rule out a common subsequence of
   ``PARAPHRASE``: of the item's rarest words, all but the ``need - m`` commonest,
   ``m`` at least have to be there (``need`` is the least length, ``m`` is
   ``RARE`` of it).
4. Around every window at or above ``COSINE``, best first, the longest common
   subsequence with the whole item and the share of the answer found there decide:
   copies have a long subsequence, paraphrases a shorter one and the answer.

The item's answer is a column if there is one, else its last ``ANSWER`` words.
Items under ``LEAST_WORDS`` words are found where their words stand in sequence.
Items come in blocks of about ``ITEM_WINDOWS`` windows, dealt by hash; one block at a
time is broadcast, as text, and prepared by the workers, so what the driver and a
task hold is bounded.  With several blocks the finds go back to the rows by
their addresses.

Nulls: a null or blank text or item matches nothing; ids may be null.  Repeated
rows are searched each by itself, and repeated items found each by itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import WORD, addressed, attached, bounded_batches, documents, forget, scratch_path, store, tidy
from cairn.llm.shingles import Piece, mix, pieces, rolling

SLOTS, RANK, EXTRA, ROUNDS = 1 << 14, 64, 8, 2
WINDOW = 10
#: Words, windows and slots that are handled at once, and words of a task that sums passages.
BLOCK_WORDS, BLOCK_WINDOWS, BLOCK_SLOTS, PART_WORDS = 1 << 17, 1 << 13, 256, 1 << 23
#: Rows that are summed, and bytes of text that are hashed, at once: what these touch stays in a core's cache.
BLOCK_ROWS, BLOCK_BYTES = 1 << 10, 1 << 17
#: Blocks of windows that are summed in single precision.
PART_BLOCKS = 16
COSINE = 0.85
RARE = 0.25
LEAST_WORDS, ANSWER = 8, 8
COPY, PARAPHRASE, ANSWERED = 0.7, 0.5, 0.75
ITEM_WINDOWS = 40_000
_VOCABULARY_BITS, _ITEM_BITS, _SIEVE_BITS = 22, 12, 18

_U = np.uint64
_SHORT = 0xA24BAED4963EE407


def _slot(words: np.ndarray) -> np.ndarray:
    return (mix(words ^ _U(0x7)) & _U(SLOTS - 1)).astype(np.int64)


def hashed(texts: DataFrame) -> DataFrame:
    """Each text's words as slots of two bytes; the passes over all words read these and no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text"), bare=True, size=BLOCK_BYTES):
                data = _slot(piece.words).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), piece.high - piece.low, [None, pa.py_buffer((2 * piece.first).astype(np.int32)), pa.py_buffer(data)])], names=["slots"])

    return texts.mapInArrow(tidy(run), "slots binary")


def _slots(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The slots of a column of ``hashed``, end to end, and where each text's begin."""
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint16), np.zeros(len(column) + 1, np.int64)
    wide = pa.types.is_large_binary(column.type)
    first = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[first[0] : first[-1]]
    return np.frombuffer(data.tobytes(), np.uint16), (first - first[0]) // 2


def _held(slots: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Texts that hold each slot, for texts of so many slots end to end."""
    sizes = sizes[sizes > 0]
    kind = np.uint32 if len(sizes) * SLOTS <= 1 << 32 else np.uint64  # narrow ones are sorted faster
    keys = np.repeat(np.arange(len(sizes), dtype=kind) * kind(SLOTS), sizes)
    keys += slots
    keys.sort()
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return np.bincount((keys[new] & kind(SLOTS - 1)).astype(np.int64), minlength=SLOTS)


def document_frequencies(slots: DataFrame) -> np.ndarray:
    """Texts that hold each slot, over all texts; the last two entries count the texts and their words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(SLOTS + 2, np.int64)
        for batch in batches:
            own, first = _slots(batch.column("slots"))
            # Cut into blocks of whole texts, so that temporary arrays stay small.
            cuts = np.unique(np.append(np.searchsorted(first, np.arange(0, len(own), BLOCK_WORDS)), len(first) - 1))
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                sums[:SLOTS] += _held(own[first[low] : first[high]], np.diff(first[low : high + 1]))
            sums[SLOTS:] += len(first) - 1, len(own)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["slot", "n"])

    out = np.zeros(SLOTS + 2, np.int64)
    for r in slots.mapInArrow(tidy(count), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # SLOTS + 2 rows at most
        out[r.slot] = r.n
    return out


def _windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's windows, end to end and the last one flush with the text's end, begin and end."""
    size = np.diff(first)
    count = np.where(size > 0, -(-np.maximum(size - WINDOW, 0) // WINDOW) + 1, 0)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begins = np.repeat(first[:-1], count) + np.minimum(WINDOW * k, np.repeat(np.maximum(size - WINDOW, 0), count))
    return begins, np.minimum(begins + WINDOW, np.repeat(first[1:], count))


def _spread(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word places of all windows in a row, and where each window starts among them."""
    size = ends - begins
    first = np.cumsum(size) - size
    return np.repeat(begins - first, size) + np.arange(size.sum()), first


def _project(slots: np.ndarray, first: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit vectors of windows: summed IDF-weighted rows of the basis."""
    out = np.add.reduceat(basis[slots] * idf[slots][:, None], first, axis=0)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _sum_rows(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """values[at].sum(1), some rows and one column of ``at`` at a time."""
    out = np.empty((len(at), values.shape[1]), values.dtype)
    other = np.empty_like(out[:BLOCK_ROWS])
    for low in range(0, len(at), BLOCK_ROWS):
        own, columns = out[low : low + BLOCK_ROWS], np.ascontiguousarray(at[low : low + BLOCK_ROWS].T, np.intp)
        np.take(values, columns[0], axis=0, out=own, mode="clip")
        for column in columns[1:]:
            np.take(values, column, axis=0, out=other[: len(own)], mode="clip")
            own += other[: len(own)]
    return out


def _add_rows(total: np.ndarray, slots: np.ndarray, values: np.ndarray, of: np.ndarray) -> None:
    """total[slots] += values[of], where slots repeat and the last row of ``values`` is zero: eight rows of a slot at a time, then eight such sums."""
    order = np.argsort(slots, kind="stable")  # by radix, as slots have two bytes
    slots, of = slots[order], of[order]
    while len(slots):
        new = np.append(0, np.flatnonzero(slots[1:] != slots[:-1]) + 1)
        size = np.diff(new, append=len(slots))
        parts = -(-size // 8)
        at = np.full(8 * parts.sum(), len(values) - 1)
        at[np.arange(len(slots)) + np.repeat(8 * (np.cumsum(parts) - parts) - new, size)] = of
        sums, one = _sum_rows(values, at.reshape(-1, 8)), parts == 1
        total[slots[new[one]]] += sums[np.repeat(one, parts)]
        values = np.concatenate([sums[np.repeat(~one, parts)], np.zeros_like(sums[:1])])
        slots, of = np.repeat(slots[new[~one]], parts[~one]), np.arange(len(values) - 1)


def _gram(slots: np.ndarray, first: np.ndarray, q: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A^T(A q) / idf for texts given by their words' slots; ``q`` is weighted and has a row of zeros at its end."""
    total, part = np.zeros((SLOTS, q.shape[1])), np.zeros((SLOTS, q.shape[1]), np.float32)
    begins, ends = _windows(first)
    slots = slots.astype(np.uint16, copy=False)
    square = np.append(idf, 0).astype(np.float32) ** 2
    for k, low in enumerate(range(0, len(begins), BLOCK_WINDOWS)):
        own, end = begins[low : low + BLOCK_WINDOWS], ends[low : low + BLOCK_WINDOWS]
        at = own[:, None] + np.arange(WINDOW)
        inside = at < end[:, None]
        at = np.where(inside, slots[np.minimum(at, len(slots) - 1)], np.uint16(SLOTS))
        values = np.zeros((len(own) + 1, q.shape[1]), np.float32)
        np.divide(_sum_rows(q, at), np.maximum(square[at].sum(1), 1e-24)[:, None], out=values[:-1])
        row, _ = np.nonzero(inside)
        _add_rows(part, at[inside], values, row)
        if k % PART_BLOCKS == PART_BLOCKS - 1:  # few sums are added in single precision
            total += part
            part.fill(0)
    return total + part


def _weighted(q: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return np.concatenate([q * idf[:, None], np.zeros((1, q.shape[1]))]).astype(np.float32)


def gram(column: pa.Array, q: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A^T(A q), where the rows of A are the unit TF-IDF vectors of the column's windows, end to end."""
    weighted = _weighted(q, idf)
    return sum((_gram(_slot(p.words), p.first, weighted, idf) for p in pieces(column, bare=True)), np.zeros(q.shape)) * idf[:, None]


def latent_space(slots: DataFrame, words: int, idf: np.ndarray) -> np.ndarray:
    """SLOTS x RANK basis from a distributed randomised SVD of all passages of ``slots``, which have so many words."""
    parts = max(1, -(-words // PART_WORDS))

    def summed(basis: np.ndarray) -> np.ndarray:
        shared = slots.sparkSession.sparkContext.broadcast(_weighted(basis, idf))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(basis.shape)
            for batch in batches:
                total += _gram(*_slots(batch.column("slots")), shared.value, idf)
            at = np.arange(0, SLOTS, BLOCK_SLOTS)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([total[i : i + BLOCK_SLOTS].astype(np.float32).tobytes() for i in at], pa.binary())], names=["at", "total"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for i, part in zip(batch.column("at").to_pylist(), batch.column("total"), strict=True):
                    sums[i] = sums.get(i, 0) + np.frombuffer(part.as_buffer(), np.float32).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in sums.values()], pa.binary())], names=["at", "total"])

        each = slots.coalesce(parts).mapInArrow(tidy(run), "at int, total binary").repartition("at")
        total = np.zeros(basis.shape)
        for r in each.mapInArrow(tidy(merge), "at int, total binary").collect():  # one matrix, whatever the number of tasks
            total[r.at : r.at + BLOCK_SLOTS] = np.frombuffer(r.total, np.float32).reshape(-1, basis.shape[1])
        shared.destroy()
        return total * idf[:, None]

    basis = np.linalg.qr(np.random.Generator(np.random.PCG64(11)).standard_normal((SLOTS, RANK + EXTRA)))[0]
    for _ in range(ROUNDS):
        basis = np.linalg.qr(summed(basis))[0]
    small = basis.T @ summed(basis)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return (basis @ vectors[:, np.argsort(values)[::-1][:RANK]]).astype(np.float32)


def common_subsequence(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, with one bit per item word (Hyyro 2004)."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in text:
        m = masks.get(w, 0)
        u = row & m
        row = ((row + u) | (row - u)) & full
    return len(item) - row.bit_count()


class Items:
    """A block of benchmark items with their windows in the latent space."""

    def __init__(self, ids: list, texts: list[str], answers: list[str | None], idf: np.ndarray, basis: np.ndarray) -> None:
        self.ids, self.words, self.answers, parts, counts = [], [], [], [], []
        self.short: dict[int, list[tuple[int, object]]] = {}
        given = [list(_words(a)) if a else None for a in answers]
        for piece in pieces(pa.array(texts, pa.string()), bare=True):
            slots = _slot(piece.words)
            for row, a, b in piece:
                if b - a < LEAST_WORDS:
                    if b > a:
                        self.short.setdefault(b - a, []).append((int(rolling(piece.words[a:b], b - a, _SHORT)[0]), ids[row]))
                    continue
                words = piece.words[a:b].tolist()
                begins = np.arange(a, max(a, b - WINDOW) + 1)
                at, first = _spread(begins, np.minimum(begins + WINDOW, b))
                parts.append(_project(slots[at], first, idf, basis))
                counts.append(len(begins))
                self.ids.append(ids[row])
                self.words.append(words)
                self.answers.append(given[row] or words[-ANSWER:])
        self.vectors = np.concatenate(parts) if parts else np.zeros((0, RANK), np.float32)
        self.first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        # Items by the leading bits of their rarest words: equal words have equal bits, so none is missed.
        n = np.array([len(words) for words in self.words], np.int64)
        need = np.array([_need(k) for k in n.tolist()], np.int64)
        self.least = np.ceil(RARE * need).astype(np.int64)
        codes, own = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, words in enumerate(self.words):
            hashes = np.array(words, np.uint64)
            rarest = hashes[np.argsort(-idf[_slot(hashes)], kind="stable")[: n[i] - need[i] + self.least[i]]]
            codes.append(np.unique((rarest >> _U(64 - _VOCABULARY_BITS)).astype(np.int64)))
            own.append(np.full(len(codes[-1]), i))
        code = np.concatenate(codes)
        order = np.argsort(code, kind="stable")
        self.postings = np.concatenate(own)[order]
        self.at = np.searchsorted(code[order], np.arange((1 << _VOCABULARY_BITS) + 1)).astype(np.int32)
        self.sieve = np.zeros(1 << _SIEVE_BITS, bool)
        self.sieve[code >> (_VOCABULARY_BITS - _SIEVE_BITS)] = True
        self.any = np.zeros(1 << _SIEVE_BITS, bool)
        self.any[(np.array([w for words in self.words for w in words], np.uint64) >> _U(64 - _SIEVE_BITS)).astype(np.int64)] = True
        self.sizes, self.need, self.windows = n, need, np.array(counts, np.int64)
        each = _of_item(np.array([w for words in self.words for w in words], np.uint64), np.repeat(np.arange(len(n)), n))
        self.keys, self.times = np.unique(each, return_counts=True)
        self.has = np.zeros((len(self.words), 1 << _ITEM_BITS), bool)
        for i, words in enumerate(self.words):
            self.has[i, (np.array(words, np.uint64) >> _U(64 - _ITEM_BITS)).astype(np.int64)] = True


def _words(text: str) -> Iterator[int]:
    for piece in pieces(pa.array([text]), bare=True):
        yield from piece.words.tolist()


_FOUND = pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64())])


def _need(n: int) -> int:
    """The least common subsequence that counts for an item of n words."""
    return next(k for k in range(n + 1) if k / n >= PARAPHRASE)


def _of_item(words: np.ndarray, item: np.ndarray) -> np.ndarray:
    """A hash of a word and the item it is looked for."""
    return mix(words ^ (item.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15))


def _likely(piece: Piece, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Intervals (row in the piece, item, first window begin, after the last) where the rarest words allow a common subsequence of PARAPHRASE."""
    place = np.flatnonzero(items.sieve[(piece.words >> _U(64 - _SIEVE_BITS)).astype(np.int64)])
    code = (piece.words[place] >> _U(64 - _VOCABULARY_BITS)).astype(np.int64)
    size = items.at[code + 1] - items.at[code]
    place = np.repeat(place, size)
    item = items.postings[np.repeat(items.at[code] - (np.cumsum(size) - size), size) + np.arange(len(place))]
    order = np.argsort(item, kind="stable")
    place, item = place[order], item[order]
    row = np.searchsorted(piece.first, place, "right") - 1
    last = np.arange(len(place)) + items.least[item] - 1
    n = items.sizes[item]
    fits = last < len(place)
    last[~fits] = 0
    fits &= (item[last] == item) & (row[last] == row) & (place[last] - place < 2 * n + WINDOW)
    at = np.flatnonzero(fits)
    item, row, n = item[at], row[at], n[at]
    low, high = piece.first[row], piece.first[row + 1]
    begin = np.maximum(low, place[last[at]] - WINDOW - n + 1)
    end = np.minimum(np.maximum(low, high - WINDOW), place[at] + n) + 1
    begin = np.minimum(begin, end - 1)
    # Both ends only grow within a text and item, so intervals that touch are neighbours.
    new = np.ones(len(at), bool)
    new[1:] = (item[1:] != item[:-1]) | (row[1:] != row[:-1]) | (begin[1:] > end[:-1])
    first = np.flatnonzero(new)
    return row[first], item[first], begin[first], end[np.append(first[1:], len(at)) - 1] if len(at) else end


def _enough(piece: Piece, items: Items, row: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(interval, window begin) where the words around a window hold as many of the item's, each as often as the item has it at most, as a common subsequence needs.

    A word's place counts for the windows around which it stands without its
    equal so many places before; these are an interval of begins, so all windows
    are counted by one running sum.
    """
    n = items.sizes[item]
    begin, end = np.maximum(piece.first[row], low - n), np.minimum(piece.first[row + 1], high - 1 + WINDOW + n)
    known = items.any.take((piece.words >> _U(64 - _SIEVE_BITS)).astype(np.int64))  # no item has the others
    before = np.append(0, np.cumsum(known))
    begin, end = before[begin], before[end]
    place = np.flatnonzero(known).take(_spread(begin, end)[0])
    code = np.repeat(item << _ITEM_BITS, end - begin)
    code += (piece.words >> _U(64 - _ITEM_BITS)).astype(np.int64).take(place)
    kept = np.flatnonzero(items.has.reshape(-1).take(code))
    own = np.searchsorted(np.cumsum(end - begin), kept, "right")
    # Intervals with fewer words of the item in all have no window with enough.
    some = (np.bincount(own, minlength=len(row)) >= items.need[item])[own]
    place, own = place[kept[some]], own[some]
    word = _of_item(piece.words[place], item[own])
    at = np.minimum(np.searchsorted(items.keys, word), len(items.keys) - 1)
    kept = items.keys[at] == word
    place, own, word, times = place[kept], own[kept], word[kept], items.times[at[kept]]
    order = np.lexsort((word, own))
    place, own, word, times = place[order], own[order], word[order], times[order]
    before = np.arange(len(place)) - times
    same = before >= 0
    before[~same] = 0
    same &= (word[before] == word) & (own[before] == own)
    n = n[own]
    first = np.maximum(np.where(same, place[before] + n + 1, 0), np.maximum(place - WINDOW - n + 1, low[own]))
    last = np.minimum(place + n, high[own] - 1)
    size = high - low + 1
    start = np.cumsum(size) - size
    some = first <= last
    up = np.bincount((start[own] + first - low[own])[some], minlength=size.sum())
    down = np.bincount((start[own] + last + 1 - low[own])[some], minlength=size.sum())
    slot = np.flatnonzero(np.cumsum(up - down) >= np.repeat(items.need[item], size))
    own = np.searchsorted(start, slot, "right") - 1
    return own, slot - start[own] + low[own]


def _unit_windows(slots: np.ndarray, begins: np.ndarray, ends: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """_project() of windows in ascending order; close ones share running sums."""
    low, high = int(begins[0]), int(ends[-1])
    if high - low > 4 * len(begins) + WINDOW:
        places, first = _spread(begins, ends)
        return _project(slots[places], first, idf, basis)
    own = slots[low:high]
    sums = np.zeros((high - low + 1, basis.shape[1]))
    np.cumsum(basis[own] * idf[own][:, None], axis=0, out=sums[1:])
    out = (sums[ends - low] - sums[begins - low]).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _verified(piece: Piece, row: int, item: int, begins: np.ndarray, like: np.ndarray, items: Items) -> dict | None:
    """The first of the windows, by cosine, around which the item stands; ``begins`` ascend."""
    words, low, high = items.words[item], int(piece.first[row - piece.low]), int(piece.first[row - piece.low + 1])

    def measured(first: int, last: int) -> tuple[float, float] | None:
        """Shares of the item and of its answer around the windows from first to last, if they are enough."""
        around = piece.words[max(low, first - len(words)) : min(high, last + WINDOW + len(words))]
        region, around = around, around[items.has[item, (around >> _U(64 - _ITEM_BITS)).astype(np.int64)]].tolist()  # others can't be in a common subsequence
        if len(around) < PARAPHRASE * len(words):
            return None
        lcs = common_subsequence(words, around) / len(words)
        if lcs < PARAPHRASE:
            return None
        answer = common_subsequence(items.answers[item], region.tolist()) / max(1, len(items.answers[item]))
        return (lcs, answer) if lcs >= COPY or answer >= ANSWERED else None

    # More words never hold less, so where all words around some close windows are not enough, those around one aren't.
    group = (begins - begins[0]) // len(words)
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    alive = np.zeros(len(begins), bool)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(begins)], strict=True):
        alive[a:b] = measured(int(begins[a]), int(begins[b - 1])) is not None
    order = np.argsort(-like, kind="stable")
    for k in order[alive[order]].tolist():
        found = measured(int(begins[k]), int(begins[k]))
        if found:
            return {"item_id": items.ids[item], "cosine": float(like[k]), "lcs": found[0], "answer": found[1]}
    return None


def _in_sequence(piece: Piece, items: Items) -> Iterator[tuple[int, object]]:
    """(row, item id) where a short item's words stand in sequence."""
    for n, own in items.short.items():
        grams = rolling(piece.words, n, _SHORT)
        hashes = np.array([h for h, _ in own], np.uint64)
        at = np.flatnonzero(np.isin(grams, hashes))
        row = np.searchsorted(piece.first, at, "right") - 1
        whole = at + n <= piece.first[row + 1]
        for r, h in np.unique(np.stack([row[whole].astype(np.uint64), grams[at[whole]]]), axis=1).T:
            yield from ((int(r) + piece.low, i) for x, i in own if x == int(h))


def search(column: pa.Array, items: Items, idf: np.ndarray, basis: np.ndarray) -> list[list[dict]]:
    """The items that each text holds."""
    out: list[list[dict]] = [[] for _ in range(len(column))]
    for piece in pieces(column, bare=True, size=BLOCK_BYTES):
        for row, found in _in_sequence(piece, items):
            out[row].append({"item_id": found, "cosine": 1.0, "lcs": 1.0, "answer": 1.0})
        if not len(piece.words) or not len(items.ids):
            continue
        slots = _slot(piece.words)
        rows, of, low, high = _likely(piece, items)
        if not len(rows):
            continue
        own, begins_ = _enough(piece, items, rows, of, low, high)
        rows, of = rows[own], of[own]
        ends = np.flatnonzero((rows[1:] != rows[:-1]) | (of[1:] != of[:-1])) + 1
        for begins in np.split(np.arange(len(own)), ends) if len(own) else []:
            row, item = int(rows[begins[0]]) + piece.low, int(of[begins[0]])
            begins = begins_[begins]
            like = np.zeros(len(begins), np.float32)
            own = items.vectors[items.first[item] : items.first[item] + items.windows[item]].T
            stop = int(piece.first[row - piece.low + 1])
            for at in range(0, len(begins), 512):
                part = begins[at : at + 512]
                like[at : at + 512] = (_unit_windows(slots, part, np.minimum(part + WINDOW, stop), idf, basis) @ own).max(axis=1)
            near = np.flatnonzero(like >= COSINE)
            leak = _verified(piece, row, item, begins[near], like[near], items) if len(near) else None
            if leak:
                found = next((x for x in out[row] if x["item_id"] == leak["item_id"]), None)
                if found is None:
                    out[row].append(leak)
                elif (leak["lcs"], leak["cosine"]) > (found["lcs"], found["cosine"]):
                    found |= leak
    return out


#: The block that a worker has prepared last, by its name.
_PREPARED: dict[str, Items] = {}


def _searcher(block: Broadcast, weights: Broadcast):
    name = uuid.uuid4().hex

    @F.arrow_udf("array<struct<item_id:bigint,cosine:double,lcs:double,answer:double>>")
    def run(column: pa.Array) -> pa.Array:
        if name not in _PREPARED:
            _PREPARED.clear()
            _PREPARED[name] = Items(*block.value, *weights.value)
        return pa.array(search(column, _PREPARED[name], *weights.value), pa.list_(_FOUND))

    return run.asNondeterministic()  # else a filter on what is found searches a second time


def leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", answer: str | None = None) -> DataFrame:
    """Every row of ``df`` with the array ``leaks`` of the items found in it; a column of that name is replaced."""
    bounded_batches(df.sparkSession)
    texts = df.select(F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    items = benchmark.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"), (F.col(answer).cast("string") if answer else F.lit(None).cast("string")).alias("answer")).where("text IS NOT NULL")
    slots, passages = store(hashed(texts), "slots"), store(hashed(items.select("text")), "slots")
    counts = document_frequencies(slots)
    idf = np.log((1 + counts[SLOTS]) / (1 + counts[:SLOTS])).astype(np.float32)
    basis = latent_space(slots.unionByName(passages), int(counts[SLOTS + 1]), idf)
    forget(slots)
    forget(passages)
    sc = df.sparkSession.sparkContext
    windows = F.greatest(F.regexp_count("text", F.lit(WORD)) - (WINDOW - 1), F.lit(1))
    blocks = max(1, -(-(items.agg(F.sum(windows)).first()[0] or 0) // ITEM_WINDOWS))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    weights = sc.broadcast((idf, basis))

    def block(k: int) -> Broadcast:
        rows = dealt.where(F.col("block") == k).orderBy("item_id", "text").collect()  # about ITEM_WINDOWS windows
        return sc.broadcast(([r.item_id for r in rows], [r.text for r in rows], [r.answer for r in rows]))

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    if blocks == 1:
        return df.withColumn("leaks", _searcher(block(0), weights)(body))
    path = scratch_path(df.sparkSession, "leaks")
    whole = addressed(df.select(F.struct("*").alias("_all"), body.alias("_body")))
    for k in range(blocks):
        own = block(k)
        found = whole.select("_file", "_row", _searcher(own, weights)("_body").alias("found")).where(F.size("found") > 0)
        found.write.mode("append").parquet(path)
        own.destroy()
    kind = "array<struct<item_id:bigint,cosine:double,lcs:double,answer:double>>"
    each = df.sparkSession.read.schema(f"_file long, _row long, found {kind}").parquet(path)
    each = each.groupBy("_file", "_row").agg(F.flatten(F.collect_list("found")).alias("found"))
    joined = attached(whole, store(each, "found"), ["_file", "_row"], "left")
    return joined.select("_all.*", F.col("found").alias("_found")).withColumn("leaks", F.coalesce("_found", F.array().cast(kind))).drop("_found")


def op7_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item found in it, over all documents and items."""
    found = leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.cosine", "leak.lcs", "leak.answer", F.lit(True).alias("contaminated"))
