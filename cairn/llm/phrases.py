"""Substring deduplication by repeated-phrase automata (operator 3).

A window of ``WINDOW`` words is judged by its content: the least hash among its
``PHRASE``-word phrases is its anchor (winnowing, Schleimer et al. 2003), so
equal windows have equal anchors.  Neighbouring windows of a document with one
anchor make a segment.

1. Every document is read and gives its anchors; phrases that are anchors in two
   documents recur.  They are the confirmed passages, and their words are taken
   from the first document that has them.
2. Confirmed phrases are dealt to shards by that first document, so that one
   passage's phrases meet in one shard, of ``SHARD_PHRASES`` on average.  Every
   shard is compiled with pyahocorasick.  A word is a letter (six bits of its
   hash), a phrase a key of ``PHRASE`` letters; phrases that differ in a word may
   have the same letters, which the hashes of step 4 tell apart.
3. Documents stream through the automata of the shards that have a phrase of
   theirs; a document without a recurring anchor is in no shard's reach, since a
   window can only recur if its anchor does.  Documents of a much used shard are
   dealt out in lots, each with its own copy of the automaton.  What the automata
   find, and nothing else, says where recurring phrases stand.
4. Located segments with equal words are one group; all but its first document
   lose the segment's windows.  Where an anchor has several different segments,
   the first document of each compares its windows one by one, by 128-bit hash.
5. Words covered by lost windows go.  Verdicts go back to the texts by their
   files, so only texts that stream through automata are ever shuffled.

Nulls: a null text has no words; a row without an id neither loses nor removes
words.  Rows that share an id are one document, so they remove nothing from one
another.  Texts shorter than a window keep all words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import addressed, attached, bounded_batches, documents, forget, passing, store
from cairn.llm.shingles import Piece, mix, pieces, powers, rolling

WINDOW, PHRASE = 50, 20
#: Phrases of an automaton, on average: 20 MB or so of nodes.
SHARD_PHRASES = 1 << 14
#: Documents that stream through one copy of an automaton, on average.
LOT = 4096

#: What a text is known by.
ROW = ("doc_id", "_file", "text_hash")

_U = np.uint64
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class Segments:
    """The segments of a piece: row, first window, number of windows, anchor and its word's place."""

    def __init__(self, piece: Piece, window: int, phrase: int) -> None:
        self.piece, self.window = piece, window
        grams = rolling(piece.words, phrase, 0xE7037ED1A0B428DB)
        span, n = window - phrase + 1, len(grams)
        least, wide = np.arange(n), 1
        while wide < span:
            step = min(wide, span - wide)
            other = least[step:]
            least = np.where(grams[least[:-step]] <= grams[other], least[:-step], other) if step < len(least) else least[:0]
            wide += step
        windows = np.zeros(len(piece.words) + 1, np.int64)
        lengths = np.diff(piece.first)
        full = lengths >= window
        np.add.at(windows, piece.first[:-1][full], 1)
        np.add.at(windows, (piece.first[1:] - window + 1)[full], -1)
        at = np.flatnonzero(np.cumsum(windows)[:-1])
        rows = np.searchsorted(piece.first, at, "right") - 1
        anchor = least[at]
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (rows[1:] != rows[:-1])
        first = np.flatnonzero(new)
        self.row, self.low, self.place = rows[first], at[first], anchor[first]
        self.count = np.diff(first, append=len(at))
        self.anchor = grams[self.place]

    def hashes(self) -> list[np.ndarray]:
        """Two hashes of each segment's words."""
        n, out = len(self.piece.words), []
        high = self.low + self.count + self.window - 1
        for base in _BASES:
            up, down = powers(base, n + 1)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.piece.words * up[:n], out=sums[1:])
            out.append(mix((sums[high] - sums[self.low]) * down[self.low] ^ self.count.astype(np.uint64)).view(np.int64))
        return out


def _anchors(window: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text")):
                found = Segments(piece, window, phrase)
                if len(found.row):
                    row = pa.array(found.row + piece.low)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("_file").take(row), pa.array(found.anchor.view(np.int64))], names=["doc_id", "_file", "anchor"])

    return run


def letters(words: np.ndarray) -> np.ndarray:
    """Each word as one of 64 letters."""
    return (words >> _U(58)).astype(np.uint8)


def _phrases(window: int, phrase: int):
    """The letters of confirmed phrases; rows are doc_id, text, anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column("anchors")
            for piece in pieces(batch.column("text")):
                found = Segments(piece, window, phrase)
                wanted = np.unique(known.slice(piece.low, piece.high - piece.low).flatten().to_numpy(zero_copy_only=False))
                own = np.flatnonzero(np.isin(found.anchor.view(np.int64), wanted))
                if not len(own):
                    continue
                anchor, first = np.unique(found.anchor.view(np.int64)[own], return_index=True)
                keys = np.lib.stride_tricks.sliding_window_view(letters(piece.words), phrase)[found.place[own[first]]]
                row = pa.array(found.row[own[first]] + piece.low)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), pa.array(anchor), pa.array([k.tobytes() for k in keys], pa.binary())], names=["doc_id", "anchor", "phrase"])

    return run


def automaton(phrases: list[bytes]) -> ahocorasick.Automaton:
    """Compiles phrases given by their letters."""
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for x in phrases:
        found.add_word(x.decode("latin1"), 1)
    found.make_automaton()
    return found


def _located(window: int, phrase: int):
    """The segments of recurring phrases; a lot's phrases (tag 0) come before its documents (tag 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, search = None, [], None
        for batch in batches:
            shard, lot, tag = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "lot", "tag"))
            ends = [*(np.flatnonzero((np.diff(shard) != 0) | (np.diff(lot) != 0) | (np.diff(tag) != 0)) + 1).tolist(), batch.num_rows]
            low = 0
            for high in ends:
                part = batch.slice(low, high - low)
                if low < high and (shard[low], lot[low]) != group:
                    group, held, search = (shard[low], lot[low]), [], None
                if low < high and not tag[low]:
                    held += part.column("phrase").to_pylist()
                elif low < high and held:
                    if search is None:
                        search = automaton(held)
                    yield from occurrences(part, search, window, phrase)
                low = high

    return run


def occurrences(batch: pa.RecordBatch, search: ahocorasick.Automaton, window: int, phrase: int) -> Iterator[pa.RecordBatch]:
    """The segments of documents whose anchor an automaton finds there."""
    for piece in pieces(batch.column("text")):
        text = letters(piece.words).tobytes().decode("latin1")
        hit = np.zeros(len(text) + 1, bool)
        for _, a, b in piece:
            at = [end for end, _ in search.iter(text[a:b])]
            hit[np.array(at, np.int64) + (a - phrase + 1)] = True
        if not hit.any():
            continue
        found = Segments(piece, window, phrase)
        own = hit[found.place]
        row = pa.array(found.row[own] + piece.low)
        one, two = found.hashes()
        begin = found.low[own] - piece.first[found.row[own]]
        columns = [batch.column(c).take(row) for c in ("doc_id", "_file", "text_hash")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(found.anchor.view(np.int64)[own]), pa.array(one[own]), pa.array(two[own]), pa.array(begin.astype(np.int32)), pa.array(found.count[own].astype(np.int32))],
            names=["doc_id", "_file", "text_hash", "anchor", "one", "two", "low", "n"],
        )


def _windows(window: int):
    """Single windows with their hashes; rows are doc_id, _file, text_hash, text, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans").to_pylist()
            for piece in pieces(batch.column("text")):
                hashes = [rolling(piece.words, window, base).view(np.int64) for base in _BASES]
                rows, at, low = [], [], []
                for row, a, _ in piece:
                    own = np.concatenate([np.arange(s["low"], s["low"] + s["n"]) for s in spans[row]])
                    rows.append(np.full(len(own), row))
                    at.append(own + a)
                    low.append(own)
                rows, at, low = pa.array(np.concatenate(rows)), np.concatenate(at), np.concatenate(low)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in ("doc_id", "_file", "text_hash")], pa.array(hashes[0][at]), pa.array(hashes[1][at]), pa.array(low.astype(np.int32))], names=["doc_id", "_file", "text_hash", "one", "two", "low"])

    return run


def _covered(window: int):
    """Ranges of words from lost windows: rows are doc_id, _file, text_hash, spans; neighbouring ranges merge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans in batch.column("spans").to_pylist():
                ranges: list[list[int]] = []
                for s in sorted((s["low"], s["n"]) for s in spans):
                    end = s[0] + s[1] + window - 1
                    if ranges and s[0] <= ranges[-1][1]:
                        ranges[-1][1] = max(ranges[-1][1], end)
                    else:
                        ranges.append([s[0], end])
                out.append([x for r in ranges for x in r])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ROW], pa.array(out, pa.list_(pa.int32()))], names=[*ROW, "cut"])

    return run


def _rewritten(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                n_words, n_removed, sums, texts = [], [], [], []
                for text, cut in zip(part.column("text"), part.column("cut").to_pylist(), strict=True):
                    words = (text.as_py() or "").encode().split()
                    n, gone = len(words), 0
                    for a, b in reversed(list(zip((cut or [])[::2], (cut or [])[1::2], strict=True))):
                        del words[a:b]
                        gone += b - a
                    kept = b" ".join(words)
                    n_words.append(n)
                    n_removed.append(gone)
                    sums.append(hashlib.sha256(kept).hexdigest())
                    texts.append(kept.decode())
                columns = [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sums, pa.string())] + [pa.array(texts, pa.string())] * with_text
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

    return run


def confirmed(texts: DataFrame, anchors: DataFrame, window: int, phrase: int) -> DataFrame:
    """anchor, phrase (letters) and shard of every phrase that is an anchor in two documents, stored."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    recurring = anchors.groupBy("anchor").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("high")).where("doc_id < high")
    firsts = recurring.groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))
    where = anchors.select("doc_id", "_file").distinct()
    wanted = store(firsts.join(where, "doc_id").withColumn("n", F.size("anchors")), "firsts")
    own = attached(texts.select("doc_id", "_file", "text"), wanted, ["_file", "doc_id"], weight="n")
    found = store(own.mapInArrow(_phrases(window, phrase), f"doc_id {kind}, anchor long, phrase binary").dropDuplicates(["anchor"]), "phrases")
    shards = max(1, -(-found.count() // SHARD_PHRASES))
    return found.select("anchor", "phrase", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"))


def located(texts: DataFrame, anchors: DataFrame, phrases: DataFrame, window: int, phrase: int) -> DataFrame:
    """The segments that start from what the shards' automata find in the documents; ``texts`` has doc_id, _file, text_hash, text."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    routes = store(anchors.join(phrases.select("anchor", "shard"), "anchor").select("doc_id", "_file", "shard").distinct(), "routes")
    lots = routes.groupBy("shard").agg(F.ceil(F.count("*") / LOT).alias("lots"))
    to = F.struct("shard", F.pmod(F.xxhash64("doc_id"), F.col("lots")).alias("lot"))
    sent = routes.join(lots, "shard").groupBy("doc_id", "_file").agg(F.collect_list(to).alias("to"), F.count("*").alias("weight"))
    streamed = attached(texts, store(sent, "sent"), ["_file", "doc_id"], weight="weight").withColumn("to", F.explode("to"))
    streamed = streamed.select("to.shard", "to.lot", F.lit(1).alias("tag"), *ROW, "text", F.lit(None).cast("binary").alias("phrase"))
    none = [F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in (*ROW, "text")]
    compiled = phrases.join(lots, "shard").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1))).select("shard", "lot", F.lit(0).alias("tag"), *none, "phrase")
    rows = compiled.unionByName(streamed).repartition("shard", "lot").sortWithinPartitions("shard", "lot", "tag")
    return rows.mapInArrow(_located(window, phrase), f"doc_id {kind}, _file long, text_hash long, anchor long, one long, two long, low int, n int")


def repeated(df: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """doc_id, _file, text_hash and ``cut`` (begin, end, begin, end ... in words) of each text that loses words, stored; ``df`` has doc_id, _file, text_hash, text."""
    kind = df.schema["doc_id"].dataType.simpleString()
    texts = df.where("doc_id IS NOT NULL AND text IS NOT NULL").select(*ROW, "text")
    span, seen = F.struct("low", "n"), ["anchor", "one", "two"]
    # Tables and shuffles go as soon as nothing reads them, so that disk holds one step's at a time.
    with passing(df.sparkSession) as result:
        with passing(df.sparkSession) as keep:
            anchors = store(texts.select("doc_id", "_file", "text").mapInArrow(_anchors(window, phrase), f"doc_id {kind}, _file long, anchor long"), "anchors")
            phrases = confirmed(texts, anchors, window, phrase)
            segments = keep(store(located(texts, anchors, phrases, window, phrase), "segments"))

        with passing(df.sparkSession) as keep:
            first = store(segments.groupBy(*seen).agg(F.min("doc_id").alias("first")), "first")
            several = first.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("first").alias("low"), F.max("first").alias("high")).where("kinds > 1 AND low < high")
            # Stored, so that both sides of either join are shuffles that adaptive execution can split where a passage is very common.
            several = store(several.select("anchor", F.lit(True).alias("several")), "several")
            kinds = store(first.join(several, "anchor", "left"), "kinds")
            later = segments.join(kinds, seen).where("doc_id > first OR several")
            lists = F.collect_list(F.when(F.expr("doc_id > first"), span)).alias("lost"), F.collect_list(F.when(F.expr("doc_id = first"), span)).alias("spans")
            marked = keep(store(later.groupBy(*ROW).agg(*lists), "marked"))
        forget(segments)

        with passing(df.sparkSession) as keep:
            apart = store(marked.where(F.size("spans") > 0).select(*ROW, "spans", F.size("spans").alias("weight")), "apart")
            each = attached(texts, apart, list(ROW), weight="weight")
            each = keep(store(each.mapInArrow(_windows(window), f"doc_id {kind}, _file long, text_hash long, one long, two long, low int"), "windows"))
        least = store(each.groupBy("one", "two").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("one", "two", "first"), "least")
        single = each.join(least, ["one", "two"]).where("doc_id > first").select(*ROW, "low", F.lit(1).alias("n"))
        lost = marked.select(*ROW, F.inline("lost")).unionByName(single).groupBy(*ROW).agg(F.collect_list(span).alias("spans"))
        return result(store(lost.mapInArrow(_covered(window), f"doc_id {kind}, _file long, text_hash long, cut array<int>"), "cuts"))


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, phrase: int = PHRASE, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked, kept_text for every row."""
    bounded_batches(df.sparkSession)
    body = F.col(text).cast("string")
    rows = addressed(df.select(F.col(key).alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("text_hash")))
    cut = repeated(rows, window, phrase)
    joined = attached(rows, cut.withColumn("weight", F.size("cut")), list(ROW), "left", "weight").select("doc_id", "text", "cut")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_rewritten(with_text), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def op3_repeated_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-word passages that an earlier document has."""
    return remove_repeats(documents(spark, sf_dir), with_text=False)
