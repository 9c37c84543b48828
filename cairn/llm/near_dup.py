"""Near-duplicates by HyperMinHash (operator 9).

A text's set holds its distinct k-word shingles.  Rows with equal sets are one
class, and only one row of each class goes on.  Its set is sketched in
``BUCKETS`` registers as in HyperMinHash (Yu and Weber 2017): a register keeps
the number of leading zeros of its bucket's least hash, and ``MANTISSA`` bits of
what follows.  Large sets deal their shingles over the buckets; sets too small
to fill them give every shingle to every bucket, hashed anew for each.  Sets of
a size between take part in both ways, so that any two sets of similarity 0.8
meet in one of them.

Bands of compressed registers are the keys of a search for candidates.  Every
row of a band's bucket is first compared with the least row in it, its hub: by
the estimate from registers, corrected for chance collisions, and where that is
near the limit or above, on the full sets.  Rows that are linked with a common
row need no comparison with each other, which settles groups of copies of any
size in as many comparisons as they have rows.  What is left are buckets whose
other rows are not all known to be connected; their rows are compared in blocks,
again by registers first, and only rows of pairs that pass have their sets
compared.  Connected components of all links give the result.

Registers and ids travel, not texts: a text is read where it lies and moves only
if a pair of it passes the estimate.  A hub's pairs are dealt out in lots, so one
hub is no single task's.

A pair at the limit misses all ``BANDS`` bands with probability 3e-6, and fails
the estimate, five deviations below the limit, with 3e-7.

Nulls: a null or blank text has an empty set, linked with nothing.  A row
without an id has no component and is kept.  Rows that share an id are one
document: it has a link if any of its texts has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import addressed, attached, bounded_batches, documents, forget, store, tidy
from cairn.llm.shingles import mix, pieces, shingle_sets

BUCKETS, MANTISSA = 256, 10
BAND_ROWS, BANDS = 6, 42
#: Sets below SMALL hash every shingle for every bucket; sets from LARGE on deal them out.  LARGE <= 0.8 * SMALL.
LARGE, SMALL = 512, 640
#: Rows and shingles of a bucket that are compared with as many others at once.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 600_000
#: Pairs of a hub that one task confirms.
LOT = 512
EMPTY = np.uint16(0xFFFF)

_U = np.uint64
_DRAWS = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, (2, BUCKETS), dtype=np.uint64) * _U(2) + _U(1)


def registers(least: np.ndarray) -> np.ndarray:
    """16-bit registers of 57-bit minima: leading zeros, then mantissa bits."""
    top = (least >> _U(4)).astype(np.float64)  # 53 bits: exact
    part, power = np.frexp(top)
    mantissa = np.where(top > 0, (part * 2 - 1) * (1 << MANTISSA), 0).astype(np.uint16)
    return ((53 - power).astype(np.uint16) << np.uint16(MANTISSA)) | mantissa


def sketch_small(sets: list[np.ndarray]) -> np.ndarray:
    """Registers where every bucket hashes every shingle; the sets aren't empty."""
    out = np.empty((len(sets), BUCKETS), np.uint64)
    at = 0
    while at < len(sets):
        end, n = at, 0
        while end < len(sets) and (end == at or n + len(sets[end]) <= 2048):
            n += len(sets[end])
            end += 1
        x = np.concatenate(sets[at:end])
        x = (x ^ (x >> _U(29)))[:, None] * _DRAWS[0] + _DRAWS[1]
        first = np.concatenate([[0], np.cumsum([len(s) for s in sets[at:end]])[:-1]])
        out[at:end] = np.minimum.reduceat(x, first, axis=0)
        at = end
    return registers(out >> _U(7))


def sketch_large(sets: list[np.ndarray]) -> np.ndarray:
    """Registers where a shingle's first eight bits choose its bucket; an empty bucket has ``EMPTY``."""
    out = np.full((len(sets), BUCKETS), EMPTY, np.uint16)
    for i, s in enumerate(sets):
        bucket = (s >> _U(56)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))  # sorted: a bucket's first hash is its least
        out[i, bucket[first]] = registers((s[first] << _U(8)) >> _U(7))
    return out


def near(percent: int) -> float:
    """The least estimate of a pair that is confirmed: five deviations below the limit."""
    return percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / BUCKETS) ** 0.5


def chance(ratio: np.ndarray) -> np.ndarray:
    """The probability that registers of unlike sets agree; ``ratio`` is that of their sizes."""
    return 0.169919487159739093975315012348 * 4 * ratio / (1 + ratio) ** 2 / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Similarity of each register row of a with each of b, less what chance collisions add."""
    used_a, used_b = a != EMPTY, b != EMPTY
    if len(a) * len(b) <= 1 << 12:
        same = (a[:, None, :] == b[None, :, :]).sum(2)
        neither = (~used_a[:, None, :] & ~used_b[None, :, :]).sum(2)
    else:
        same = np.zeros((len(a), len(b)), np.float32)
        neither = np.zeros((len(a), len(b)), np.float32)
        hollow = np.flatnonzero(~used_a.all(0) & ~used_b.all(0))
        for j in range(BUCKETS):
            same += a[:, j, None] == b[None, :, j]
        for j in hollow:
            neither += ~used_a[:, j, None] & ~used_b[None, :, j]
    more = chance(size_a[:, None] / size_b[None, :])
    return ((same - neither) / np.maximum(BUCKETS - neither, 1) - more) / (1 - more)


def estimate_pairs(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """estimate() of each register row of a with the same row of b."""
    neither = ((a == EMPTY) & (b == EMPTY)).sum(1)
    more = chance(size_a / size_b)
    return (((a == b).sum(1) - neither) / np.maximum(BUCKETS - neither, 1) - more) / (1 - more)


def _binary(rows: np.ndarray, keep: np.ndarray) -> list[bytes | None]:
    it = iter(rows)
    return [next(it).tobytes() if k else None for k in keep.tolist()]


def signed(texts: DataFrame, k: int, fold: bool, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n, two sums that identify the set, registers and the columns ``carry``; ``texts`` has doc_id, text and these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text"), fold):
                sets = shingle_sets(piece, k)
                n = np.array([len(s) for s in sets], np.int64)
                sums = [[int(mix(s ^ _U(c)).sum(dtype=np.uint64).astype(np.int64)) for s in sets] for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                small, large = (n > 0) & (n < SMALL), n >= LARGE
                regs = [f([s for s, x in zip(sets, own.tolist(), strict=True) if x]) if own.any() else [] for f, own in ((sketch_small, small), (sketch_large, large))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(piece.low, piece.high - piece.low), pa.array(n), pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64()), pa.array(_binary(regs[0], small), pa.binary()), pa.array(_binary(regs[1], large), pa.binary())]
                    + [batch.column(c).slice(piece.low, piece.high - piece.low) for c in carry],
                    names=["doc_id", "n", "s1", "s2", "small", "large", *carry],
                )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(tidy(run), f"doc_id {kind}, n long, s1 long, s2 long, small binary, large binary" + "".join(f", `{c}` {texts.schema[c].dataType.simpleString()}" for c in carry))


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        for column, kind in (("small", _U(0)), ("large", _U(1))):
            here = batch.filter(batch.column(column).is_valid())
            if not here.num_rows:
                continue
            regs = np.frombuffer(b"".join(here.column(column).to_pylist()), np.uint16).reshape(-1, BUCKETS)[:, : BANDS * BAND_ROWS].reshape(-1, BANDS, BAND_ROWS)
            key = np.zeros(regs.shape[:2], np.uint64)
            for j in range(BAND_ROWS):
                key = mix(key ^ regs[:, :, j].astype(np.uint64) ^ _U((j + 1) << 20))
            key = mix(key ^ salt[None, :] ^ (kind << _U(40)))
            filled = ~(regs == EMPTY).all(2)
            rep = np.repeat(np.arange(here.num_rows), BANDS).reshape(-1, BANDS)[filled]
            yield pa.RecordBatch.from_arrays([pa.array(key[filled].view(np.int64)), here.column("rep").take(pa.array(rep))], names=["key", "rep"])


def components(links: DataFrame, label: str = "component") -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the least node it is connected with.

    Large-star and small-star steps in turn (Kiveris et al. 2014), each stored
    in the shared folder, until nothing changes.
    """
    edges = store(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        last, edges = edges, store(small, label)
        forget(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = now


def _registers(column: pa.Array) -> np.ndarray:
    """Register rows of a binary column without nulls."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def _close(percent: int):
    """Keeps the pairs whose registers and sizes allow a link; rows are a, b and the registers and size of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = {x: batch.column(f"n_{x}").to_numpy(zero_copy_only=False).astype(np.float64) for x in "ab"}
            kept = np.zeros(batch.num_rows, bool)
            for kind in ("small", "large"):
                both = np.flatnonzero(np.asarray(batch.column(f"{kind}_a").is_valid()) & np.asarray(batch.column(f"{kind}_b").is_valid()))
                for low in range(0, len(both), 4096):
                    own = both[low : low + 4096]
                    regs = [_registers(batch.column(f"{kind}_{x}").take(pa.array(own))) for x in "ab"]
                    kept[own] |= estimate_pairs(*regs, size["a"][own], size["b"][own]) >= near(percent)
            kept &= 100 * np.minimum(size["a"], size["b"]) >= percent * np.maximum(size["a"], size["b"])
            yield batch.select(["a", "b"]).filter(pa.array(kept))

    return run


def _confirmed(k: int, fold: bool, percent: int):
    """Links of hubs' lots: rows are b, lot, tag, id, text; a lot's hub texts (tag 0) come before the others (tag 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, hubs = None, []
        for batch in batches:
            keys = list(zip(batch.column("b").to_pylist(), batch.column("lot").to_pylist(), strict=True))
            tags, ids, found = batch.column("tag").to_pylist(), batch.column("id").to_pylist(), []
            for piece in pieces(batch.column("text"), fold):
                for row, own in zip(range(piece.low, piece.high), shingle_sets(piece, k), strict=True):
                    if keys[row] != group:
                        group, hubs = keys[row], []
                    if not tags[row]:
                        hubs.append(own)
                        continue
                    for hub in hubs:
                        if 100 * min(len(own), len(hub)) >= percent * max(len(own), len(hub)):
                            both = len(np.intersect1d(own, hub, assume_unique=True))
                            if 100 * both >= percent * (len(own) + len(hub) - both) and both:
                                found.append(row)
                                break
            take = pa.array(found, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("b").take(take)], names=["a", "b"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, where: DataFrame, k: int, fold: bool, percent: int) -> DataFrame:
    """The pairs (a, b) that are links on their full sets; ``where`` has the file of each id's texts."""
    kind = pairs.schema["a"].dataType.simpleString()
    lots = pairs.groupBy("b").agg(F.count("*").alias("n")).select("b", F.ceil(F.col("n") / LOT).alias("lots"))
    dealt = store(pairs.join(lots, "b").withColumn("lot", F.pmod(F.xxhash64("a"), F.col("lots"))).select("a", "b", "lot"), "pairs")
    ids = dealt.select(F.col("a").alias("doc_id")).unionByName(dealt.select(F.col("b").alias("doc_id"))).distinct()
    own = attached(texts, store(where.join(ids, "doc_id", "left_semi").distinct(), "needed"), ["doc_id"], "left_semi")
    left = dealt.join(own.withColumnRenamed("doc_id", "a"), "a").select("b", "lot", F.lit(1).alias("tag"), F.col("a").alias("id"), "text")
    right = dealt.select("b", "lot").distinct().join(own.withColumnRenamed("doc_id", "b"), "b").select("b", "lot", F.lit(0).alias("tag"), F.col("b").alias("id"), "text")
    rows = left.unionByName(right).repartition("b", "lot").sortWithinPartitions("b", "lot", "tag")
    return rows.mapInArrow(tidy(_confirmed(k, fold, percent)), f"a {kind}, b {kind}").distinct()


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables in which no run of rows with equal keys (long columns) is cut off, and where these runs begin and end."""
    rest: pa.Table | None = None

    def cut(table: pa.Table) -> list[int]:
        values = np.stack([table[c].to_numpy() for c in keys], axis=1)
        return [0, *(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1).tolist(), table.num_rows]

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        at = cut(table)
        if len(at) > 2:
            yield table.slice(0, at[-2]), list(zip(at[:-2], at[1:-1], strict=True))
        rest = table.slice(at[-2])
    if rest is not None:
        yield rest, [(0, rest.num_rows)]


def _of_kind(table: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Registers of the rows that have some, and each row's place among these or -1."""
    valid = np.asarray(table[kind].is_valid())
    place = np.where(valid, np.cumsum(valid) - 1, -1)
    return _registers(table[kind].filter(pa.array(valid))), place


def _passing(percent: int):
    """The rows of two blocks of a bucket that have a partner which passes the estimate and isn't known to be connected.

    Two rows that share several buckets are looked at in the first of these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, runs in _runs(batches, ("key", "i", "j")):
            block, i, j, key = (table[c].to_numpy() for c in ("block", "i", "j", "key"))
            size = table["n"].to_numpy().astype(np.float64)
            label = table["label"].combine_chunks().dictionary_encode().indices.to_numpy()
            shared = [frozenset(x) for x in table["keys"].to_pylist()]
            hit = np.zeros(table.num_rows, bool)
            for kind in ("small", "large"):
                regs, place = _of_kind(table, kind)
                for low, high in runs:
                    own = np.arange(low, high)[place[low:high] >= 0]
                    left, right = own[block[own] == i[low]], own[block[own] == j[low]]
                    if len(own) < 2 or not len(left) or not len(right):
                        continue
                    for at in range(0, len(left), 256):
                        some = left[at : at + 256]
                        like = estimate(regs[place[some]], regs[place[right]], size[some], size[right]) >= near(percent)
                        like &= label[some][:, None] != label[right][None, :]
                        for x, y in zip(*np.nonzero(like), strict=True):
                            a, b = some[x], right[y]
                            if not (hit[a] and hit[b]) and min(shared[a] & shared[b]) == key[low]:
                                hit[a] = hit[b] = True
            yield from table.filter(pa.array(hit)).to_batches()

    return run


def _links(k: int, fold: bool, percent: int):
    """Links between the rows of two blocks of a bucket, as a forest over their labels; rows have key, i, j, block, rep, label, registers and text."""

    def forest(ids: list, labels: list, sets: list[np.ndarray], block: np.ndarray, regs: list[list[bytes | None]], across: bool) -> Iterator[tuple]:
        size = np.array([len(s) for s in sets], np.float64)
        first = {}
        up = [first.setdefault(x, i) for i, x in enumerate(labels)]

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for column in regs:
            own = np.array([i for i, r in enumerate(column) if r is not None], np.int64)
            left, right = (own[block[own] == 0], own[block[own] == 1]) if across else (own, own)
            if not len(left) or not len(right):
                continue
            table = {int(i): np.frombuffer(column[i], np.uint16) for i in own}
            for at in range(0, len(left), 256):
                rows = left[at : at + 256]
                like = estimate(np.stack([table[int(i)] for i in rows]), np.stack([table[int(i)] for i in right]), size[rows], size[right]) >= near(percent)
                if not across:
                    like &= right[None, :] > rows[:, None]
                for i, j in zip(*np.nonzero(like), strict=True):
                    a, b = int(rows[i]), int(right[j])
                    if root(a) == root(b) or 100 * min(size[a], size[b]) < percent * max(size[a], size[b]):
                        continue
                    both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    if 100 * both >= percent * (size[a] + size[b] - both):
                        up[root(a)] = root(b)
                        yield ids[a], ids[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, runs in _runs(batches, ("key", "i", "j")):
            sets = [own for piece in pieces(table["text"], fold) for own in shingle_sets(piece, k)]
            ids, labels, regs = table["rep"].to_pylist(), table["label"].to_pylist(), [table[c].to_pylist() for c in ("small", "large")]
            block, i, j = (table[c].to_numpy() for c in ("block", "i", "j"))
            found = [x for a, b in runs for x in forest(ids[a:b], labels[a:b], sets[a:b], (block[a:b] == j[a]).astype(np.int64), [r[a:b] for r in regs], i[a] != j[a])]
            if found:
                kind = table["rep"].type
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], kind), pa.array([y for _, y in found], kind)], names=["a", "b"])

    return run


def _rest(members: DataFrame, links: DataFrame, regs: DataFrame) -> DataFrame:
    """Rows of buckets whose rows, but the hub, are not all known to be connected, each with its label; two rows with one label are connected."""
    up = links.groupBy("a").agg(F.min("b").alias("hub"))
    higher = up.select(F.col("a").alias("hub"), F.col("hub").alias("top"))
    labels = store(up.join(higher, "hub", "left").select(F.col("a").alias("rep"), F.coalesce("top", "hub").alias("label")), "labels")
    others = store(members.where("rep <> hub").select("key", "rep").join(labels, "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("label")), "others")
    mixed = store(others.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key"), "mixed")
    rows = store(others.join(mixed, "key"), "mixed")
    lists = rows.groupBy("rep").agg(F.collect_set("key").alias("keys"))  # BANDS keys of each kind at most
    return store(rows.join(lists, "rep").join(regs, "rep"), "rest")


def near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, fold: bool = True, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and the columns ``carry`` for every row of ``df``."""
    bounded_batches(df.sparkSession)
    full = addressed(df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), *carry))
    texts = full.select("doc_id", "text")
    kind = full.schema["doc_id"].dataType.simpleString()
    rows = store(signed(full, k, fold, tuple(dict.fromkeys(("_file", *carry)))), "sketch")
    filled = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = store(filled.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    regs = filled.select("s1", "s2", "n", F.col("doc_id").alias("rep"), "small", "large").join(classes, ["s1", "s2", "n", "rep"], "left_semi")
    regs = store(regs.dropDuplicates(["rep", "s1", "s2", "n"]).select("rep", "n", "small", "large"), "registers")
    where = filled.select("doc_id", "_file")

    keys = regs.select("rep", "small", "large").mapInArrow(tidy(_bands), f"key long, rep {kind}")
    shared = store(keys.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("far")).where("hub <> far").select("key", "hub"), "shared")
    members = store(keys.join(shared, "key").select("key", "rep", "hub"), "members")
    stars = members.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    sided = lambda x: regs.select(F.col("rep").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "small", "large")])
    close = stars.join(sided("a"), "a").join(sided("b"), "b").mapInArrow(tidy(_close(percent)), f"a {kind}, b {kind}").distinct()
    links = store(confirmed(store(close, "close"), texts, where, k, fold, percent), "links")

    rest = _rest(members, links, regs)
    if not rest.isEmpty():
        blocks = rest.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
        dealt = rest.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
        pair = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j"))))
        together = lambda x: x.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")
        dealt = dealt.withColumn("pair", pair).select("key", "pair.i", "pair.j", "block", "rep", "label", "keys", "n", "small", "large")
        passing = store(together(dealt).mapInArrow(tidy(_passing(percent)), dealt.schema), "passing")
        passing = passing.drop("keys")
        own = attached(texts, store(where.join(passing.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").distinct(), "needed"), ["doc_id"], "left_semi")
        carried = together(passing.join(own.withColumnRenamed("doc_id", "rep"), "rep"))
        links = links.unionByName(carried.mapInArrow(tidy(_links(k, fold, percent)), f"a {kind}, b {kind}"))
    found = components(links, "component").withColumnRenamed("node", "rep")
    classed = rows.select("doc_id", "n", "s1", "s2", *carry).join(classes, ["s1", "s2", "n"], "left")
    joined = classed.join(found, "rep", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), *carry)


def op9_hyperminhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at four words and 0.8."""
    return near_duplicates(documents(spark, sf_dir), k=4, percent=80)
