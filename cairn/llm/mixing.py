"""Mixing sources to target weights by Sainte-Lague apportionment (operator 4).

The size of a document is its number of words.  Every source's documents stand
in a seeded order in each of ``SHARDS`` parts; a part of a source is cut into
equal blocks of about ``BLOCK`` words.  Blocks are seats: the highest quotients
``quota / (2k + 1)`` of all (source, shard) parts get them, which makes integer
quotas.  A part with n blocks and q seats takes every block q // n times, and
q % n blocks, chosen by a seeded permutation, once more.  Since a target is at
most twice its source's size, no part gets more than 2n seats and no word is
taken more than twice.  Products of word and block numbers are decimals, so parts
of more words than a long's root don't overflow.

Nulls: a null text has size 0; the null source is a source, last in order; a
null doc_id is an id like any other.  Repeated rows each stand in the order.
Tables with one row per source or per (source, shard) are small by the nature of
a mix; windows without a partition run over these alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import WORD, documents, hex_long, running_total, store

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK = 128
SHARDS = 16
ORDER_BUCKETS = 64
SEED = "mix-1"
#: Primes: multiplying by one that doesn't divide a part's number of blocks permutes the blocks.
STRIDE, OTHER_STRIDE = 2147483629, 2147483587
#: Products of word and block numbers: parts may hold 1e15 words and more.
_WIDE = "decimal(19,0)"


def measured(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, shard, seeded order and the columns ``carry`` of every row; the only pass over the texts."""
    rank = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col(key).cast("string"), F.lit("null"))).cast("binary"))
    return df.select(
        F.col(key).alias("doc_id"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(-1)).alias("crc"),
        rank.alias("rank"),
        *carry,
    ).withColumn("shard", F.pmod(F.conv(F.substring("rank", 1, 4), 16, 10).cast("long"), F.lit(SHARDS)).cast("int"))


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source: place, source_size and target.

    Targets share ``SHARE`` of all words by weight, each at most ``MOST`` times
    its source's size; the level of the rest follows from sorting by the ratio
    of limit to weight, below which sources are full.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    own = own.withColumn("place", place).withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("place") % len(WEIGHTS) + 1).cast("double")).withColumn("most", (F.lit(MOST) * F.col("source_size")).cast("double"))
    by_ratio = Window.orderBy(F.col("most") / F.col("w"), "place")
    full = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    all_words = F.sum("source_size").over(Window.partitionBy())
    levels = own.withColumn("level", (F.lit(SHARE) * all_words - full) / rest)
    level = F.max(F.when(F.col("most") > F.col("w") * F.col("level"), F.col("level"))).over(Window.partitionBy())
    return levels.withColumn("level", level).select("source", "place", "source_size", F.coalesce(F.least("most", F.col("w") * F.col("level")), F.col("most")).alias("target"))


def seats(parts: DataFrame) -> DataFrame:
    """Add q, the blocks each part takes, by Sainte-Lague; parts has quota and n.

    Rounding every quota to the nearest integer is the apportionment of some
    number of seats.  As the method only ever adds seats when the house grows,
    the house wanted is |difference| steps up or down from there, and each part
    can change by no more steps than that.
    """
    parts = parts.withColumn("near", F.least(F.floor(F.col("quota") + 0.5), F.lit(MOST) * F.col("n")).cast("long"))
    parts = parts.withColumn("gap", (F.round(F.sum("quota").over(Window.partitionBy())) - F.sum("near").over(Window.partitionBy())).cast("long"))
    up, down = F.col("gap") > 0, F.col("gap") < 0
    steps = (
        parts.where(up | down)
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.abs("gap"))))
        .withColumn("seat", F.when(up, F.col("near") + F.col("step") - 1).otherwise(F.col("near") - F.col("step")))
        .where((F.col("seat") >= 0) & (down | (F.col("seat") < F.lit(MOST) * F.col("n"))))
        .withColumn("quotient", F.col("quota") / (2 * F.col("seat") + 1))
    )
    # Of equal quotients the earlier part has its seat first, and loses it last.
    turn = lambda c: F.when(up, F.col(c)).otherwise(-F.col(c))
    first = Window.orderBy(-turn("quotient"), turn("place"), turn("shard"))
    moved = steps.withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= F.abs("gap")).groupBy("place", "shard").agg(F.sum(F.signum("gap")).cast("long").alias("moved"))
    return parts.join(moved, ["place", "shard"], "left").withColumn("q", F.col("near") + F.coalesce("moved", F.lit(0))).drop("near", "gap", "moved")


def _share(a: Column, b: Column, c: Column) -> Column:
    """a * b // c of whole numbers whose product may be beyond a long."""
    return F.call_function("div", a.cast(_WIDE) * b.cast(_WIDE), c.cast(_WIDE)).cast("long")


def words_taken(begin: Column, size: Column, words: Column, n: Column, q: Column, offset: Column) -> Column:
    """Words taken of a document that stands at ``begin`` in a part of ``words`` words and ``n`` blocks, of which ``q`` are taken."""
    end = begin + size
    stride = F.when(n % F.lit(STRIDE) == 0, F.lit(OTHER_STRIDE)).otherwise(F.lit(STRIDE))

    def add(total: Column, block: Column) -> Column:
        place = F.pmod(stride.cast(_WIDE) * block.cast(_WIDE) + offset, n.cast(_WIDE)).cast("long")
        held = F.greatest(F.least(end, _share(block + 1, words, n)) - F.greatest(begin, _share(block, words, n)), F.lit(0))
        return total + F.when(place < q % n, held).otherwise(F.lit(0)).cast("long")

    first = F.greatest(_share(begin, n, words) - 1, F.lit(0).cast("long"))
    last = F.least(_share(end, n, words) + 1, n - 1)
    return size * F.floor(q / n) + F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), add)


def mix(sizes: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken and the columns ``carry`` for every row of ``measured``'s table."""
    # Both small tables are used more than once, so each is computed by itself and stored.
    goal = store(targets(sizes), "targets")
    rows = sizes.join(F.broadcast(goal), sizes["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    parts = sizes.groupBy("source", "shard").agg(F.sum("size").alias("words"))
    parts = parts.join(F.broadcast(goal), parts["source"].eqNullSafe(goal["source"])).drop("source").where("words > 0")
    parts = parts.withColumn("n", F.greatest(F.round(F.col("words") / BLOCK), F.lit(1)).cast("long")).withColumn("quota", F.col("n") * F.col("target") / F.col("source_size"))
    offset = hex_long(F.concat(F.lit(SEED + ":"), F.col("place"), F.lit(":"), F.col("shard")), 8)
    parts = seats(store(parts, "parts")).select("place", "shard", "words", "n", "q", (offset % F.col("n")).alias("offset"))
    parts = store(parts, "seats")
    rows = running_total(rows, ["place", "shard"], [F.col("rank"), F.col("doc_id"), F.col("size"), F.col("crc")], F.col("size"), F.conv(F.substring("rank", 5, 4), 16, 10).cast("long"), ORDER_BUCKETS, "begin")
    rows = rows.join(F.broadcast(parts), ["place", "shard"], "left")
    taken = F.when(F.col("size") > 0, words_taken(*map(F.col, ("begin", "size", "words", "n", "q", "offset")))).otherwise(F.lit(0)).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *carry)


def op4_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix(store(measured(documents(spark, sf_dir)), "mix"))


def sql_op4() -> str:
    """The same rows in DuckDB SQL."""
    return f"""
WITH sizes AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
    md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS rank FROM documents),
placed AS (SELECT *, CAST(('0x' || substr(rank, 1, 4))::BIGINT % {SHARDS} AS INTEGER) AS shard, ('0x' || substr(rank, 5, 4))::BIGINT % {ORDER_BUCKETS} AS bucket FROM sizes),
own AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM sizes GROUP BY source),
weighed AS (SELECT *, CAST([3, 1, 2][place % 3 + 1] AS DOUBLE) AS w, CAST({MOST} * source_size AS DOUBLE) AS most FROM own),
levels AS (SELECT *, ({SHARE} * (sum(source_size) OVER ()) - coalesce(sum(most) OVER (ORDER BY most / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY most / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
goal AS (SELECT source, place, source_size, coalesce(least(most, w * (SELECT max(level) FROM levels WHERE most > w * level)), most) AS target FROM levels),
parts AS (SELECT g.place, p.shard, CAST(sum(p.size) AS BIGINT) AS words, any_value(g.source_size) AS source_size, any_value(g.target) AS target FROM placed p JOIN goal g ON p.source IS NOT DISTINCT FROM g.source GROUP BY 1, 2 HAVING sum(p.size) > 0),
quotas AS (SELECT *, n * target / source_size AS quota FROM (SELECT *, CAST(greatest(round(words / {BLOCK}), 1) AS BIGINT) AS n FROM parts)),
house AS (SELECT CAST(round(sum(quota)) AS BIGINT) AS seats FROM quotas),
quotients AS (SELECT place, shard, quota / (2 * seat + 1) AS quotient FROM (SELECT *, unnest(range({MOST} * n)) AS seat FROM quotas)),
won AS (SELECT place, shard, count(*) AS q FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, place, shard) AS turn FROM quotients) WHERE turn <= (SELECT seats FROM house) GROUP BY 1, 2),
ruled AS (SELECT k.place, k.shard, k.words, k.n, coalesce(o.q, 0) AS q, ('0x' || substr(md5('{SEED}:' || k.place || ':' || k.shard), 1, 8))::BIGINT % k.n AS "offset" FROM quotas k LEFT JOIN won o USING (place, shard)),
blocks AS (SELECT *, b * words // n AS low, (b + 1) * words // n AS high, q // n + CAST(({STRIDE} * b + "offset") % n < q % n AS BIGINT) AS times FROM (SELECT *, unnest(range(n)) AS b FROM ruled)),
spans AS (SELECT p.doc_id, p.size, g.place, p.shard, g.source_size, g.target, coalesce(sum(p.size) OVER (PARTITION BY g.place, p.shard ORDER BY p.bucket, p.rank, p.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM placed p JOIN goal g ON p.source IS NOT DISTINCT FROM g.source)
SELECT s.doc_id, any_value(s.size) AS size, any_value(s.source_size) AS source_size, any_value(s.target) AS target,
  CAST(coalesce(sum(greatest(least(s.start + s.size, b.high) - greatest(s.start, b.low), 0) * b.times), 0) AS BIGINT) AS taken
FROM spans s LEFT JOIN blocks b ON b.place = s.place AND b.shard = s.shard AND b.low < s.start + s.size AND b.high > s.start GROUP BY s.doc_id"""
