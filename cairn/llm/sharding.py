"""Sharding by a hierarchical weighted hash tree (operator 1).

A tree has regions, racks and shards.  A key descends it: at every node each
child draws ``-ln(u) / weight`` from a hash of (child's name, key), and the
smallest draw wins (the "straw" draw of CRUSH, Weil et al. 2006).  A child's
draw depends on its own name and weight alone, so a change of weights moves keys
only into or out of the subtrees whose weights changed.

Nulls: a null key is a key like any other; a null text has no bytes.  Repeated
rows get slots of their own.  Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import documents, hex_long, running_total

SHARDS = 24
REGION_SHARDS, RACK_SHARDS = 8, 4
#: Each shard is numbered in this many independent parts.
SLOT_BUCKETS = 256


@dataclass(frozen=True)
class Leaf:
    """A shard, its place in the tree and its weight."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def planned_tree(shards: int, planned: int = SHARDS) -> list[Leaf]:
    """A tree of ``shards`` equal shards: those up to ``planned`` fill regions and racks,
    and each one added later is a region of its own, so that it takes keys only into itself."""
    leaves = [Leaf(f"r{s // REGION_SHARDS}", f"k{s % REGION_SHARDS // RACK_SHARDS}", s) for s in range(min(shards, planned))]
    return leaves + [Leaf(f"r+{s}", "k0", s) for s in range(planned, shards)]


def _levels(tree: list[Leaf]) -> list[tuple[str, list[tuple[str, float, int]]]]:
    """Nodes with their children (name, weight, index of the child's node, or of its shard below)."""
    if not tree or any(x.weight <= 0 for x in tree) or len({x.shard for x in tree}) < len(tree):
        raise ValueError("a tree needs distinct shards of positive weight")
    kids: dict[str, dict[str, float]] = {"": {}}
    shard_of = {}
    for x in tree:
        rack, leaf = f"{x.region}/{x.rack}", f"{x.region}/{x.rack}/{x.shard}"
        shard_of[leaf] = x.shard
        for parent, child in (("", x.region), (x.region, rack), (rack, leaf)):
            own = kids.setdefault(parent, {})
            own[child] = own.get(child, 0.0) + x.weight
    index = {name: i for i, name in enumerate(kids)}
    return [(name, [(c, w, index.get(c, shard_of.get(c, -1))) for c, w in own.items()]) for name, own in kids.items()]


def place(key: Column, tree: list[Leaf]) -> Column:
    """The shard (int) of ``key`` in ``tree``."""
    nodes = F.array(*[F.array(*[F.struct(F.lit(c).alias("name"), F.lit(float(w)).alias("weight"), F.lit(i).alias("to")) for c, w, i in own]) for _, own in _levels(tree)])
    text = F.coalesce(key.cast("string"), F.lit("null"))

    def step(node: Column) -> Column:
        def draw(child: Column) -> Column:
            u = (hex_long(F.concat(child["name"], F.lit(":"), text)) + F.lit(0.5)) / F.lit(float(1 << 52))
            return F.struct((-F.log(u) / child["weight"]).alias("draw"), child["to"].alias("to"))

        return F.array_min(F.transform(F.element_at(nodes, node + 1), draw))["to"]

    return step(step(step(F.lit(0)))).cast("int")


def assign(df: DataFrame, tree: list[Leaf], key: str = "doc_id", text: str = "text", grown: list[Leaf] | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot, grown_shard and the columns to ``carry``."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(
        F.col(key),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        place(F.col(key), tree).alias("shard"),
        (place(F.col(key), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        *[F.col(c).alias(f"_carried_{i}") for i, c in enumerate(carry)],
    )
    spread = hex_long(F.concat(F.lit("slot:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))), 4)
    out = running_total(rows, ["shard"], [F.col(key), F.col("text_crc32"), F.col("size")], F.lit(1), spread, SLOT_BUCKETS, "slot")
    return out.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard", *[F.col(f"_carried_{i}").alias(c) for i, c in enumerate(carry)])


def op1_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 24 shards, and where each goes when a 25th is added."""
    return assign(documents(spark, sf_dir), planned_tree(SHARDS), grown=planned_tree(SHARDS + 1))


def _sql_tree(shards: int) -> str:
    rows = [(parent, name, w, to) for parent, own in _levels(planned_tree(shards)) for name, w, to in own]
    return ", ".join(f"('{p}', '{n}', {w}, {to})" for p, n, w, to in rows)


def _sql_descent(name: str, shards: int) -> str:
    draw = "-ln((('0x' || substr(md5(t.name || ':' || coalesce(CAST(k.doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / t.weight"
    steps, at = [f"{name}_t(parent, name, weight, shard) AS (VALUES {_sql_tree(shards)})"], f"(SELECT doc_id, '' AS node, 0 AS shard FROM keys)"
    for level in range(3):
        steps.append(f"{name}_{level} AS (SELECT k.doc_id, arg_min(t.name, {draw}) AS node, arg_min(t.shard, {draw}) AS shard FROM {at} k JOIN {name}_t t ON t.parent = k.node GROUP BY k.doc_id)")
        at = f"{name}_{level}"
    return ", ".join(steps)


#: CRC-32 of the UTF-8 bytes, byte by byte with the table of the reflected polynomial.
_SQL_CRC = """crc_table AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce([b] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b)))"""


def sql_op1() -> str:
    """The same rows in DuckDB SQL."""
    byte = "(('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2))::BIGINT)"
    return f"""
WITH keys AS (SELECT DISTINCT doc_id FROM documents), {_sql_descent('now', SHARDS)}, {_sql_descent('later', SHARDS + 1)}, {_SQL_CRC},
hexed AS (SELECT doc_id, coalesce(text, '') AS body, hex(encode(coalesce(text, ''))) AS h FROM documents),
crcs AS (SELECT doc_id, strlen(body) + 8 AS size,
  xor(4294967295, list_reduce([4294967295] || list_transform(range(strlen(body)), lambda i: {byte}), lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)]))) AS text_crc32
  FROM hexed, crc_table)
SELECT c.doc_id, CAST(c.size AS BIGINT) AS size, CAST(c.text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(n.shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY n.shard ORDER BY ('0x' || substr(md5('slot:' || CAST(c.doc_id AS VARCHAR)), 1, 4))::BIGINT % {SLOT_BUCKETS}, c.doc_id) - 1 AS slot,
  CAST(l.shard AS INTEGER) AS grown_shard
FROM crcs c JOIN now_2 n USING (doc_id) JOIN later_2 l USING (doc_id)"""
