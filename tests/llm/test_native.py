"""Sharding, mixing and line rules against SQL and brute force."""

import math
import os
import random
import zlib
from collections import Counter
from hashlib import md5

import duckdb
import pytest
from pyspark.sql import functions as F

from cairn.llm import line_rules, mixing, sharding
from cairn.llm.common import store


def same(df, sql, **tables):
    """Whether a result has exactly the rows of DuckDB's."""
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table.toPandas())
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    want = sorted(map(repr, found.fetchall()))
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == want


def docs(spark, rows):
    """A documents table."""
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_tree(spark):
    """Placement equals a plain descent; growth moves keys only into the new shard; weights draw their share."""
    tree, grown = sharding.planned_tree(24), sharding.planned_tree(25)
    df = spark.range(3000).select("id", sharding.place(F.col("id"), tree).alias("a"), sharding.place(F.col("id"), grown).alias("b")).collect()
    children = dict(sharding._levels(tree))

    def descend(key):
        node = ""
        for _ in range(3):
            draw = lambda c, key=key: -math.log((int(md5(f"{c[0]}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / c[1]
            node, _, to = min(children[node], key=draw)
        return to

    assert all(r.a == descend(r.id) for r in df[:200])
    assert all(r.b in (r.a, 24) for r in df) and 60 < sum(r.b == 24 for r in df) < 190
    heavy = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 0 else 1.0) for x in tree]
    moved = spark.range(3000).select(sharding.place(F.col("id"), tree).alias("a"), sharding.place(F.col("id"), heavy).alias("b")).where("a <> b").collect()
    # Only into subtrees whose weight changed: region 0, its rack 0, or shard 0.
    assert moved and all(r.b // 8 == 0 and (r.a // 8 != 0 or (r.b // 4 == 0 and (r.a // 4 != 0 or r.b == 0))) for r in moved)
    with pytest.raises(ValueError):
        sharding.place(F.lit(1), [])


def test_assign(spark, awkward, empty):
    """Sizes, checksums and gapless slots for awkward rows."""
    got = sharding.assign(awkward, sharding.planned_tree(24), grown=sharding.planned_tree(25)).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in awkward.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(empty, sharding.planned_tree(3)).count() == 0


def test_mix(spark, awkward, empty):
    """Equal to SQL; targets, limits and reruns hold; awkward rows have results."""
    rows = [(i, " ".join(["w"] * (i % 97)), ("a", "b", "c", None, "e")[i % 5 if i % 3 else 0]) for i in range(400)]
    df = docs(spark, rows)
    first = mixing.mix(store(mixing.measured(df), "t"))
    same(first, mixing.sql_op4(), documents=df)
    got = first.collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(store(mixing.measured(df.repartition(3)), "t")).collect()))
    assert all(r.taken <= 2 * r["size"] for r in got)
    total, taken = sum(r["size"] for r in got), sum(r.taken for r in got)
    assert abs(taken - 1.5 * total) <= 0.03 * total
    odd = mixing.mix(store(mixing.measured(awkward), "t")).collect()
    assert len(odd) == 13 and all(r.taken == 0 for r in odd if r["size"] == 0)
    assert mixing.mix(store(mixing.measured(empty), "t")).count() == 0


def test_wide_parts(spark):
    """Documents at any place of a part of 1e12 words and more take what whole numbers say."""
    rng = random.Random(5)
    rows = []
    for words in (10**12 + 7, 4 * 10**10, 10**15 + 1, mixing.STRIDE * 3 * mixing.BLOCK):
        n = round(words / mixing.BLOCK)
        for _ in range(6):
            rows.append((rng.randrange(words - 3000), rng.randrange(1, 3000), words, n, rng.randrange(2 * n), rng.randrange(n)))
    df = spark.createDataFrame(rows, "begin long, size long, words long, n long, q long, offset long")
    got = df.select("*", mixing.words_taken(*map(F.col, df.columns)).alias("taken")).collect()
    for r in got:
        stride = mixing.OTHER_STRIDE if r.n % mixing.STRIDE == 0 else mixing.STRIDE
        want, end = r["size"] * (r.q // r.n), r.begin + r["size"]
        for b in range(r.begin * r.n // r.words - 1, end * r.n // r.words + 2):
            if 0 <= b < r.n and (stride * b + r.offset) % r.n < r.q % r.n:
                want += max(0, min(end, (b + 1) * r.words // r.n) - max(r.begin, b * r.words // r.n))
        assert r.taken == want


def test_seats(spark):
    """Sainte-Lague by highest quotients, one after the other."""
    quotas = [10.4, 3.3, 0.2, 7.6, 1.5, 2.5, 5.5]
    parts = spark.createDataFrame([(i, 0, q, 100) for i, q in enumerate(quotas)], "place int, shard int, quota double, n long")
    got = {r.place: r.q for r in mixing.seats(parts).collect()}
    want = Counter()
    for _ in range(round(sum(quotas))):
        want[max(range(len(quotas)), key=lambda i: (quotas[i] / (2 * want[i] + 1), -i))] += 1
    assert got == {i: want[i] for i in range(len(quotas))}


def test_line_rules(spark, awkward, empty):
    """Equal to SQL, with lines above the limits; depleted documents go, and hosts of any size are judged alike."""
    common = "subscribe to our letter 12 today and every other day of the week, all of you who read this\n"
    body = lambda i: " ".join(f"w{chr(97 + i % 26)}x{chr(97 + j)}{i}" for j in range(25))
    rows = [(i, common.replace("12", str(i)) + body(i) * (i % 2), "s" if i < 30 else None) for i in range(60)]
    rows += [(100, "a b c d e f g h " * 5, "s"), (101, "x\nx\n \nx", "t"), (102, None, "t"), (103, body(1) + "\n" + body(1), "t"), (104, "# $ & " + body(3), "t")]
    # In a large host the line stands in 25 of 300 documents: more than the least number, less than the share.
    rows += [(1000 + i, (common if i < 25 else "") + body(i), "large") for i in range(300)]
    df = docs(spark, rows)
    got = line_rules.judge(store(line_rules.base(df), "t"))
    same(got, line_rules.sql_op8(), documents=df)
    kept = {r.doc_id: (r.kept, r.n_removed_lines) for r in got.collect()}
    assert kept[1] == (True, 1) and kept[2] == (False, 1) and kept[41] == (True, 1) and kept[100][0] is False and kept[104] == (True, 0)
    assert all(kept[1000 + i] == (True, 0) for i in range(300))
    odd = line_rules.judge(store(line_rules.base(awkward), "t")).collect()
    assert len(odd) == 13 and all(not r.kept for r in odd if r.n_words == 0)
    assert line_rules.judge(store(line_rules.base(empty), "t")).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_sql(spark):
    """The queries equal their SQL on the smallest tables."""
    d = "/root/testdata/sf0.001"
    full = {"documents": spark.read.parquet(f"{d}/documents.parquet")}
    same(mixing.op4_sainte_lague_mix(spark, d), mixing.sql_op4(), **full)
    same(line_rules.op8_line_frequency_rules(spark, d), line_rules.sql_op8(), **full)
    same(sharding.op1_hash_tree_sharding(spark, d), sharding.sql_op1(), **full)
