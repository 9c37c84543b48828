"""A corpus pipeline: language, near-duplicates, contamination, mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes to the shared folder and reads back as the next stage's documents.  All
but the last return the columns of ``documents``.

Nulls: a row without an id passes every filter that goes by id; a null text has
no language and leaves at the first stage.  Repeated rows with one id leave the
second stage as one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontaminate, language, mixing, near_dup, sharding
from cairn.llm.common import addressed, attached, documents, hex_long, store

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Where a row is read from; verdicts go back to texts by it, so that no text is shuffled for them.
ADDRESS = ("_file", "_row")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose text is in one of the languages learnt."""
    rows = addressed(docs)
    judged = language.of_documents(rows, ADDRESS)
    return attached(rows, store(judged.where("NOT language_kept").select(*ADDRESS), "rejected"), list(ADDRESS), "left_anti").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, at five words and 0.8, and one row of each id."""
    rows = addressed(docs)
    judged = store(near_dup.near_duplicates(rows, carry=ADDRESS).where("doc_id IS NOT NULL"), "judged")
    first = judged.groupBy("doc_id").agg(F.min(F.xxhash64("_file", "_row")).alias("first"))
    dropped = judged.join(first, "doc_id").where(~F.col("kept") | (F.xxhash64("_file", "_row") != F.col("first")))
    return attached(rows, store(dropped.select(*ADDRESS), "dropped"), list(ADDRESS), "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    found = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("leaks") == 0).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: whole copies, the rest of a copy by a seeded draw."""
    rows = addressed(docs)
    taken = mixing.mix(store(mixing.measured(rows, carry=ADDRESS), "mix"), ADDRESS)
    draw = hex_long(F.concat(F.lit("copy:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 8) / F.lit(float(1 << 32))
    copies = taken.where("size > 0").select(*ADDRESS, F.floor(F.col("taken") / F.col("size") + draw).cast("int").alias("copies")).where("copies > 0")
    found = attached(rows, store(copies, "copies"), list(ADDRESS))
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard and its slot there."""
    out = sharding.assign(docs, sharding.planned_tree(sharding.SHARDS), carry=COLUMNS[1:])
    return out.select(*COLUMNS, "size", "shard", "slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix", mix),
    ("shard", shard),
]

#: Stages 1 to 3 learn models or compare sets, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
