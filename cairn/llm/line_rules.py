"""Quality rules with cross-document line frequency (operator 8).

Lines are normalised (lower case, digits to 0, white space collapsed), hashed,
and counted per host over the distinct documents that hold them.  Lines in more
than ``LEAST_DOCUMENTS`` documents and ``LINE_PERCENT`` percent of a host's documents
are removed, so small and large hosts are judged alike; a document that keeps
fewer than ``KEEP_SHARE`` of its words is depleted and rejected.

The host is the source; a null source is a host of its own.  A null text has no
words.  Each row is a document, so repeated rows count and are judged each by
itself.  Two 32- and 64-bit hashes together stand for a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import SPACES, documents, store

SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
#: A line may stand in so many documents of a host, and in this percentage of them.
LEAST_DOCUMENTS, LINE_PERCENT = 20, 10
KEEP_SHARE = 0.5


def split_words(text: Column) -> Column:
    """The words of a text, by splitting at single blanks after translating white space."""
    return F.filter(F.split(F.translate(text, SPACES[1:], " " * (len(SPACES) - 1)), " "), lambda w: w != "")


def base(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """Per row: the counts of the text and its lines as (hash, hash, words)."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), body.alias("body"))
    rows = rows.withColumn("words", split_words(F.col("body")))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    # Each word is hashed once; hashes of 2, 4 and 8 words are made of two of the last.
    rows = rows.withColumn("grams", F.transform("words", lambda w: F.xxhash64(w)))
    for wide in (1, 2, 4):
        later = F.slice("grams", wide + 1, F.greatest(F.size("grams") - wide, F.lit(0)))
        rows = rows.withColumn("grams", F.zip_with("grams", later, lambda a, b: F.xxhash64(a, b)))
    rows = rows.withColumn("grams", F.slice("grams", 1, F.greatest(F.size("grams") - (WINDOW - 1), F.lit(0))))
    rows = rows.withColumn("twice", F.size(F.array_distinct("grams")) < F.size("grams"))
    # Starts of repeated windows, by sorting (hash, start) and comparing neighbours; only where there are any.
    pairs = F.array_sort(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("pairs", F.when(F.col("twice"), pairs))
    same = lambda k: F.coalesce(F.get("pairs", k)["h"] == F.get("pairs", k + 1)["h"], F.lit(False))
    starts = F.array_sort(F.transform(F.filter("pairs", lambda x, k: same(k) | ((k > 0) & same(k - 1))), lambda x: x["i"]))
    rows = rows.withColumn("starts", F.when(F.col("twice"), starts))
    covered = F.aggregate(F.transform("starts", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, b: a + b)
    lines = F.filter(F.split("body", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    rows = rows.withColumn("lines", lines)
    normal = lambda x: F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, "[0-9]+", "0"), r"[\x20\x09-\x0D]+", " ")))
    hashed = lambda x: F.struct(F.xxhash64(x).alias("h"), F.hash(x).alias("g"), F.size(F.split(x, " ")).alias("n"))
    return rows.select(
        "doc_id",
        "source",
        "n_words",
        F.length(F.translate("body", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("twice"), covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.transform("lines", lambda x: hashed(normal(x))).alias("lines"),
        F.monotonically_increasing_id().alias("row"),
    )


def judge(rows: DataFrame, least: int = LEAST_DOCUMENTS, percent: int = LINE_PERCENT, share: float = KEEP_SHARE) -> DataFrame:
    """Add n_removed_lines, n_removed_words, base_failed and kept; ``rows`` is base()'s table, stored."""
    host = F.col("source")
    each = rows.select("row", host, F.explode(F.array_distinct("lines")).alias("line")).select("row", "source", "line.h", "line.g")
    counts = each.groupBy("source", "h", "g").agg(F.count("*").alias("docs")).where(F.col("docs") > least).select(F.col("source").alias("f_source"), F.col("h").alias("f_h"), F.col("g").alias("f_g"), "docs")
    hosts = rows.groupBy("source").agg(F.count("*").alias("all"))
    frequent = counts.join(hosts, F.col("f_source").eqNullSafe(F.col("source"))).where(100 * F.col("docs") > percent * F.col("all")).select("f_source", "f_h", "f_g")
    # Stored, so that both sides of the join are shuffles that adaptive execution can split where a line is very common.
    frequent = store(frequent, "frequent")
    held = rows.select("row", host, F.explode("lines").alias("line")).select("row", "source", "line.h", "line.g", "line.n")
    removed = (
        held.join(frequent, (F.col("h") == F.col("f_h")) & (F.col("g") == F.col("f_g")) & F.col("source").eqNullSafe(F.col("f_source")))
        .groupBy("row").agg(F.count("*").alias("n_removed_lines"), F.sum("n").alias("n_removed_words"))
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    gone = F.coalesce("n_removed_words", F.lit(0)).cast("long")
    depleted = F.col("n_words") - gone < F.lit(share) * F.col("n_words")
    return rows.join(removed, "row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"),
        F.coalesce("n_removed_lines", F.lit(0)).cast("long").alias("n_removed_lines"), gone.alias("n_removed_words"),
    )


def op8_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by the rules."""
    return judge(store(base(documents(spark, sf_dir)), "lines"))


def sql_op8() -> str:
    """The same rows in DuckDB SQL."""
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '{word}') AS words FROM documents),
grams AS (SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM docs)),
starts AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS later FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM grams) WHERE c > 1),
covered AS (SELECT doc_id, sum(least({WINDOW}, coalesce(later - i, {WINDOW}))) AS n FROM starts GROUP BY doc_id),
lines AS (SELECT doc_id, source, line, lower(trim(regexp_replace(regexp_replace(line, '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm
  FROM (SELECT doc_id, source, unnest(string_split(body, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '{word}')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
hosts AS (SELECT source, count(*) AS n FROM docs GROUP BY source),
frequent AS (SELECT l.source, l.norm FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source GROUP BY l.source, l.norm HAVING count(DISTINCT l.doc_id) > {LEAST_DOCUMENTS} AND 100 * count(DISTINCT l.doc_id) > {LINE_PERCENT} * any_value(h.n)),
removed AS (SELECT doc_id, count(*) AS k, sum(len(string_split(l.norm, ' '))) AS n FROM lines l JOIN frequent f ON l.norm = f.norm AND l.source IS NOT DISTINCT FROM f.source GROUP BY doc_id),
counted AS (SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(p.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(r.k, 0) AS BIGINT) AS n_removed_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed_words
  FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN dup p USING (doc_id) LEFT JOIN removed r USING (doc_id)),
judged AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - n_removed_words >= {KEEP_SHARE} * n_words AS kept, n_removed_lines, n_removed_words FROM judged"""
