"""Language identification by Bayesian evidence fusion (operator 2).

For each language the log probability adds up from

* the text: byte trigrams under a multinomial model per language, learnt from
  ``SAMPLE`` rows of each declared language, chosen by hash, or all if there are
  fewer; languages whose rows hold no trigram are not listed.  Trigrams of one
  text depend on each other, so their sum counts as that of ``EFFECTIVE`` at most;
* the declared language (a markup attribute or a column): how often rows of each
  text language declare it, counted over all rows and smoothed;
* the address suffix: likewise;
* the host: its languages counted over all rows, smoothed towards those of its
  domain, and these towards all rows'.

Evidence that a row lacks adds nothing.  A row is kept if its text is not much
likelier as random bytes (``LEAST_TEXT``) than in the best language, and that
language is accepted and has a posterior of at least ``CONFIDENCE``.

Nulls: a null, blank or letterless text has no language and is rejected.  A null
host, suffix or declaration is missing evidence.  A table without declared
languages has no models and keeps nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import bounded_batches, documents, sized_broadcast, store
from cairn.llm.shingles import PIECE, _layout

SLOTS = 1 << 14
SAMPLE = 4000
#: At most so many languages, those declared most often.
LANGUAGES = 256
LEAST_DECLARED = 5
EFFECTIVE = 30
HOST_WEIGHT, DOMAIN_WEIGHT = 20.0, 100.0
SMOOTH = 1.0
CONFIDENCE = 0.5
#: Tempered log likelihood ratio to random bytes below which a text is in none of the languages: one nat a trigram.
LEAST_TEXT = -1.0 * EFFECTIVE

# Labels under which countries register names of all kinds.
GENERAL = ("ac", "co", "com", "edu", "gob", "gov", "ne", "net", "or", "org")

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[:65] = 32  # digits, signs and white space are one blank
_LOWER[91:97] = 32
_LOWER[123:128] = 32


def trigrams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of an Arrow column: (low row, high row, slots, row of each slot, rows with letters); a slot hashes three bytes around a letter."""
    data, offsets = _layout(column)
    low, n = 0, len(column)
    while low < n:
        high = min(n, max(low + 1, int(np.searchsorted(offsets, offsets[low] + PIECE, "right")) - 1))
        own = _LOWER[data[offsets[low] : offsets[high]]]
        row = np.repeat(np.arange(low, high), np.diff(offsets[low : high + 1]))
        lettered = np.unique(row[own != 32])
        if len(own) >= 3:
            code = own[:-2] << np.uint32(16) | own[1:-1] << np.uint32(8) | own[2:]
            good = (row[:-2] == row[2:]) & (own[1:-1] != 32)
            slot = (code[good] * np.uint32(2654435761) >> np.uint32(18)).astype(np.int64)
            yield low, high, slot, row[:-2][good], lettered
        else:
            yield low, high, np.zeros(0, np.int64), np.zeros(0, np.int64), lettered
        low = high


@dataclass
class TextModel:
    """Languages and their log probability of each slot, less that of random bytes."""

    languages: list[str]
    table: np.ndarray


def fit_text(df: DataFrame, text: Column, declared: Column, key: Column, sample: int = SAMPLE) -> TextModel:
    """Learn the text models from ``sample`` rows of each declared language, or all if there are fewer."""
    rows = df.select(declared.alias("declared"), F.xxhash64(key, text).alias("turn"), text.alias("text"))
    declared_rows = {r.declared: r.n for r in rows.where("declared IS NOT NULL").groupBy("declared").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_DECLARED).orderBy(F.desc("n"), "declared").limit(LANGUAGES).collect()}
    languages = sorted(declared_rows)
    if not languages:
        return TextModel([], np.zeros((SLOTS, 0), np.float32))
    # First by a share of the hashes that leaves a few more than enough, whatever the language's size; repeated rows are one.
    enough = sample + 8 * sample**0.5 + 64
    highest = {x: min((1 << 63) - 1, int(enough / n * 2.0**64) - (1 << 63)) for x, n in declared_rows.items()}
    limit = F.create_map(*[y for x, n in highest.items() for y in (F.lit(x), F.lit(n).cast("long"))])
    few = rows.where(F.col("declared").isin(languages) & (F.col("turn") <= limit[F.col("declared")])).groupBy("declared", "turn").agg(F.first("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("declared").orderBy("turn"))
    chosen = few.withColumn("rank", rank).where(F.col("rank") <= sample)
    place = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(place), SLOTS), np.int64)
        for batch in batches:
            own = np.array([place[x] for x in batch.column("declared").to_pylist()], np.int64)
            for _, _, slot, row, _ in trigrams(batch.column("text")):
                sums += np.bincount(own[row] * SLOTS + slot, minlength=sums.size).reshape(sums.shape)
        lang, slot = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(sums[lang, slot])], names=["lang", "slot", "n"])

    # At most LANGUAGES x SLOTS rows.
    counts = np.zeros((len(languages), SLOTS))
    for r in chosen.select("declared", "text").mapInArrow(count, "lang int, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.lang, r.slot] = r.n
    learnt = counts.sum(1) > 0
    languages, counts = [x for x, some in zip(languages, learnt.tolist(), strict=True) if some], counts[learnt]
    table = np.log((counts + SMOOTH) / (counts.sum(1, keepdims=True) + SMOOTH * SLOTS)) + log(SLOTS)
    return TextModel(languages, np.ascontiguousarray(table.T.astype(np.float32)))


def text_evidence(df: DataFrame, text: Column, model: TextModel) -> DataFrame:
    """Add _text: the tempered log likelihood ratio of each language to random bytes; null without letters."""
    shared = df.sparkSession.sparkContext.broadcast(model.table)
    wide = len(model.languages)

    @F.arrow_udf("array<float>")
    def ratio(column: pa.Array) -> pa.Array:
        sums, count = np.zeros((len(column), wide), np.float32), np.zeros(len(column), np.int64)
        blank = np.ones(len(column), bool)
        for low, high, slot, row, lettered in trigrams(column):
            blank[lettered] = False
            if not len(slot):
                continue
            count[low:high] = np.bincount(row - low, minlength=high - low)
            first = np.flatnonzero(np.diff(row, prepend=-1))
            sums[row[first]] = np.add.reduceat(shared.value[slot], first, axis=0)
        sums *= (np.minimum(count, EFFECTIVE) / np.maximum(count, 1))[:, None].astype(np.float32)
        flat = pa.array(sums.ravel(), pa.float32())
        return pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1) * wide, pa.int32()), flat, mask=pa.array(blank))

    return df.withColumn("_text", ratio(text))


def _log_shares(counts: list[Column], parent: list[Column], weight: float) -> list[Column]:
    total = sum(counts[1:], counts[0])
    return [(c + F.lit(weight) * p) / (total + F.lit(weight)) for c, p in zip(counts, parent, strict=True)]


def evidence_tables(rows: DataFrame, languages: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per host: prior of each language; per declared language and per suffix: log likelihoods.  ``rows`` has _best, _host, _domain, _suffix, _declared."""
    wide = range(len(languages))
    each = [F.sum((F.col("_best") == i).cast("long")).alias(f"c{i}") for i in wide]
    found = rows.where("_best IS NOT NULL")
    hosts = found.groupBy("_domain", "_host").agg(*each)
    domains = hosts.groupBy("_domain").agg(*[F.sum(f"c{i}").alias(f"d{i}") for i in wide])
    root = found.agg(*each).first()  # one row
    total = sum(root[i] or 0 for i in wide)
    base = [F.lit(((root[i] or 0) + SMOOTH) / (total + SMOOTH * len(languages))) for i in wide]
    domains = domains.select("_domain", *[x.alias(f"p{i}") for i, x in zip(wide, _log_shares([F.col(f"d{i}") for i in wide], base, DOMAIN_WEIGHT), strict=True)])
    hosts = hosts.join(domains, hosts["_domain"].eqNullSafe(domains["_domain"])).drop(domains["_domain"])
    shares = _log_shares([F.col(f"c{i}") for i in wide], [F.col(f"p{i}") for i in wide], HOST_WEIGHT)
    hosts = hosts.where("_host IS NOT NULL").groupBy("_host").agg(*[F.first(F.log(x)).alias(f"h{i}") for i, x in zip(wide, shares, strict=True)]).select("_host", F.array(*[f"h{i}" for i in wide]).alias("_prior"))

    def likelihood(column: str, name: str) -> DataFrame:
        kinds = found.where(F.col(column).isNotNull()).groupBy(column).agg(*each)
        values = [F.log((F.col(f"c{i}") + SMOOTH) / F.lit((root[i] or 0) + SMOOTH * 100)) for i in wide]
        return kinds.select(column, F.array(*values).alias(name))

    return hosts, likelihood("_declared", "_said"), likelihood("_suffix", "_ends")


def identify(df: DataFrame, text: Column, declared: Column, host: Column, domain: Column, suffix: Column, key: Column, accepted: Sequence[str] | None = None, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``carry``, language, language_confidence, text_language and language_kept of every row of ``df``.

    Texts are scored once; the scores are stored and all else is worked out from
    them.  Columns of ``df`` are read by the given expressions only, so their
    names don't matter, but that ``carry`` may not hold the four new ones.
    """
    bounded_batches(df.sparkSession)
    model = fit_text(df, text, declared, key)
    if not model.languages:
        none = F.lit(None).cast("string")
        return df.select(*carry, none.alias("language"), F.lit(0.0).alias("language_confidence"), none.alias("text_language"), F.lit(False).alias("language_kept"))
    names = F.array(*map(F.lit, model.languages))
    given = {"_declared": declared, "_host": host, "_domain": domain, "_suffix": suffix}
    rows = df.select(F.struct(*carry).alias("_carried"), *[v.cast("string").alias(k) for k, v in given.items()], text.alias("_body"))
    best = F.array_position("_text", F.array_max("_text")).cast("int") - 1
    rows = text_evidence(rows, F.col("_body"), model).drop("_body")
    rows = store(rows.withColumn("_best", F.when(F.array_max("_text") > 0, best)), "evidence")
    for table, column in zip(evidence_tables(rows, model.languages), ("_host", "_declared", "_suffix"), strict=True):
        table = store(table, "prior")
        rows = rows.join(sized_broadcast(table, table.count(), 20_000), column, "left")
    none = F.array_repeat(F.lit(0.0), len(model.languages))
    total = F.col("_text").cast("array<double>")
    for name in ("_prior", "_said", "_ends"):
        total = F.zip_with(total, F.coalesce(name, none), lambda a, b: a + b)
    rows = rows.withColumn("_total", total)
    top = F.array_max("_total")
    confidence = 1 / F.aggregate("_total", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    place = F.array_position("_total", top).cast("int")
    rows = rows.withColumn("_place", F.when(F.col("_text").isNotNull(), place))
    kept = (F.get("_text", F.col("_place") - 1) > LEAST_TEXT) & (F.when(F.col("_place").isNotNull(), confidence) >= CONFIDENCE)
    found = F.get(names, F.col("_place") - 1)
    if accepted is not None:
        kept &= F.coalesce(found.isin(*accepted), F.lit(False))
    return rows.select(
        *[F.col(f"_carried.`{c}`") for c in carry],
        found.alias("language"),
        F.when(F.col("_place").isNotNull(), confidence).otherwise(0.0).alias("language_confidence"),
        F.get(names, F.col("_best")).alias("text_language"),
        F.coalesce(kept, F.lit(False)).alias("language_kept"),
    )


def suffix_of(host: Column) -> Column:
    """The last label of an address; null for a name without dots."""
    labels = F.split(host, r"\.")
    return F.when(F.size(labels) > 1, F.nullif(F.try_element_at(labels, F.lit(-1)), F.lit("")))


def domain_of(host: Column) -> Column:
    """The labels of an address that one owner registers: the last two, or three under a country's general label; null for a name without dots."""
    labels = F.split(host, r"\.")
    wide = F.when((F.length(F.try_element_at(labels, F.lit(-1))) == 2) & F.try_element_at(labels, F.lit(-2)).isin(*GENERAL), 3).otherwise(2)
    wide = F.least(wide, F.size(labels))
    return F.when(F.size(labels) > 1, F.array_join(F.slice(labels, -wide, wide), "."))


def of_documents(docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """identify() for the documents table: the language column is the declaration, the source is the host and, where it is an address, has suffix and domain."""
    host = F.lower("source")
    return identify(docs, F.col("text"), F.col("lang"), host, domain_of(host), suffix_of(host), F.col("doc_id"), carry=carry)


def op2_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, and whether each is kept."""
    found = of_documents(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    return found.select("doc_id", "language", "language_confidence", "text_language", F.col("language_kept").alias("kept"))


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all pages, with markup language, address suffix, domain and host as evidence."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1))
    host = F.nullif(host, F.lit(""))
    text = F.regexp_replace("html", r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>", " ")
    said = F.lower(F.regexp_extract("html", r"""(?i)<html[^>]*\slang=["']?([a-z]{2,3})""", 1))
    given = pages.select("page_id", text.alias("text"), F.nullif(said, F.lit("")).alias("said"), host.alias("host"), domain_of(host).alias("domain"), suffix_of(host).alias("suffix"))
    found = identify(given, F.col("text"), F.col("said"), F.col("host"), F.col("domain"), F.col("suffix"), F.col("page_id"), carry=("page_id",))
    return found.select("page_id", "language", "language_confidence", "text_language", F.col("language_kept").alias("kept"))
