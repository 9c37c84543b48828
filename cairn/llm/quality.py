"""Quality classifier: hashed word n-grams and FTRL logistic regression (operator 6).

Features are n-grams of words in two spellings: as written (single words and
pairs) and by shape (pairs; runs of letters, capitals or digits shrink to one
sign, and the pair says whether its words are equal).  Each is hashed to one of
``SLOTS`` weights, and a text's value of a feature is its share of the text's
n-grams.  Weights come from follow-the-regularised-leader updates (McMahan et
al. 2013) over a bounded sample of at most ``SAMPLE`` labelled rows, chosen by
hash.  A score is a sparse dot product.

Labels are learnt only from rows that aren't held out; labels, language, source
and id are no inputs of a score.  Nulls: a null or blank text has no n-grams and
scores what the intercept says; rows without a label teach nothing; a row
without an id isn't held out.  Without any labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import bounded_batches, documents
from cairn.llm.shingles import Piece, mix, pieces, powers

SLOTS = 1 << 18
SAMPLE = 8000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
#: Shares are small; this brings them near the intercept's size.
GAIN = 8.0
CUT = 0.7

_U = np.uint64
_SHAPE = np.arange(256, dtype=np.uint64) + _U(1)
_SHAPE[128:] = _SHAPE[97:123] = 1000
_SHAPE[65:91] = 1001
_SHAPE[48:58] = 1002
_SHAPE = mix(_SHAPE)


def shapes(piece: Piece) -> np.ndarray:
    """A hash of each word's shape."""
    signs = _SHAPE[piece.data]
    keep = np.ones(len(signs), bool)
    keep[1:] = signs[1:] != signs[:-1]
    keep[piece.starts] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    signs = signs[keep]
    up, down = powers(0xC2B2AE3D27D4EB4F, len(signs) + 1)
    sums = np.zeros(len(signs) + 1, np.uint64)
    np.cumsum(signs * up[: len(signs)], out=sums[1:])
    return mix((sums[place[piece.ends]] - sums[place[piece.starts]]) * down[place[piece.starts]])


def features(piece: Piece) -> np.ndarray:
    """(words, 3) slots: each word, its pair with the word before, and that pair's shapes; -1 where a text begins."""
    words, form = piece.words, shapes(piece)
    out = np.full((len(words), 3), -1, np.int64)
    mask = _U(SLOTS - 1)
    out[:, 0] = mix(words ^ _U(11)) & mask
    if len(words) > 1:
        out[1:, 1] = mix(words[:-1] * _U(3) + words[1:] ^ _U(22)) & mask
        out[1:, 2] = mix(form[:-1] * _U(3) + form[1:] ^ ((words[:-1] == words[1:]).astype(np.uint64) + _U(33))) & mask
        first = piece.first[:-1][np.diff(piece.first) > 0]
        out[first, 1:] = -1
    return out


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[int, bytes, int, np.ndarray, np.ndarray]] = []
    for batch in batches:
        order, labels = batch.column("turn").to_pylist(), batch.column("label").to_pylist()
        for piece in pieces(batch.column("text")):
            slots = features(piece)
            for row, a, b in piece:
                own = slots[a:b].ravel()
                kinds, counts = np.unique(own[own >= 0], return_counts=True)
                rows.append((order[row], kinds.tobytes()[:64], labels[row], kinds.astype(np.int32), (GAIN * counts / max(1, counts.sum())).astype(np.float32)))
    rows.sort(key=lambda r: r[:3])
    z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    for _ in range(EPOCHS):
        for _, _, label, kinds, values in rows:
            at = np.append(kinds, SLOTS)
            x = np.append(values, 1.0)
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            new = ni + g * g
            z[at] = zi + g - (np.sqrt(new) - np.sqrt(ni)) / ALPHA * w
            n[at] = new
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)).astype(np.float32)
    yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["weights"])


def held_out(key: Column) -> Column:
    """Rows never learnt from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(texts: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """Weights learnt from at most ``sample`` labelled rows that aren't held out; the last is the intercept."""
    turn = F.xxhash64(F.col(key), F.lit(label))
    few = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key))).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("label"), turn.alias("turn")).distinct().orderBy("turn", "_key", "label").limit(sample)
    rows = texts.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text")).join(F.broadcast(few), "_key").select("turn", "text", "label")
    # One task learns: updates are in sequence, and the sample is bounded.
    found = rows.repartition(1).mapInArrow(_train, "weights binary").collect()
    return np.frombuffer(found[0].weights, np.float32) if found else np.zeros(SLOTS + 1, np.float32)


def scored(df: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every row."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.append(shared.value[:SLOTS], np.float32(0)).astype(np.float64)
        for batch in batches:
            for piece in pieces(batch.column("text")):
                slots = features(piece)
                sums = np.concatenate([[0.0], np.cumsum(own[slots].sum(axis=1))])
                count = np.diff(piece.first)
                total = sums[piece.first[1:]] - sums[piece.first[:-1]]
                mean = total / np.maximum(1, np.where(count > 0, 3 * count - 2, 1))
                score = 1 / (1 + np.exp(-np.clip(GAIN * mean + shared.value[SLOTS], -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(piece.low, piece.high - piece.low), pa.array(score)], names=[key, "score"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, score double")


def op6_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = documents(spark, sf_dir)
    rows = scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
