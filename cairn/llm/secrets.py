"""Secret scans with a random forest against false positives (operator 5).

1. Rules find candidates: words of ``LEAST`` bytes or more that mix letters and
   digits, and values of ``LEAST_ASSIGNED`` characters or more assigned to a
   credential's name, in the same word (each of them) or in the next.
2. Each candidate is described by its length, its character transitions (class
   changes, and how surprising its letter pairs are), how much of it is covered
   by dictionary words, whether it looks like a path or an address, and the
   words around it.
3. A random forest trained from labelled findings scores them; those under
   ``CUT`` are false positives.

The dictionary holds the words that stand in two texts at least and in
``LEAST_SHARE`` of all texts; every text is counted.
Labelled findings are a table of before, candidate, after, label; without one,
``labelled_findings`` makes ``FINDINGS`` seeded examples of known kinds.

Nulls: a null or blank text has no findings; ids may be null.  Repeated rows have
their findings each.  Offsets count words, so long texts are never cut.
"""

from __future__ import annotations

import base64
import random
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import bounded_batches, documents
from cairn.llm.shingles import Piece, pieces

LEAST, LEAST_ASSIGNED = 16, 8
#: Texts that a word of the dictionary stands in, of all texts: at most (distinct words of a text) / LEAST_SHARE words.
LEAST_SHARE = 1e-4
FINDINGS = 4000
TREES, DEPTH, SEED = 40, 8, 5
CUT = 0.5
AROUND = 3

# Names of credentials, words that announce digests or ids, and prefixes of token kinds.
CREDENTIALS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "auth", "authorization", "bearer", "credential", "key", "private")
HARMLESS = ("commit", "sha", "sha1", "sha256", "md5", "hash", "checksum", "digest", "uuid", "guid", "id", "version", "build", "revision", "etag", "session", "order", "example", "placeholder", "test")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "AIza", "glpat-", "eyJ", "npm_")

_ASSIGNED = re.compile(r"([A-Za-z_][A-Za-z0-9_\-.]*)\s*[=:]+\s*[\"'`]?(.*)$", re.S)
_EDGES = "\"'`()[]{}<>,;:.!?=|#*$%&"
_EACH = re.compile(r"([A-Za-z_][A-Za-z0-9_\-.]*)[\"'`]?[=:]+>?(?:\"([^\"]*)\"|'([^']*)'|[\"'`]?([^&;,\"'`{}\[\]]*))")
_GIVES = re.compile(r"[\"'`({\[,]*([A-Za-z_][A-Za-z0-9_\-.]*)[\"'`]?[=:]+>?[\"'`]?")
_SIGNS = ("=", ":", ":=", "=>", "==", "::", "is")
_PARTS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z0-9]+")
_NAMES = ("length", "digits", "capitals", "signs", "changes", "distinct", "entropy", "surprise", "covered", "path", "prefix", "hexadecimal", "uuid", "assigned", "credential_before", "harmless_before", "credential_after", "harmless_after")


def core(word: str) -> tuple[str, str]:
    """(name, value) of an assignment, else ("", the word without quotes and marks at its ends)."""
    word = word.strip(_EDGES)
    found = _ASSIGNED.match(word)
    if found and len(found[2].strip(_EDGES)) >= LEAST_ASSIGNED and "://" not in word:
        return found[1].lower(), found[2].strip(_EDGES)
    return "", word


def is_credential(name: str) -> bool:
    """Whether a name is a credential's, or ends in one, as in db_password or authToken."""
    flat = re.sub(r"[_\-.]", "", name.lower())
    parts = [x.lower() for x in _PARTS.findall(name)]
    return any(x.removesuffix("s") in CREDENTIALS for x in [*parts, flat]) or flat.removesuffix("s").endswith(tuple(re.sub(r"[_\-]", "", c) for c in CREDENTIALS if len(c) > 4))


def assignments(word: str) -> list[tuple[str, str]]:
    """(name, value) of every assignment in a word; of an address, those of its query."""
    if "://" in word:
        word = word.partition("?")[2]
    return [(m[1], (m[2] or m[3] or m[4] or "").strip(_EDGES)) for m in _EACH.finditer(word)]


def found_in(word: str, assigned: bool) -> list[tuple[str, str]]:
    """(name, value) of the candidates in a word; ``assigned`` if the words before name a credential for it."""
    mixed = lambda x: any(c.isdigit() for c in x) and any(c.isalpha() for c in x)
    name, value = core(word)
    every = assignments(word)
    out = []
    if len(every) < 2 or "://" in word:
        fits = len(word.encode()) >= LEAST and len(value) >= (LEAST_ASSIGNED if name else LEAST) and mixed(value)
        if fits or (name and is_credential(name)) or (assigned and not name and len(value) >= LEAST_ASSIGNED):
            out.append((name, value))
    own = [(n.lower(), v) for n, v in every if len(v) >= LEAST_ASSIGNED and (is_credential(n) or (len(every) > 1 and "://" not in word and len(word.encode()) >= LEAST and mixed(v)))]
    return out + [x for x in own if x not in out and not (out and out[0][0] == x[0])]


def names_credential(words: list[str]) -> bool:
    """Whether a text's last words assign what comes next to a credential's name."""
    if not words:
        return False
    last = words[-1]
    if last.strip(_EDGES).lower() == "bearer":
        return True
    if last.lower() in _SIGNS:
        return len(words) > 1 and is_credential(words[-2].strip(_EDGES))
    found = _GIVES.fullmatch(last)
    return bool(found) and is_credential(found[1])


class Dictionary:
    """Words, and how usual each pair of letters is in them."""

    def __init__(self, words: dict[str, int]) -> None:
        self.words = {w for w in words if len(w) >= 3}
        self.longest = min(24, max(map(len, self.words), default=0))
        pairs = Counter(w[i : i + 2] for w in self.words for i in range(len(w) - 1))
        total = sum(pairs.values()) or 1
        self.cost = {p: -np.log2((n + 0.5) / (total + 500)) for p, n in pairs.items()}
        self.rare = -np.log2(0.5 / (total + 500))

    def covered(self, text: str) -> float:
        """The share of letters and digits in dictionary words, longest first from the left."""
        text, at, hit = text.lower(), 0, 0
        while at < len(text):
            size = next((k for k in range(min(self.longest, len(text) - at), 2, -1) if text[at : at + k] in self.words), 0)
            hit += size
            at += size or 1
        return hit / max(1, len(text))

    def surprise(self, text: str) -> float:
        """Mean bits of a pair of letters or digits."""
        text = text.lower()
        return float(np.mean([self.cost.get(text[i : i + 2], self.rare) for i in range(len(text) - 1)])) if len(text) > 1 else 0.0


def describe(name: str, value: str, before: list[str], after: list[str], words: Dictionary) -> list[float]:
    """The features named in ``_NAMES``."""
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s" for c in value]
    n = max(1, len(value))
    counts = Counter(value)
    near = [w.lower().strip(_EDGES + "\"' ") for w in before if w.strip(_EDGES)]
    then = [w.lower().strip(_EDGES + "\"' ") for w in after if w.strip(_EDGES)]
    named = lambda some, known: float(any(k == w or (len(k) > 3 and k in w) for w in some for k in known))
    return [
        float(len(value)), kinds.count("d") / n, kinds.count("u") / n, kinds.count("s") / n,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n, len(counts) / n,
        -sum(c / n * np.log2(c / n) for c in counts.values()), words.surprise(value), words.covered(value),
        float(value.count("/") >= 2 or "@" in value or "://" in value or "www." in value or value.count(".") >= 2),
        float(value.startswith(PREFIXES)), float(bool(re.fullmatch(r"[0-9a-fA-F]+", value))), float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value))),
        float(bool(name)), named([*near, name] if name else near, CREDENTIALS), named([*near, name] if name else near, HARMLESS), named(then, CREDENTIALS), named(then, HARMLESS),
    ]


def candidates(piece: Piece) -> Iterator[tuple[int, int, str, str, list[str], list[str]]]:
    """(row, word number, name, value, words before, words after) of each candidate in a piece."""
    data = piece.data
    digit = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    letter = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 122))])
    s, e = piece.starts, piece.ends
    sign = np.concatenate([[0], np.cumsum((data == 61) | (data == 58))])
    signed = sign[e] > sign[s]
    lower = lambda k: data[np.minimum(s + k, max(0, len(data) - 1))] | 32
    verb = (e - s == 2) & (lower(0) == 105) & (lower(1) == 115)
    bearer = (e - s >= 6) & (e - s <= 12) & np.logical_or.reduce([(lower(k) == 98) & (lower(k + 1) == 101) & (lower(k + 2) == 97) & (lower(k + 3) == 114) for k in range(3)]) if len(s) else verb
    gives = signed | verb | bearer
    marked = signed | ((e - s >= LEAST) & (digit[e] > digit[s]) & (letter[e] > letter[s]))
    marked[1:] |= gives[:-1]
    marked = np.flatnonzero(marked)
    rows = np.searchsorted(piece.first, marked, "right") - 1
    word = lambda i: data[s[i] : e[i]].tobytes().decode("utf-8", "replace")
    for i, r in zip(marked.tolist(), rows.tolist(), strict=True):
        low, high = int(piece.first[r]), int(piece.first[r + 1])
        assigned = i > low and bool(gives[i - 1]) and names_credential([word(j) for j in range(max(low, i - 2), i)])
        if not (assigned or signed[i] or e[i] - s[i] >= LEAST):
            continue
        found = found_in(word(i), assigned)
        if found:
            before, after = [word(j) for j in range(max(low, i - AROUND), i)], [word(j) for j in range(i + 1, min(high, i + 1 + AROUND))]
            for name, value in found:
                yield r + piece.low, i - low, name, value, before, after


def labelled_findings(n: int = FINDINGS, seed: int = SEED, words: list[str] | None = None) -> list[tuple[str, str, str, int]]:
    """Seeded (before, candidate word, after, label) examples of known kinds, half of them secrets."""
    rng = random.Random(seed)
    usual = words or ["the", "of", "and", "service", "value", "system", "report", "server", "window", "table", "river", "letter"]
    pick = lambda k, alphabet: "".join(rng.choice(alphabet) for _ in range(k))
    hexa, low, mixed = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    text = lambda: " ".join(rng.choice(usual) for _ in range(3))
    wordy = lambda sep: sep.join(rng.choice(usual) for _ in range(rng.randint(3, 5)))
    out = []
    for i in range(n):
        if i % 2:
            kind = rng.randrange(7)
            name = rng.choice(CREDENTIALS[:12])
            value = (pick(rng.choice((18, 24, 32, 40, 64)), hexa), pick(rng.randint(16, 48), mixed), base64.b64encode(rng.randbytes(rng.randint(15, 40))).decode(), pick(rng.randint(12, 24), low))[rng.randrange(4)]
            if kind <= 1:
                row = (text(), f"{name}{rng.choice('=:')}{value}", text())
            elif kind <= 3:
                row = (f"{rng.choice(usual)} {name} {rng.choice(('=', ':', 'is'))}", f'"{value}"', text())
            elif kind == 4:
                row = (text(), "AKIA" + pick(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), text())
            elif kind == 5:
                row = (text(), rng.choice(PREFIXES[2:10]) + pick(rng.randint(24, 36), mixed), text())
            else:
                row = ("Authorization: Bearer", "eyJ" + pick(20, mixed) + "." + pick(40, mixed) + "." + pick(30, mixed), text())
            out.append((*row, 1))
        else:
            kind = rng.randrange(9)
            value = {
                0: lambda: pick(rng.choice((32, 40, 64)), hexa), 1: lambda: str(uuid.UUID(int=rng.getrandbits(128))), 2: lambda: f"https://{wordy('')}.example.com/{wordy('/')}/{rng.randint(1, 9999)}",
                3: lambda: f"/{wordy('/')}/{rng.choice(usual)}{rng.randint(1, 99)}.txt", 4: lambda: wordy("_") + str(rng.randint(1, 2000)), 5: lambda: wordy("-") + f"-v{rng.randint(1, 20)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}",
                6: lambda: f"{rng.choice(usual)}.{rng.choice(usual)}{rng.randint(1, 99)}@{rng.choice(usual)}.example.org", 7: lambda: "".join(w.capitalize() for w in wordy(" ").split()) + str(rng.randint(1, 99)), 8: lambda: rng.choice(CREDENTIALS) + "=" + rng.choice(("x" * 15 + "1", "your-password-here1", "EXAMPLE_KEY_0000", "<token-goes-here-1>", "changeme12345678")),
            }[kind]()
            before = f"{rng.choice(usual)} {rng.choice(HARMLESS[:15])}" if kind <= 1 else text()
            out.append((before, value, text(), 0))
    return out


def dictionary(df: DataFrame, text: str = "text") -> Dictionary:
    """Words of three letters or more, not parts of tokens, that stand in two texts and ``LEAST_SHARE`` of all texts."""
    rows = df.select(F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    words = rows.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![\p{L}\p{N}])\p{L}{3,24}(?![\p{L}\p{N}])"), 0))).alias("word"))
    least = max(2, ceil(LEAST_SHARE * rows.count()))
    # The share bounds what comes to the driver.
    return Dictionary({r.word: r.n for r in words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).toLocalIterator()})


def train(spark: SparkSession, words: Dictionary, findings: list[tuple[str, str, str, int]]) -> RandomForestClassificationModel:
    """A forest from labelled findings."""
    rows = []
    for before, word, after, label in findings:
        name, value = core(word)
        rows.append(([float(x) for x in describe(name, value, before.split()[-AROUND:], after.split()[:AROUND], words)], float(label)))
    table = spark.createDataFrame(rows, "given array<double>, label double").select(array_to_vector("given").alias("features"), "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(table.coalesce(1))


def findings(df: DataFrame, words: Dictionary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, word number, candidate and features of every candidate."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text")):
                found = list(candidates(piece))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array([f[0] for f in found])), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found]), pa.array([f[3] for f in found]), pa.array([describe(*f[2:], shared.value) for f in found], pa.list_(pa.float64()))],
                        names=["doc_id", "word", "name", "candidate", "given"],
                    )

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, word long, name string, candidate string, given array<double>")


def scan(df: DataFrame, labelled: list[tuple[str, str, str, int]] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every candidate with its score and whether it is a secret."""
    words = dictionary(df, text)
    model = train(df.sparkSession, words, labelled or labelled_findings(words=sorted(words.words)[:: max(1, len(words.words) // 2000)] or None))
    rows = findings(df, words, key, text).withColumn("features", array_to_vector("given"))
    scored = model.transform(rows).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select("doc_id", "word", "name", "candidate", "score", (F.col("score") >= CUT).alias("secret"))


def op5_forest_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of all documents; the candidate itself is masked but for its digest."""
    found = scan(documents(spark, sf_dir))
    return found.select("doc_id", "word", F.length("candidate").alias("length"), F.substring(F.sha2("candidate", 256), 1, 16).alias("digest"), "score", "secret")
