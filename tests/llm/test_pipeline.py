"""The pipeline against a plain version of each stage."""

import math
import random
from collections import Counter
from hashlib import md5

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import decontaminate, mixing, sharding
from cairn.llm.common import store
from cairn.llm.shingles import pieces
from tests.llm.conftest import prose
from tests.llm.test_text import brute_components, edited


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """Documents with blanks, near copies and benchmark passages."""
    rng = random.Random(12)
    items = [(i, prose(rng, 30)) for i in range(6)]
    texts = [prose(rng, rng.randint(20, 90)) for _ in range(60)]
    texts += [" ".join(edited(rng, t.split(), 1)) for t in texts[:15]] + texts[:5] + [None, "", " 12 # "]
    texts += [f"{prose(rng, 40)} {text} {prose(rng, 40)}" for _, text in items]
    rng.shuffle(texts)
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]
    path = f"file://{tmp_path_factory.mktemp('pipeline')}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_run(spark, data):
    """run() gives the rows of a brute-force version."""
    path, rows, items = data
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mix", "shard"]
    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    component = brute_components([(r[0], r[1]) for r in kept], 5, 80)
    kept = [r for r in kept if component[r[0]][1] == r[0]]
    kept = [r for r in kept if not any(text in r[1] for _, text in items)]
    docs = spark.createDataFrame(kept, "doc_id long, text string, lang string, source string, n_chars long")
    taken = {r.doc_id: r for r in mixing.mix(store(mixing.measured(docs), "t")).collect()}
    tree = dict(sharding._levels(sharding.planned_tree(24)))
    want = Counter()
    for r in kept:
        draw = int(md5(f"copy:{r[0]}".encode()).hexdigest()[:8], 16) / 2**32
        node = ""
        for _ in range(3):
            node, _, to = min(tree[node], key=lambda c, r=r: -math.log((int(md5(f"{c[0]}:{r[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / c[1])
        want[(r[0], r[1], to)] += math.floor(taken[r[0]].taken / taken[r[0]]["size"] + draw)
    got = corpus_pipeline.run(spark, path).collect()
    assert Counter((r.doc_id, r.text, r.shard) for r in got) == +want
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_decontamination_space(spark, tmp_path):
    """The stage judges by weights and a latent space of all its documents: it keeps what those made by hand from all texts keep."""
    rng = random.Random(31)
    vocabulary = [f"w{i}" for i in range(900)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(12, 40))) for _ in range(60)]
    texts = [" ".join(rng.choice(vocabulary[k % 90 * 10 : k % 90 * 10 + 200]) for _ in range(rng.randint(3, 60))) for k in range(5000)]
    texts += [prose(rng, 15) + " " + " ".join(rng.choice(vocabulary) if k % n == n - 1 else w for k, w in enumerate(item.split())) for item in items for n in (3, 4, 5)]
    counts = np.zeros(decontaminate.SLOTS)
    for text in texts:
        counts[np.unique(np.concatenate([decontaminate._slot(p.words) for p in pieces(pa.array([text]), bare=True)]))] += 1
    idf = np.log((1 + len(texts)) / (1 + counts)).astype(np.float32)
    product = lambda q: decontaminate.gram(pa.array(texts + items), q, idf)
    basis = np.linalg.qr(np.random.Generator(np.random.PCG64(11)).standard_normal((decontaminate.SLOTS, decontaminate.RANK + decontaminate.EXTRA)))[0]
    for _ in range(decontaminate.ROUNDS):
        basis = np.linalg.qr(product(basis))[0]
    values, vectors = np.linalg.eigh(basis.T @ product(basis))
    basis = (basis @ vectors[:, np.argsort(values)[::-1][: decontaminate.RANK]]).astype(np.float32)
    block = decontaminate.Items(list(range(len(items))), items, [None] * len(items), idf, basis)
    want = {i for i, found in enumerate(decontaminate.search(pa.array(texts), block, idf, basis)) if not found}
    path = f"file://{tmp_path}"
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.decontamination(spark, docs.repartition(5), path).select("doc_id").collect()}
    assert 60 <= len(texts) - len(want) < 180
    assert got == want


def test_awkward(spark, awkward, empty, folder):
    """Stages keep the columns of documents and take awkward and empty tables."""
    for docs in (awkward, empty):
        out = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = store(stage(spark, out, folder), name)
            assert out.columns == list(corpus_pipeline.COLUMNS)
        last = corpus_pipeline.STAGES[-1][1](spark, out, folder)
        assert last.where(F.col("shard").isNull()).count() == 0


def test_guard():
    """The entry module has the operators' queries."""
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
