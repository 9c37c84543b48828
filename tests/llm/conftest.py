"""Small tables with every awkward row."""

import random

import pytest

WORDS = "river stone house light water green cloud paper table chair morning evening summer winter garden street window".split()


def prose(rng, n):
    """n words with line breaks."""
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) + ("\n" if rng.random() < 0.05 else "") for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Null ids and texts, empty and very long texts, repeated rows, and columns whose names operators use themselves."""
    rng = random.Random(1)
    long = prose(rng, 30_000)
    rows = [
        (1, prose(rng, 120), "en", "a"), (2, None, "en", "a"), (3, "", "en", None), (4, " \n\t ", None, None), (5, long, "en", "b"), (6, long + " more", "en", "b"),
        (None, prose(rng, 60), "en", "b"), (None, None, None, None), (7, "one", "de", "b"), (7, "one", "de", "b"), (8, prose(rng, 70), "de", "c"), (8, prose(rng, 80), "de", "c"), (9, "é ñ ß x", "es", "c"),
    ]
    extra = {c: "x" for c in ("shard", "size", "rep", "row", "words", "turn", "key", "n", "leaks", "language", "_text", "_best", "_file", "_row", "found", "family", "rank", "anchor", "label", "payload")}
    return spark.createDataFrame([(*r, len(r[1] or ""), *extra.values()) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra))


@pytest.fixture(scope="session")
def empty(awkward):
    """The same columns without rows."""
    return awkward.limit(0)


@pytest.fixture(scope="session")
def folder(spark, awkward, tmp_path_factory):
    """A data folder with the awkward documents."""
    path = f"file://{tmp_path_factory.mktemp('data')}"
    awkward.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, "a benchmark passage of at least eight plain words here"), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    pages = [(1, "http://a.example.com/x?q=1", "<p>a</p>"), (2, "https://a.example.com/x?q=1", "<p>a</p>"), (3, None, None), (4, "no url", ""), (None, "http://b.example.org", "<p>a</p>"), (2, "https://a.example.com/x?q=1", "<p>a</p>"), (5, "http://[bad", "é")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path
