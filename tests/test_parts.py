"""CSV, spatial search, locks, conflicts and metrics."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cairn import metrics
from cairn.errors import EngineError, NotFound
from cairn.functions import spatial as G
from cairn.operators import conflicts as C
from cairn.operators import spatial as X
from cairn.sources import csvio, sortedfile
from cairn.txn import LockManager, Simulator, Transaction
from cairn.workspace import workspace


def test_names_and_inference(spark, tmp_path):
    """Headers are cleaned and told apart; types come from the sample."""
    assert csvio.clean_names(["Opp Formation", "2nd", "", "a", "a", " a "]) == ["Opp_Formation", "c_2nd", "col", "a", "a_2", "a_3"]
    path = tmp_path / "x.csv"
    path.write_text('id,full name,v,blank,n\n1,"León, A",1.5,,1\n2,b,2,,\n')
    found = csvio.infer(spark, str(path))
    assert found["sampled"] == 2
    assert found["columns"] == [{"name": "id", "type": "INT"}, {"name": "full_name", "type": "TEXT", "original": "full name", "size": 16}, {"name": "v", "type": "FLOAT"}, {"name": "blank", "type": "TEXT", "size": 16}, {"name": "n", "type": "INT"}]
    with pytest.raises(NotFound):
        csvio.find("nothing.csv", (str(tmp_path),))
    assert csvio.find("else/x.csv", (str(tmp_path),)) == str(path)


def test_coercion(spark, tmp_path):
    """Malformed numbers are 0, overflow and short lines are skipped, missing text is empty."""
    path = tmp_path / "x.csv"
    path.write_text("a,b,c\n1,2.5,x\n3.5,abc,y\n 7 ,1e3,\n9999999999,1,z\n5,1\n\n6\n")
    columns = [{"name": "a", "type": "INT"}, {"name": "b", "type": "FLOAT"}, {"name": "c", "type": "TEXT"}]
    got = sorted(map(tuple, csvio.load(spark, str(path), columns).collect()))
    assert got == [(0, 0.0, "y"), (1, 2.5, "x"), (5, 1.0, ""), (7, 1000.0, "")]
    other = [{"name": "n", "type": "INT"}, {"name": "m", "type": "TEXT"}]
    got = sorted(map(tuple, csvio.load(spark, str(path), other, {"m": 2}).collect()))
    assert got == [(0, "ab"), (0, "b"), (1, "2."), (5, "1"), (6, ""), (7, "1e")]


def test_line_breaks(spark, tmp_path):
    """Quoted fields hold line breaks, commas and quotes; lone quotes within a field stay what they are."""
    path = tmp_path / "x.csv"
    path.write_text('id,note\n1,"a\nb"\n2,"x, ""y"""\n3,5" pipe\n')
    assert csvio.spans_lines(spark, str(path))
    assert [c["type"] for c in csvio.infer(spark, str(path))["columns"]] == ["INT", "TEXT"]
    columns = [{"name": "id", "type": "INT"}, {"name": "note", "type": "TEXT"}]
    assert sorted(map(tuple, csvio.load(spark, str(path), columns).collect())) == [(1, "a\nb"), (2, 'x, "y"'), (3, '5" pipe')]
    path.write_text('id,note\n1,"a, b"\n')
    assert not csvio.spans_lines(spark, str(path))
    assert csvio.load(spark, str(path), columns).first().note == "a, b"


def test_sorted_file(spark, tmp_path):
    """Written in order, in several files, and read back with places; an empty table too."""
    rows = [(i * 7919 % 101, i) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, i int")
    told = sortedfile.write(df, f"{tmp_path}/s", "k")
    assert told["records_written"] == 300 and told["runs_generated"] >= 1 and told["total_sec"] > 0
    got = sortedfile.read(spark, f"{tmp_path}/s").orderBy("place").collect()
    assert [(r.k, r.i) for r in got] == sorted(rows) and [r.place for r in got] == list(range(300))
    df.repartitionByRange(4, "k").sortWithinPartitions("k", "i").write.parquet(f"{tmp_path}/four")
    assert [(r.k, r.i) for r in sortedfile.read(spark, f"{tmp_path}/four").orderBy("place").collect()] == sorted(rows)
    assert sortedfile.write(df.limit(0), f"{tmp_path}/none", "k", descending=True)["records_written"] == 0
    assert sortedfile.read(spark, f"{tmp_path}/none").count() == 0


def test_workspace_needs_a_shared_folder(spark):
    """On a cluster without a shared folder there is no workspace."""

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), {}

    Session.conf = type("Conf", (), {"get": lambda self, name, other: other})()
    with pytest.raises(ValueError, match="checkpoint"):
        workspace(Session())


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(-3, 3), st.integers(-3, 3)), min_size=1, max_size=20), st.integers(-3, 3), st.integers(-3, 3), st.integers(0, 4), st.integers(-1, 25))
def test_spatial(spark, points, cx, cy, r, k):
    """Radius and nearest agree with brute force, the border included."""
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id int, lon double, lat double")
    d = lambda p: math.hypot(p[0] - cx, p[1] - cy)
    assert sorted(x.id for x in X.in_radius(df, "lon", "lat", cx, cy, r).collect()) == [i for i, p in enumerate(points) if d(p) <= r]
    assert [x.id for x in X.nearest(df, "lon", "lat", cx, cy, k).collect()] == sorted(range(len(points)), key=lambda i: (d(points[i]), i))[: max(0, k)]


def test_single_precision(spark):
    """A stored point is a float32: a centre equal to it as a double is not at distance 0."""
    x, y = -86.80275567068401, 33.509721495414745
    df = spark.createDataFrame([(1, x, y)], "id int, lon double, lat double")
    assert X.in_radius(df, "lon", "lat", x, y, 0.0).count() == 0
    assert X.in_radius(df, "lon", "lat", x, y, 0.00001).count() == 1
    assert X.nearest(df.limit(0), "lon", "lat", x, y, 3).count() == 0
    plan = X.in_radius(df, "lon", "lat", x, y, 1.0)._jdf.queryExecution().toString()
    assert "lon" in plan
    with pytest.raises(EngineError):
        X.coordinates(df.drop("lat").schema)


def test_boxes(spark):
    """Leaves hold all points, parents hold their children's boxes, and there is one root."""
    rng = random.Random(3)
    points = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(300)]
    df = spark.createDataFrame(points, "id int, lon double, lat double")
    nodes = X.box_hierarchy(df, "lon", "lat", 8, 4).collect()
    by_level = {}
    for n in nodes:
        by_level.setdefault(n.level, []).append(n)
    assert len(by_level[0]) == 1
    deepest = max(by_level)
    assert all(n.is_leaf == (n.level == deepest) for n in nodes)
    assert sum(n.n_entries for n in by_level[deepest]) == 300
    assert all(n.n_entries <= (8 if n.is_leaf else 4) for n in nodes)
    for level in range(deepest):
        assert sum(n.n_entries for n in by_level[level]) == len(by_level[level + 1])
        for c in by_level[level + 1]:
            assert any(p.min_x <= c.min_x and p.max_x >= c.max_x and p.min_y <= c.min_y and p.max_y >= c.max_y for p in by_level[level])
    assert X.box_hierarchy(df.limit(0), "lon", "lat", 8).count() == 0
    assert [n.n_entries for n in X.box_hierarchy(df.limit(1), "lon", "lat", 8).collect()] == [1]


def test_box_algebra(spark):
    """Area, union, enlargement and distance."""
    box = "named_struct('min_x', {}D, 'min_y', {}D, 'max_x', {}D, 'max_y', {}D)"
    df = spark.sql(f"SELECT {box.format(0, 0, 2, 1)} AS a, {box.format(3, 0, 4, 1)} AS b")
    got = df.select(G.box_area(df.a), G.box_enlargement(df.a, df.b), G.box_distance(df.a, 5.0, 5.0), G.box_distance(df.a, 1.0, 0.5)).first()
    assert tuple(got) == (2.0, 2.0, 5.0, 0.0)


def test_tiles_match_ntile(spark):
    """Distributed tiles equal ntile over all rows."""
    df = spark.createDataFrame([(i, float(i * 7 % 23)) for i in range(101)], "id int, x double")
    df.createOrReplaceTempView("tiles_in")
    for n in (7, 200):
        want = spark.sql(f"SELECT id, ntile({n}) OVER (ORDER BY x, id) AS t FROM tiles_in").collect()
        for rows in (1_000_000, 10):
            got = X.tiles(df, "x", "id", n, "t", range_rows=rows).select("id", "t").collect()
            assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    same = spark.createDataFrame([(i, 1.0) for i in range(60)], "id int, x double")
    got = X.tiles(same, "x", "id", 6, "t", range_rows=10)
    assert [r.t for r in got.orderBy("id").collect()] == [i // 10 + 1 for i in range(60)]


def test_locks():
    """Sharing, exclusion, upgrade and release."""
    m = LockManager()
    assert m.acquire("a", "t", "S") and m.acquire("b", "t", "S")
    assert not m.acquire("a", "t", "X", 0.01)
    m.release("b", "t")
    assert m.acquire("a", "t", "X", 0.01) and not m.acquire("b", "t", "S", 0.01)
    assert m.acquire("a", "t", "S") and m.status() == {"t": {"a": "X"}}
    m.release_all("a")
    assert m.status() == {}


def test_simulator():
    """A deadlock aborts one transaction; without one all commit."""
    calm = Simulator().run([Transaction("T1", [("S", "A", None)]), Transaction("T2", [("S", "A", None)])])
    assert calm.status == {"T1": "COMMITTED", "T2": "COMMITTED"} and not calm.conflicts and not calm.deadlock
    ready = __import__("threading").Barrier(2, timeout=5)
    torn = Simulator().run([Transaction("T1", [("X", "A", ready.wait), ("X", "B", None)]), Transaction("T2", [("X", "B", ready.wait), ("X", "A", None)])])
    assert torn.deadlock and sorted(torn.status.values()) == ["ABORTED", "COMMITTED"]
    assert {c[0] for c in torn.conflicts} == {"W-W"}


@pytest.mark.parametrize(("held", "asked", "want"), [("X", "S", ["R-W"]), ("S", "X", ["W-R"]), ("X", "X", ["W-W"]), ("S", "S", [])])
def test_conflicts(spark, held, asked, want):
    """The requester's letter comes first."""
    log = spark.createDataFrame([("T1", 1, held, "A"), ("T2", 2, asked, "A")], "tx string, seq int, op string, resource string")
    got = C.conflicts(log)
    assert [r.conflict for r in got.collect()] == want
    ended = spark.createDataFrame([("T1", 1)], "tx string, seq int")
    assert C.conflicts(log, ended).count() == 0


def test_conflict_counts(spark, monkeypatch):
    """Counts equal the listed pairs, whatever the buckets; one's own requests and equal numbers don't conflict."""
    rng = random.Random(9)
    log = [(rng.randrange(5), rng.randrange(40), rng.choice("XS"), rng.choice("AB")) for _ in range(60)]
    df = spark.createDataFrame(log, "tx int, seq int, op string, resource string")
    want = sorted(map(tuple, C.conflicts(df).groupBy("resource", "conflict").count().collect()))
    for bucket in (1 << 16, 8):
        monkeypatch.setattr(C, "BUCKET", bucket)
        assert sorted(map(tuple, C.conflict_counts(df).collect())) == want
    assert C.conflict_counts(df.limit(0)).count() == 0


def test_deadlocked(spark):
    """Only transactions on cycles stay."""
    log = [("T1", 1, "X", "A"), ("T2", 2, "X", "B"), ("T1", 3, "X", "B"), ("T2", 4, "X", "A"), ("T3", 5, "S", "A")]
    edges = C.waits(C.conflicts(spark.createDataFrame(log, "tx string, seq int, op string, resource string")))
    assert sorted(r.tx for r in C.deadlocked(edges).collect()) == ["T1", "T2"]
    assert C.deadlocked(edges.where("waiter = 'T3'")).count() == 0


def test_metrics(spark, tmp_path):
    """Entries are timed, saved, read and averaged."""
    m = metrics.Metrics()
    for reads in (1, 3):
        with m.measure("HASH", "search", 10) as e:
            e.reads = reads
    m.save(spark, f"{tmp_path}/m")
    got = metrics.means(metrics.read(spark, f"{tmp_path}/m"), ["structure", "operation", "n"], {"reads": "reads", "time_ms": "ms"}, "entries").first()
    assert (got.reads, got.entries) == (2.0, 2) and got.ms >= 0
    assert "HASH" in m.summary()
