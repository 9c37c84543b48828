"""Tables, statements and services against hand-made rows."""

import json
import random
import threading
import urllib.request

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.engine import Engine, Result
from cairn.errors import AlreadyExists, EngineError, NotFound
from cairn.operators import spatial
from cairn.plans import layout
from cairn.service import Service, serve

STUDENTS = """id,name,age,carrera
1,Ana,20,Fisica
2,Luis,22,Quimica
3,Eva,19,Fisica
4,"Paz, Luz",20,Biologia
5,Leo,24,Biologia
"""


@pytest.fixture
def engine(spark, warehouse, tmp_path):
    """An engine with a students table."""
    (tmp_path / "students.csv").write_text(STUDENTS)
    e = Engine(spark, warehouse, (str(tmp_path),))
    e.run("CREATE TABLE students (id INT INDEX BPLUSTREE, name TEXT, age INT, carrera TEXT) FROM FILE 'students.csv'")
    return e


def rows(df):
    """Rows as sorted tuples."""
    return sorted(map(tuple, df.collect()), key=repr)


def test_reads(engine):
    """Predicates, projection, groups and orders compose."""
    q = engine.query
    assert [r.id for r in q("SELECT id FROM students WHERE id BETWEEN 2 AND 4 ORDER BY id DESC").collect()] == [4, 3, 2]
    assert rows(q("SELECT name FROM students WHERE age = 20")) == [("Ana",), ("Paz, Luz",)]
    assert rows(q("SELECT carrera, COUNT(*) AS n, AVG(age) AS a FROM students GROUP BY carrera")) == [("Biologia", 2, 22.0), ("Fisica", 2, 19.5), ("Quimica", 1, 22.0)]
    assert rows(q("SELECT COUNT(name), MIN(name), MAX(age) FROM students WHERE carrera = 'Fisica'")) == [(2, "Ana", 20)]
    assert [r.n for r in q("SELECT carrera, COUNT(*) AS n FROM students GROUP BY carrera ORDER BY n").collect()] == [1, 2, 2]
    assert rows(q("SELECT * FROM students WHERE age = 'x'")) == [] == rows(q("SELECT * FROM students WHERE name = 5"))
    assert [r.id for r in engine.scan("students").collect()] == [1, 2, 3, 4, 5]
    assert rows(engine.search("students", lambda df: df.age > 22)) == [(5, "Leo", 24, "Biologia")]
    for bad in ("SELECT x FROM students", "SELECT * FROM students WHERE x = 1", "SELECT * FROM students ORDER BY x", "SELECT name, COUNT(*) FROM students GROUP BY carrera", "SELECT SUM(name) FROM students", "SELECT * FROM students WHERE name BETWEEN 1 AND 2"):
        with pytest.raises(EngineError):
            q(bad)
    with pytest.raises(NotFound):
        q("SELECT * FROM nobody")


def test_changes(engine, spark):
    """Inserts fill up with defaults; deletes take exactly what matches; a reopened warehouse has it all."""
    engine.run("INSERT INTO students VALUES (26, 'Zoe'); INSERT INTO students VALUES (26, 'Zoe', 1, 'x'), (27, 'Al', 2.9)")
    assert rows(engine.query("SELECT * FROM students WHERE id = 26")) == [(26, "Zoe", 0, ""), (26, "Zoe", 1, "x")]
    assert rows(engine.query("SELECT age FROM students WHERE id = 27")) == [(2,)]
    assert engine.run("DELETE FROM students WHERE carrera = 'Fisica'")[0].affected == 2
    assert engine.run("DELETE FROM students WHERE id = 26")[0].affected == 2
    assert engine.run("DELETE FROM students WHERE id = 'x'")[0].affected == 0
    again = Engine(spark, engine.catalog.warehouse)
    assert rows(again.query("SELECT id FROM students")) == [(2,), (27,), (4,), (5,)]
    with pytest.raises(AlreadyExists):
        again.run("CREATE TABLE students (id INT)")
    again.run("DROP TABLE students; CREATE TABLE students (id INT)")
    assert rows(again.query("SELECT COUNT(*), SUM(id) FROM students")) == [(0, None)]
    for bad in ("INSERT INTO students VALUES (1, 2)", "INSERT INTO students VALUES (99999999999)", "INSERT INTO students VALUES ('a')"):
        with pytest.raises(EngineError):
            again.run(bad)


def test_compaction(engine, monkeypatch):
    """After enough small appends the table is written anew."""
    monkeypatch.setattr(layout, "MOST_DELTAS", 3)
    for i in range(4):
        engine.run(f"INSERT INTO students VALUES ({100 + i}, 'n')")
    assert engine.catalog.get("students").deltas == 1
    assert engine.query("SELECT COUNT(*) AS n FROM students").first().n == 9


def test_joins(engine, spark):
    """Keys by prefix or place; numbers across types; text never equals numbers; NaN never joins; self-joins keep both sides."""
    engine.run("CREATE TABLE c (carrera TEXT, f FLOAT); INSERT INTO c VALUES ('Fisica', 20), ('Fisica', 22.0), ('Otra', 1)")
    q = engine.query
    assert q("SELECT * FROM students JOIN c ON c.carrera = students.carrera").columns == ["students.id", "students.name", "students.age", "students.carrera", "c.carrera", "c.f"]
    assert q("SELECT * FROM students JOIN c ON carrera = carrera").count() == 4
    assert rows(q("SELECT id FROM students JOIN c ON age = f WHERE c.carrera = 'Fisica' ORDER BY id")) == [(1,), (2,), (4,)]
    assert q("SELECT * FROM students JOIN c ON id = c.carrera").count() == 0
    assert q("SELECT COUNT(*) AS n FROM students JOIN students ON age = age").first().n == 7
    assert "students_right.id" in q("SELECT * FROM students JOIN students ON age = age").columns
    engine.append("c", spark.createDataFrame([("n", float("nan"))], "carrera string, f double"))
    assert q("SELECT * FROM c JOIN c ON f = f").count() == 3
    with pytest.raises(EngineError):
        q("SELECT carrera FROM students JOIN c ON age = f")


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(-5, 5), st.sampled_from(["a", "b", ""])), max_size=12), st.integers(-5, 5), st.integers(-5, 5))
def test_layouts_agree(spark, tmp_path_factory, given_rows, a, b):
    """Every predicate gives the same rows on every layout of several files, and DELETE leaves the complement."""
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('w')}", file_rows=3)
    want = sorted(given_rows)
    for index in ("HEAP", "SEQUENTIAL", "HASH", "BPLUSTREE"):
        e.create_from(index.lower(), spark.createDataFrame(given_rows, "k int, v string"), index, "k")
        q = lambda text, index=index: sorted(map(tuple, e.query(text.format(index.lower())).collect()))
        assert q("SELECT * FROM {}") == want
        assert q(f"SELECT * FROM {{}} WHERE k = {a}") == [r for r in want if r[0] == a]
        assert q(f"SELECT * FROM {{}} WHERE k BETWEEN {a} AND {b}") == [r for r in want if a <= r[0] <= b]
        assert q("SELECT * FROM {} WHERE v = 'a'") == [r for r in want if r[1] == "a"]
        e.run(f"DELETE FROM {index.lower()} WHERE k = {a}")
        assert q("SELECT * FROM {}") == [r for r in want if r[0] != a]


def test_service(engine, tmp_path):
    """Payloads, several statements, and HTTP."""
    s = Service(engine)
    assert s.tables() == {"tables": ["students"]} and s.table("students")["key_column"] == "id"
    got = s.query("INSERT INTO students VALUES (9, 'x'); SELECT id FROM students WHERE id = 9")
    assert got["rows"] == [{"id": 9}] and len(got["all_results"]) == 2 and got["stats"]["writes"] == 1
    with pytest.raises(EngineError):
        Service(engine, 2).query("SELECT * FROM students")
    server = serve(s, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    body = json.dumps({"sql": "SELECT COUNT(*) AS n FROM students"}).encode()
    assert json.load(urllib.request.urlopen(urllib.request.Request(f"{url}/query", body)))["rows"] == [{"n": 6}]
    with pytest.raises(urllib.error.HTTPError) as e:
        urllib.request.urlopen(f"{url}/tables/nobody")
    assert e.value.code == 404
    stats = s.query("SELECT carrera, COUNT(*) AS n FROM students GROUP BY carrera ORDER BY n")["stats"]
    assert stats["reads"] == 6 and stats["groups"] == 4 and stats["rows"] == 4 and stats["phase1_sec"] >= 0 and stats["phase2_sec"] > 0
    assert s.query("SELECT students.id FROM students JOIN students ON age = age")["stats"]["matches"] == 8
    assert s.query("SELECT * FROM students WHERE id = 3")["stats"]["reads"] >= 1
    assert s.drop("students")["ok"] and s.tables() == {"tables": []}
    server.shutdown()


def test_stream(engine, spark, tmp_path):
    """A stream appends its rows once, restarts included."""
    from cairn.streaming.appends import append_stream

    engine.run("CREATE TABLE s (k INT, v TEXT)")
    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(folder)
    for _ in range(2):
        append_stream(engine, "s", spark.readStream.schema("k int, v string").parquet(folder), str(tmp_path / "cp")).awaitTermination()
        assert rows(engine.query("SELECT * FROM s")) == [(1, "a"), (2, "b")]


def test_files(spark, warehouse):
    """A layout deals rows to as many files as their number asks for; files of sorted layouts don't overlap."""
    e = Engine(spark, warehouse, file_rows=100)
    rng = random.Random(4)
    rows = spark.createDataFrame([(i, rng.uniform(0, 10), rng.uniform(0, 10)) for i in range(900)], "k int, lon double, lat double")
    for index in ("SEQUENTIAL", "BPLUSTREE", "HASH", "RTREE"):
        name = index.lower()
        assert e.create_from(name, rows, index, "k") == 900
        files = e.catalog.read(name).groupBy(F.col("_metadata.file_name")).agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("k", "lon", "lat") for f in (F.min, F.max)]).collect()
        assert len(files) > 4
        if index in ("SEQUENTIAL", "BPLUSTREE"):
            spans = sorted((f.min_k, f.max_k) for f in files)
            assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
        if index == "RTREE":
            assert sum((f.max_lon - f.min_lon) * (f.max_lat - f.min_lat) for f in files) < 300  # 900 if each had all
            assert e.boxes(name).where("is_leaf").agg(F.sum("n_entries")).first()[0] == 900
            assert e.query("SELECT * FROM rtree WHERE p IN (POINT(5, 5), RADIUS 2.5)").count() == rows.where((F.col("lon").cast("float") - 5) ** 2 + (F.col("lat").cast("float") - 5) ** 2 <= 6.25).count()
    assert e.create_from("heap", rows.repartition(5)) == 900
    assert e.catalog.read("heap").select("_metadata.file_name").distinct().count() == 5


def test_many_searches(spark, warehouse):
    """Many keys or ranges at once give what they give one by one."""
    e = Engine(spark, warehouse, file_rows=20)
    for index in ("SEQUENTIAL", "HASH", "BPLUSTREE"):
        e.create_from(index.lower(), spark.createDataFrame([(i % 50, f"v{i}") for i in range(100)], "k int, v string"), index, "k")
        assert rows(e.search_many(index.lower(), [3, 7, 3, 99, "x"])) == rows(e.query(f"SELECT * FROM {index.lower()} WHERE k BETWEEN 3 AND 7").where("k IN (3, 7)"))
        got = rows(e.range_many(index.lower(), [(3, 5), (5, 6), (60, 70), (9, 1)]))
        assert got == sorted(((k, f"v{k + 50 * j}", a, b) for a, b in ((3, 5), (5, 6)) for k in range(a, b + 1) for j in (0, 1)), key=repr)
        assert e.range_many(index.lower(), []).count() == 0 == e.search_many(index.lower(), []).count()


def test_appends_fit(spark, warehouse):
    """Mistyped rows are refused and change nothing; fitting ones are cast; a batch counts once; replaced versions stay readable."""
    e = Engine(spark, warehouse)
    e.run("CREATE TABLE t (k INT INDEX HASH, v FLOAT)")
    for bad in ("k string, v double", "k int, v string", "k int, w double", "k int, v double, x int", "k double, v double"):
        with pytest.raises(EngineError):
            e.append("t", spark.createDataFrame([], bad))
    e.append("t", spark.createDataFrame([(2.5, 1)], "v float, k long"))
    with pytest.raises(Exception, match="OVERFLOW"):
        e.append("t", spark.createDataFrame([(1 << 40, 1.0)], "k long, v double"))
    one = spark.createDataFrame([(7, 7.0)], "k int, v double")
    assert [e.append("t", one, ("s", n)) for n in (0, 0, 1, 0)] == [True, False, True, False]
    before = e.query("SELECT * FROM t")
    for _ in range(3):
        e.run("DELETE FROM t WHERE k = 7; INSERT INTO t VALUES (8, 8)")
    assert rows(before) == [(1, 2.5), (7, 7.0), (7, 7.0)]
    again = Engine(spark, warehouse, keep_seconds=0.0)
    assert rows(again.query("SELECT * FROM t")) == [(1, 2.5), (8, 8.0), (8, 8.0), (8, 8.0)]
    assert not again.append("t", one, ("s", 1))
    again.compact("t")
    assert again.catalog.get("t").retired == [] and again.query("SELECT * FROM t").count() == 4


def test_hooks_and_boxes(spark, warehouse):
    """A hook answers in the engine's stead; the box endpoint tells its nodes, and refuses what is no RTREE."""
    seen = []
    e = Engine(spark, warehouse, hooks={"DropTable": lambda s: seen.append(s.table) or Result("DROP_TABLE"), "Insert": lambda s: None})
    e.run("CREATE TABLE p (id INT, lon FLOAT INDEX RTREE, lat FLOAT); INSERT INTO p VALUES (1, 1, 2), (2, 3, 5); DROP TABLE p")
    assert seen == ["p"] and e.query("SELECT * FROM p").count() == 2
    found = Service(e).boxes("p")
    assert (found["total_nodes"], found["max_level"], found["n_points"]) == (1, 0, 2)
    assert [found["mbrs"][0][c] for c in ("min_x", "min_y", "max_x", "max_y")] == [1, 2, 3, 5]
    e.run("CREATE TABLE h (id INT)")
    for name in ("h", "nobody"):
        with pytest.raises(EngineError):
            Service(e).boxes(name)


# Students with the counts, sums and extremes that the goldens give.
AGES = {"Arquitectura": [19, 20], "Biologia": [19, 19, 19, 24], "Computacion": [20, 20, 20, 20, 22, 23], "Fisica": [21, 21, 21, 22], "Ingenieria": [20, 22, 22, 24], "Matematica": [21, 22, 22], "Quimica": [22, 23]}
TWENTY = [1, 4, 9, 13, 18, 23]


def test_students_goldens(spark, warehouse, tmp_path):
    """Counts, sums, means and extremes by group, deletes, inserts and loading by position."""
    people = [(c, a) for c, ages in AGES.items() for a in ages]
    ids = {20: iter(TWENTY), 0: iter([i for i in range(1, 26) if i not in TWENTY])}
    lines = [f"{next(ids[a if a == 20 else 0])},n{i},{a},{c}" for i, (c, a) in enumerate(people)]
    (tmp_path / "s.csv").write_text("id,name,age,carrera\n" + "\n".join(lines) + "\n")
    e = Engine(spark, warehouse, (str(tmp_path),))
    e.run("CREATE TABLE s (id INT INDEX BPLUSTREE, name TEXT, age INT, carrera TEXT) FROM FILE 's.csv'")
    q = lambda text: rows(e.query(text))
    assert e.query("SELECT * FROM s").count() == 25
    assert [r.id for r in e.query("SELECT id FROM s WHERE id BETWEEN 5 AND 10 ORDER BY id").collect()] == [5, 6, 7, 8, 9, 10]
    assert q("SELECT id FROM s WHERE age = 20 ORDER BY id") == sorted(((i,) for i in TWENTY), key=repr)
    assert q("SELECT carrera, COUNT(*) AS n, SUM(age) AS s, MIN(age) AS a, MAX(age) AS b FROM s GROUP BY carrera") == sorted((c, len(a), sum(a), min(a), max(a)) for c, a in AGES.items())
    assert [round(r.m, 4) for r in e.query("SELECT carrera, AVG(age) AS m FROM s GROUP BY carrera ORDER BY carrera").collect()] == [19.5, 20.25, 20.8333, 21.25, 22.0, 21.6667, 22.5]
    e.run("DELETE FROM s WHERE id = 7")
    assert q("SELECT COUNT(*) FROM s") == [(24,)]
    e.run("INSERT INTO s VALUES (26, 'Zoe')")
    assert q("SELECT * FROM s WHERE id = 26") == [(26, "Zoe", 0, "")]
    e.run("CREATE TABLE p (sid INT, nm TEXT, ag INT, ca TEXT) FROM FILE 's.csv'")
    assert e.query("SELECT * FROM p").count() == 26 and (0, "name", 0, "carrera") in q("SELECT * FROM p")
    e.run("CREATE TABLE f (id INT INDEX HASH, name TEXT, age INT, carrera TEXT) FROM FILE 's.csv'; DELETE FROM f WHERE carrera = 'Fisica'")
    assert q("SELECT COUNT(*) FROM f") == [(21,)]


# Places, and the corners of the others' box.
PLACES = """Alabama,Auburn,32.606812966051244,-85.48732833164195
Alabama,Birmingham,33.509721495414745,-86.80275567068401
Alabama,Birmingham,33.59558141391436,-86.64743684970283
Alabama,Birmingham,33.42258214624579,-86.6982794650297
Alabama,Cullman,34.15413376734492,-86.84122007667406
Alabama,Hoover,33.378958029568594,-86.80380210088629
Alabama,Huntsville,34.742319254429496,-86.6657204641674
Alabama,Mobile,30.675337809949887,-88.143753929995
Alabama,Mobile,30.68273057569605,-88.22499815689844
Alabama,Montgomery,32.35917687650774,-86.16225285227608
Alabama,Opelika,32.616808752194316,-85.40447876717928
Alabama,Prattville,32.459169,-86.391343
Alabama,Tuscaloosa,33.21066866513092,-87.55362088910408
Alabama,Tuscaloosa,33.19675499999999,-87.52704204662706
Alabama,Vestavia Hills,33.439069161673594,-86.78828456747647
"""


def test_places_goldens(spark, warehouse, tmp_path):
    """Radius, nearest and boxes with single-precision points."""
    far = [f"Arizona,A{i},{33 + i % 7 / 10},{-112 - i % 5 / 10}" for i in range(42)] + ["Arizona,North,35.224117279052734,-111.5", "Arizona,West,33.5,-114.34551239013672"]
    (tmp_path / "c.csv").write_text("state,location,latitude,longitude\n" + PLACES + "\n".join(far) + "\n")
    e = Engine(spark, warehouse, (str(tmp_path),), file_rows=10)
    e.run("CREATE TABLE c (state TEXT, location TEXT, latitude FLOAT, longitude FLOAT INDEX RTREE) FROM FILE 'c.csv'")
    near = lambda what: e.query(f"SELECT * FROM c WHERE p IN (POINT(-86.80275567068401, 33.509721495414745), {what})")
    assert [near(f"RADIUS {r}").count() for r in (0.2, 1.0, 0)] == [5, 8, 0]
    assert [r.location for r in near("K 5").collect()] == ["Birmingham", "Vestavia Hills", "Hoover", "Birmingham", "Birmingham"]
    got = spatial.nearest(e.catalog.read("c"), "longitude", "latitude", -86.80275567068401, 33.509721495414745, 5, keep_distance=True)
    assert [round(r.dist, 6) for r in got.collect()] == [0.000002, 0.07212, 0.130766, 0.136046, 0.17747]
    assert rows(e.query("SELECT state, COUNT(*) AS n FROM c GROUP BY state")) == [("Alabama", 15), ("Arizona", 44)]
    root = next(n for n in Service(e).boxes("c")["mbrs"] if n["level"] == 0)
    assert [root[k] for k in ("min_x", "max_x", "min_y", "max_y")] == [-114.34551239013672, -85.40447998046875, 30.675338745117188, 35.224117279052734]


def test_results_goldens(spark, warehouse, tmp_path):
    """Sums and means of goals, and headers that are renamed."""
    goals = {"W": [3] * 5 + [2] * 21, "D": [2] * 3 + [1] * 14 + [0] * 2, "L": [1] * 11 + [0] * 3}
    lines = [f"{r},{g},{'Melgar' if i < 26 else 'Juan Aurich'},León Huánuco,\"1,877\"" for i, (r, g) in enumerate((r, g) for r, own in goals.items() for g in own)]
    (tmp_path / "l.csv").write_text("Result,GF,Team,Opp Formation,Attendance\n" + "\n".join(lines) + "\n")
    e = Engine(spark, warehouse, (str(tmp_path),))
    assert [c["type"] for c in Service(e).infer_csv("l.csv")["columns"]] == ["TEXT", "INT", "TEXT", "TEXT", "TEXT"]
    e.run("CREATE TABLE l (Result TEXT, GF INT, Team TEXT, Opp_Formation TEXT, Attendance TEXT) FROM FILE 'l.csv'")
    assert rows(e.query("SELECT Result, COUNT(*) AS n, SUM(GF) AS s FROM l GROUP BY Result")) == [("D", 19, 20), ("L", 14, 11), ("W", 26, 57)]
    assert [round(r.a, 5) for r in e.query("SELECT Result, AVG(GF) AS a FROM l GROUP BY Result ORDER BY Result").collect()] == [1.05263, 0.78571, 2.19231]
    assert rows(e.query("SELECT Team, COUNT(*) AS n FROM l GROUP BY Team")) == [("Juan Aurich", 33), ("Melgar", 26)]
    assert rows(e.query("SELECT Opp_Formation, Attendance FROM l WHERE GF = 3"))[0] == ("León Huánuco", "1,877")
