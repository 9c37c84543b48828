"""Endpoint payloads without a transport, and a small HTTP server over them."""

from __future__ import annotations

import json
import time
from datetime import date, datetime
from decimal import Decimal
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

from pyspark.sql import DataFrame

from cairn.engine import Engine, Result
from cairn.errors import EngineError
from cairn.sources import csvio
from cairn.sqlfront import ast
from cairn.sqlfront.parser import parse

#: Rows that an answer may hold; larger results are read with Engine.query.
MOST_ROWS = 100_000


def _plain(v: object) -> object:
    return v.isoformat() if isinstance(v, (date, datetime)) else float(v) if isinstance(v, Decimal) else v


def rows_of(df: DataFrame, most: int = MOST_ROWS) -> list[dict]:
    """A result's rows as dictionaries."""
    return _gathered(df.limit(most + 1), most)


def _gathered(limited: DataFrame, most: int) -> list[dict]:
    found = limited.collect()
    if len(found) > most:
        raise EngineError(f"the result has more than {most} rows")
    names = limited.columns
    return [{n: _plain(v) for n, v in zip(names, r, strict=True)} for r in found]


def operator_rows(df: DataFrame) -> dict[str, int]:
    """What the operators of a collected DataFrame's final plan counted.

    reads: rows that scans gave; matches: rows of joins; groups: rows of final
    aggregates; buckets: partitions of hash exchanges; runs: partitions of range
    exchanges, each one sorted by itself.
    """
    out: dict[str, int] = {}

    def add(name: str, n: int) -> None:
        out[name] = out.get(name, 0) + n

    def walk(node: object) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        counted = node.metrics().get("numOutputRows")
        rows = counted.get().value() if counted.isDefined() else 0
        if kind == "FileSourceScanExec":
            add("reads", rows)
        elif "Join" in kind:
            add("matches", rows)
        elif kind.endswith("AggregateExec") and "functions=[partial_" not in node.simpleString(100):
            add("groups", rows)
        elif kind == "ShuffleExchangeExec":
            parted = node.outputPartitioning()
            of = {"HashPartitioning": "buckets", "RangePartitioning": "runs"}.get(parted.getClass().getSimpleName())
            if of:
                add(of, parted.numPartitions())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out


class Service:
    """The endpoints."""

    def __init__(self, engine: Engine, most_rows: int = MOST_ROWS) -> None:
        self.engine, self.most_rows = engine, most_rows

    def infer_csv(self, path: str, sample_rows: int = csvio.SAMPLE_ROWS) -> dict:
        """Columns suggested for a file."""
        return csvio.infer(self.engine.spark, csvio.find(path, self.engine.csv_folders), sample_rows)

    def tables(self) -> dict:
        """Names of all tables."""
        return {"tables": list(self.engine.catalog.tables)}

    def table(self, name: str) -> dict:
        """What the catalog knows of a table."""
        t = self.engine.catalog.get(name)
        if t.external:
            return {"name": name, "columns": [{"name": c, "type": k} for c, k in self.engine.catalog.read(name).dtypes], "index": "HEAP"}
        return {"name": name, "columns": t.columns, "index": t.index, "key_column": t.key, "record_size": t.record_size(), "column_sizes": t.sizes}

    def drop(self, name: str) -> dict:
        """Drop a table."""
        self.engine.execute(ast.DropTable(name))
        return {"ok": True, "table": name}

    def boxes(self, name: str) -> dict:
        """The bounding-box hierarchy of a spatial table."""
        nodes = rows_of(self.engine.boxes(name), self.most_rows)
        return {"table": name, "mbrs": nodes, "total_nodes": len(nodes), "max_level": max((n["level"] for n in nodes), default=0), "n_points": sum(n["n_entries"] for n in nodes if n["is_leaf"])}

    def _answer(self, result: Result) -> dict:
        """phase1_sec is spent on planning (and, of a change, on all of it), phase2_sec on running a SELECT's plan."""
        began, rows, counted = time.perf_counter(), [], {}
        if result.frame is not None:
            limited = result.frame.limit(self.most_rows + 1)
            rows = _gathered(limited, self.most_rows)
            counted = operator_rows(limited)
        first, second = result.stats.get("time_ms", 0.0) / 1000, time.perf_counter() - began
        stats = {"reads": 0, "writes": result.affected} | counted | {"rows": len(rows), "phase1_sec": first, "phase2_sec": second, "time_ms": (first + second) * 1000}
        return {"ok": True, "type": result.kind, "rows": rows, "affected": result.affected, "stats": stats}

    def query(self, sql: str, column_sizes: dict[str, int] | None = None) -> dict:
        """Run a script: the last statement's rows, the sum of stats, and each statement's answer."""
        statements = parse(sql).statements
        if not statements:
            raise EngineError("the script is empty")
        answers = [self._answer(self.engine.execute(s, column_sizes)) for s in statements]
        if len(answers) == 1:
            return answers[0]
        stats = {k: sum(a["stats"].get(k, 0) for a in answers) for k in dict.fromkeys(k for a in answers for k in a["stats"])}
        return answers[-1] | {"stats": stats, "all_results": answers}


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    """Routes of the HTTP server."""

    class Handler(BaseHTTPRequestHandler):
        """GET /tables, /tables/NAME, /rtree-mbrs/NAME; DELETE /tables/NAME; POST /query, /infer-csv."""

        def _do(self, verb: str) -> None:
            path = [unquote(p) for p in self.path.split("?")[0].strip("/").split("/")]
            try:
                size = int(self.headers.get("Content-Length") or 0)
                body = json.loads(self.rfile.read(size) or b"{}") if verb == "POST" else {}
                routes = {
                    ("GET", "tables", 1): lambda: service.tables(),
                    ("GET", "tables", 2): lambda: service.table(path[1]),
                    ("GET", "rtree-mbrs", 2): lambda: service.boxes(path[1]),
                    ("DELETE", "tables", 2): lambda: service.drop(path[1]),
                    ("POST", "query", 1): lambda: service.query(body["sql"], body.get("column_sizes")),
                    ("POST", "infer-csv", 1): lambda: service.infer_csv(body["path"], int(body.get("sample_rows") or csvio.SAMPLE_ROWS)),
                }
                found = routes.get((verb, path[0], len(path)))
                status, out = (200, found()) if found else (404, {"detail": "no such endpoint"})
            except EngineError as e:
                status, out = e.status, {"detail": str(e)}
            except (KeyError, ValueError) as e:
                status, out = 400, {"detail": f"bad request: {e}"}
            raw = json.dumps(out).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:  # noqa: N802
            """Read."""
            self._do("GET")

        def do_POST(self) -> None:  # noqa: N802
            """Run."""
            self._do("POST")

        def do_DELETE(self) -> None:  # noqa: N802
            """Drop."""
            self._do("DELETE")

        def log_message(self, *args: object) -> None:
            """Say nothing."""

    return Handler


def serve(service: Service, port: int = 8000) -> ThreadingHTTPServer:
    """A server on localhost, not yet started."""
    return ThreadingHTTPServer(("127.0.0.1", port), handler(service))
