"""WARC archives with an external index merge (operator 10).

1. Payload digests are grouped; of equal payloads the capture with the largest
   id is the response and the others revisit it.  What that says of a row goes
   back to it by its address, so payloads are never shuffled.
2. Every task writes its captures as WARC/1.1 records into one gzip file (a
   member per record) in the shared folder.  A file counts once its row stands
   in the stored manifest, so files of lost attempts are never read.
3. The archives are read back record by record.  Each one's index entries are
   sorted by (URL key, timestamp, id) and stored as a run.
4. Keys are cut into ranges of ``RANGE_ROWS`` entries, about.  While there are
   more than ``FAN_IN`` runs, groups of ``FAN_IN`` are merged into longer ones; a task
   merges some ranges of a group, fewer in each round, so every round has as many
   tasks as its input asks for.  At last each range is merged by itself.  Merges
   use a loser tree and hold one batch of rows per run.  Ranges in order give the
   capture histories of all URLs in global order.

The URL key is the host's labels reversed, then path and query.  Pages without a
timestamp column get one second per id from ``EPOCH``.

Nulls: a null payload is empty; a null URL has the empty key; rows without an id
are written too, as revisits where an equal payload has an id.  Repeated rows make
one record each, with a record id of its own; with the response's id they are
responses alike, and the one whose address is largest is the one referred to.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import addressed, attached, bounded_batches, forget, scratch_path, store

EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
FAN_IN = 64
BATCH = 2048
#: Captures of one merged range, on average.
RANGE_ROWS = 20_000
LEVEL = 1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = pa.schema([("url_key", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64())])
_SQL_INDEX = "url_key string, timestamp string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long"


def digest_of(payload: bytes) -> str:
    """Bare base32 SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Host labels reversed and joined by commas, then ')' and the path with its query."""
    try:
        parts = urlsplit((url or "").strip())
        host, path = (parts.hostname or ""), parts.path + ("?" + parts.query if parts.query else "")
    except ValueError:
        host, path = "", url or ""
    return (",".join(reversed(host.lower().split("."))) + ")" + (path or "/")) if host else path


def stamp(page_id: int | None) -> str:
    """The timestamp of a capture that has none."""
    return (EPOCH + timedelta(seconds=(page_id or 0) % (1 << 35))).strftime("%Y-%m-%dT%H:%M:%SZ")


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a URI that all executors reach."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri else pafs.FileSystem.from_uri(uri.replace("file:", "file://") if uri.startswith("file:") else "file://" + uri)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record as one gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", LEVEL, mtime=0)


def capture(page_id: int | None, url: str | None, time: str, payload: bytes, digest: str, kind: str, refers_to: int | None, record_id: str, refers_to_record: str | None = None) -> bytes:
    """The record of a page: an HTTP response, or a revisit without payload."""
    named = lambda i: uuid.uuid5(uuid.NAMESPACE_URL, f"capture:{i}").urn
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<{named(record_id)}>"), ("WARC-Date", time), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("X-Page-ID", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(len(payload)))]
    if kind == "revisit":
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{named(refers_to_record)}>"), ("X-Refers-To-Page-ID", "" if refers_to is None else str(refers_to))]
    return record(headers, http if kind == "revisit" else http + payload)


def read_records(stream: io.BufferedIOBase) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record of a gzip WARC whose members are records."""
    import zlib

    offset, left = 0, b""
    while True:
        unzip, parts, begin = zlib.decompressobj(31), [], offset
        while not unzip.eof:
            if not left:
                left = stream.read(1 << 20)
                if not left:
                    if parts:
                        raise EOFError("a WARC member is cut off")
                    return
            parts.append(unzip.decompress(left))
            offset += len(left) - len(unzip.unused_data)
            left = unzip.unused_data
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        yield begin, headers, rest[: int(headers["Content-Length"])]


class LoserTree:
    """Merges sorted iterators of tuples: each inner node keeps the loser of its two subtrees."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs = runs
        self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None if x is None else y is None or (x, a) <= (y, b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) >> 1
        while node:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = winner
                return
            if not self._beats(winner, other):
                self.losers[node], winner = winner, other
            node >>= 1
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[best := self.losers[0]]) is not None:
            yield head
            self.heads[best] = next(self.runs[best], None)
            self._play(best)


def _key(row: tuple) -> tuple:
    return (row[0], row[1], -1 if row[2] is None else row[2])


def _run_rows(path: str, low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """A run's rows with keys in [low, high), each as (key, row), reading only row groups that can hold them."""
    fs, name = _open(path)
    with fs.open_input_file(name) as f:
        file = pq.ParquetFile(f)
        for g in range(file.num_row_groups):
            stats = file.metadata.row_group(g).column(0).statistics
            if stats is not None and stats.has_min_max and ((low and stats.max < low[0]) or (high and stats.min > high[0])):
                continue
            for batch in file.iter_batches(BATCH, row_groups=[g]):
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    key = _key(row)
                    if (low is None or key >= low) and (high is None or key < high):
                        yield key, row


def _tables(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)


def merged(paths: list[str], low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """Rows of all runs in [low, high) in order."""
    for _, row in LoserTree([_run_rows(p, low, high) for p in paths]):
        yield row


def _write(folder: str):
    """Writes the captures of a task into one archive; yields its path and records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                rows = batch.slice(low, 256).to_pylist()
                if rows and out is None:
                    fs, local = _open(name)
                    fs.create_dir(local.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(local, compression=None)
                    out.write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", stamp(0)), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                for r in rows:
                    payload = (r["payload"] or "").encode()
                    out.write(capture(r["page_id"], r["url"], r["timestamp"] or stamp(r["page_id"]), payload, base64.b32encode(bytes.fromhex(r["sha1"])).decode(), r["record_type"], r["refers_to"], r["record_id"], r["refers_to_record"]))
                    n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "records"])

    return run


def _index(folder: str):
    """Reads archives back; each one's sorted index becomes a run.  Yields run, rows and its keys at even steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, (fs, local) = [], _open(name)
                with fs.open_input_stream(local, compression=None) as f:
                    for offset, head, block in read_records(f):
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        number = lambda k: int(head[k]) if head.get(k) else None  # noqa: B023, E731
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = int(head["X-Payload-Length"])
                        if head["WARC-Type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if (size, digest) != (len(payload), digest_of(payload)):
                                raise ValueError(f"a record of {name} doesn't match its digest")
                        rows.append((url_key(head.get("WARC-Target-URI")), head["WARC-Date"], number("X-Page-ID"), size, digest, head["WARC-Type"], number("X-Refers-To-Page-ID"), name, offset))
                rows.sort(key=_key)
                target = f"{folder}/{uuid.uuid4().hex}.parquet"
                fs, local = _open(target)
                fs.create_dir(local.rpartition("/")[0], recursive=True)
                with pq.ParquetWriter(local, _INDEX, filesystem=fs) as out:
                    for part in _tables(rows, _INDEX):
                        out.write_batch(part)
                step = max(1, len(rows) // 64)
                for r in rows[::step]:
                    yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([len(rows)], pa.int64()), pa.array([r[0]]), pa.array([r[1]]), pa.array([_key(r)[2]], pa.int64())], names=["run", "rows", "url_key", "timestamp", "page_id"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([*_INDEX, ("part", pa.int64()), ("place", pa.int64())])
    for batch in batches:
        for r in batch.to_pylist():
            low, high = (tuple(r[k].values()) if r[k] else None for k in ("low", "high"))
            yield from _tables(((*row, r["part"], i) for i, row in enumerate(merged(r["runs"], low, high))), schema)


def _longer(folder: str):
    """Merges a range of some runs into a file; yields the group, the range and the path, or none if it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                low, high = (tuple(r[k].values()) if r[k] else None for k in ("low", "high"))
                target, out = f"{folder}/{uuid.uuid4().hex}.parquet", None
                for part in _tables(merged(r["runs"], low, high), _INDEX):
                    if out is None:
                        fs, local = _open(target)
                        fs.create_dir(local.rpartition("/")[0], recursive=True)
                        out = pq.ParquetWriter(local, _INDEX, filesystem=fs)
                    out.write_batch(part)
                if out is not None:
                    out.close()
                    yield pa.RecordBatch.from_arrays([pa.array([r["part"]], pa.int64()), pa.array([r["first"]], pa.int64()), pa.array([r["last"]], pa.int64()), pa.array([target])], names=["part", "first", "last", "run"])

    return run


def captured(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", timestamp: str | None = None, least: int = 0) -> DataFrame:
    """The captures with digest, record_type and refers_to decided; payloads below ``least`` bytes are never revisits."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = df.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), (F.col(timestamp).cast("string") if timestamp else F.lit(None).cast("string")).alias("timestamp"), body.alias("payload"), F.sha1(body.cast("binary")).alias("sha1"))
    rows = addressed(rows)
    at = F.struct("page_id", "_file", "_row")
    narrow = store(rows.where(F.octet_length("payload") >= least).select("sha1", "page_id", "_file", "_row"), "digests")
    latest = narrow.groupBy("sha1").agg(F.max(at).alias("latest"), F.count("*").alias("copies")).where("copies > 1 AND latest.page_id IS NOT NULL").select("sha1", "latest")
    later = narrow.join(store(latest, "latest"), "sha1").where("NOT page_id <=> latest.page_id")
    verdicts = store(later.select("_file", "_row", F.col("latest.page_id").alias("refers_to"), record_name(*[F.col(f"latest.{c}") for c in ("page_id", "_file", "_row")]).alias("refers_to_record")), "revisits")
    rows = attached(rows, verdicts, ["_file", "_row"], "left")
    kind = F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response")
    return rows.select("page_id", "url", "timestamp", "payload", "sha1", kind.alias("record_type"), "refers_to", record_name(*map(F.col, ("page_id", "_file", "_row"))).alias("record_id"), "refers_to_record")


def record_name(page_id: Column, file: Column, row: Column) -> Column:
    """What a record's id is made from: the page and where it stands."""
    return F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("")), file.cast("string"), row.cast("string"))


def archive(rows: DataFrame) -> DataFrame:
    """Write captured() rows as WARC files; the stored manifest has file and records."""
    bounded_batches(rows.sparkSession)
    spark = rows.sparkSession
    return store(rows.mapInArrow(_write(scratch_path(spark, "warc")), "file string, records long"), "manifest")


def _within(runs: list[list[tuple[int, int, str]]], first: int, last: int) -> list[str]:
    """The files of runs that may hold rows of the ranges from first to last."""
    return [file for run in runs for a, b, file in run if a < last and first < b]


def _merged_groups(spark: SparkSession, groups: list[list[list[tuple[int, int, str]]]], edges: list[tuple | None], wide: int, spec: str) -> list[list[tuple[int, int, str]]]:
    """Each group of runs as one run, by tasks of ``wide`` ranges."""
    ranges = len(edges) - 1
    tasks = []
    for g, group in enumerate(groups):
        for first in range(0, ranges, wide):
            last = min(ranges, first + wide)
            tasks.append((g, first, last, edges[first], edges[last], _within(group, first, last)))
    longer = spark.createDataFrame(tasks, spec).repartition(len(tasks), "part", "first").mapInArrow(_longer(scratch_path(spark, "runs")), "part long, first long, last long, run string")
    stored = store(longer, "longer")
    out: list[list[tuple[int, int, str]]] = [[] for _ in groups]
    for r in stored.orderBy("part", "first").collect():  # a row per file
        out[r.part].append((r.first, r.last, r.run))
    forget(stored)
    return out


def histories(manifest: DataFrame) -> DataFrame:
    """Index entries of all archives, stored; ``place`` numbers them from 0 in global order of URL key, timestamp and id."""
    spark = manifest.sparkSession
    files = manifest.count()
    marks = store(manifest.select("file").repartition(max(1, files), "file").mapInArrow(_index(scratch_path(spark, "runs")), "run string, rows long, url_key string, timestamp string, page_id long"), "marks")
    listed = marks.select("run", "rows").distinct().collect()  # a row per archive
    runs, total = sorted(r.run for r in listed), sum(r.rows for r in listed)
    parts = max(1, -(-total // RANGE_ROWS))
    edges: list[tuple | None] = [None, None]
    if parts > 1:
        # Ranges of the marks, dealt by a sample of them: any bounds are right, and even ones are quick.
        ordered = marks.select("url_key", "timestamp", "page_id").repartitionByRange(parts, "url_key", "timestamp", "page_id")
        found = ordered.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("url_key", "timestamp", "page_id")).alias("low")).collect()  # a row per range
        edges = [None, *sorted({tuple(r.low) for r in found})[1:], None]
    key = "struct<url_key:string,timestamp:string,page_id:long>"
    spec = f"part long, first long, last long, low {key}, high {key}, runs array<string>"
    ranges = len(edges) - 1
    # A run is a list of (first range, last range, file) in order.
    held = [[(0, ranges, r)] for r in runs]
    while len(held) > FAN_IN:
        groups = [held[i : i + FAN_IN] for i in range(0, len(held), FAN_IN)]
        of_group = max(1, -(-total // (len(groups) * RANGE_ROWS * FAN_IN)))  # tasks
        held = _merged_groups(spark, groups, edges, -(-ranges // of_group), spec)
    tasks = [(i, i, i + 1, edges[i], edges[i + 1], _within(held, i, i + 1)) for i in range(ranges)]
    rows = store(spark.createDataFrame(tasks, spec).repartition(ranges, "part").mapInArrow(_merge, f"{_SQL_INDEX}, part long, place long"), "histories")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("start"))
    return rows.join(starts, "part").withColumn("place", F.col("place") + F.col("start")).drop("part", "start")


def op10_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC, read back and merged."""
    return histories(archive(captured(spark.read.parquet(f"{sf_dir}/pages.parquet")))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp", "place")


def sql_op10() -> str:
    """The same rows in DuckDB SQL, for http and https URLs."""
    letter = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(h, CAST(i // 8 * 10 + 1 AS BIGINT), 10))::BIGINT >> CAST(35 - i % 8 * 5 AS BIGINT)) & 31) + 1 AS BIGINT), 1)"
    host = "lower(regexp_extract(url, '^[a-z]+://([^/?]*)', 1))"
    path = "regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-z]+://[^/?]*', '')"
    return f"""
WITH rows AS (SELECT page_id, url, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
keyed AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: {letter}), '') AS payload_digest,
  max(page_id) OVER (PARTITION BY h) AS latest, array_to_string(list_reverse(string_split({host}, '.')), ',') || ')' || CASE WHEN {path} = '' THEN '/' ELSE {path} END AS url_key,
  strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS timestamp FROM rows)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> latest THEN latest END AS refers_to,
  url_key, timestamp, row_number() OVER (ORDER BY url_key, timestamp, page_id) - 1 AS place FROM keyed"""
