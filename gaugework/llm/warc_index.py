"""WARC archives of pages, and a globally ordered capture index by an external merge.

1. Pages with equal payloads are counted by digest; the one with the smallest id is a response, the others revisit it.
2. Each task writes its records, one gzip member each, to archives in the shared folder. A file's name is new for each
   attempt of a task, and only files that a finished task reports are read.
3. The archives are read back. Payload digests are checked; index rows are sorted locally into runs of bounded length.
4. Runs are cut at range bounds of (URL key, time, id), so a hot URL is cut too, and each range merges its pieces of the
   runs with a loser tree.

Defined cases: a null page is an empty payload; a null URL is written as ``about:invalid``; a null id is written as no
id, and such a row is a response only if no row of its payload has an id; rows that repeat the smallest id are all
responses; an empty table gives no rows. The folder must be one that ``pyarrow.fs`` opens (local, HDFS, S3, GCS, ABFS).
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm.common import small_batches, table
from gaugework.llm.registry import query
from gaugework.session import fresh_path, materialise, small_side

FILE_BYTES = 256 << 20
RUN_ROWS = 100_000
FIRST_CAPTURE = datetime.datetime(2024, 1, 1)
CAPTURE_SPAN_S = 10 * 365 * 86_400
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:page").int >> 64 << 64

MANIFEST = "path string, records long, bytes long"
INDEX = pa.schema([
    ("url_key", pa.string()), ("captured_at", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("path", pa.string()),
    ("offset", pa.int64()), ("length", pa.int64()), ("run", pa.string()),
])
INDEX_DDL = ("url_key string, captured_at string, page_id long, payload_bytes long, payload_digest string, "
             "record_type string, refers_to long, path string, offset long, length long, run string")


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=PAGE_SPACE | page_id % 2**64) if page_id is not None else uuid.uuid4()}>"


def page_of(record: str | None) -> int | None:
    """The page id that a record id stands for."""
    number = uuid.UUID(record[10:-1]).int if record else 0
    if number >> 64 << 64 != PAGE_SPACE:
        return None
    low = number % 2**64
    return low - 2**64 if low >= 2**63 else low


def capture_time(page_id: int | None) -> str:
    """Pages carry no time, so the id gives one: so many seconds after a fixed start, within ten years."""
    later = datetime.timedelta(seconds=(page_id or 0) % CAPTURE_SPAN_S)
    return (FIRST_CAPTURE + later).strftime("%Y-%m-%dT%H:%M:%SZ")


def url_key(url: str) -> str:
    """The host's parts from the right, then path and query, lower-cased; without scheme, ``www.`` and fragment."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    port = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    query = "?" + "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{query}".lower()


def digest_name(payload_sha1: bytes) -> str:
    return base64.b32encode(payload_sha1).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, first: int | None) -> bytes:
    """One WARC record, as a revisit without the payload if ``first`` names another page."""
    clean = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else "about:invalid"
    revisit = first is not None and first != page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {clean}", f"WARC-Date: {capture_time(page_id)}",
        f"WARC-Payload-Digest: sha1:{digest_name(sha1)}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(first)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, min_payload: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record per row of (page_id, url, html); returns the files as (path, records, bytes)."""
    small_batches(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    keyed = rows.withColumn("sha1", F.sha1("payload"))
    repeated = small_side(
        keyed.filter(F.octet_length("payload") >= min_payload).groupBy("sha1")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(folder)
        done, out, path, n, size = [], None, "", 0, 0
        for batch in batches:
            for page_id, url, body, sha1, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(f"{root}/{path}", compression=None)
                packer = zlib.compressobj(wbits=31)
                member = packer.compress(record(page_id, url, body, bytes.fromhex(sha1), first)) + packer.flush()
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= file_bytes:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        columns = list(zip(*done)) or [()] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
            names=["path", "records", "bytes"])

    joined = keyed.join(repeated, "sha1", "left").select("page_id", "url", "payload", "sha1", "first")
    return materialise(joined.mapInArrow(write, MANIFEST), "archives")


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member of a stream, read a piece at a time."""
    piece, offset = b"", 0
    while True:
        packer, content, start = zlib.decompressobj(31), [], offset
        while not packer.eof:
            piece = piece or stream.read(1 << 20)
            if not piece:
                if content:
                    raise EOFError("an archive ends within a record")
                return
            content.append(packer.decompress(piece))
            offset += len(piece) - len(packer.unused_data)
            piece = packer.unused_data
        yield start, offset - start, b"".join(content)


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def parse(content: bytes) -> tuple:
    """url_key, captured_at, page_id, payload_bytes, payload_digest, record_type, refers_to of one record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    digest, kind = warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"]
    size = int(fields(http)["content-length"])
    if kind == "response" and (size != len(payload) or digest_name(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"record {warc['warc-record-id']} does not hold the payload it names")
    return (url_key(warc["warc-target-uri"]), warc["warc-date"], page_of(warc["warc-record-id"]), size, digest, kind,
            page_of(warc.get("warc-refers-to")))


def order(row: tuple) -> tuple:
    """URL key, time, id (rows without an id first), then where the record lies."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def arrow_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(INDEX)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, INDEX)], schema=INDEX)


def index_runs(files: DataFrame, folder: str, run_rows: int = RUN_ROWS) -> DataFrame:
    """Index rows of the archives named in ``files``, in sorted runs of at most ``run_rows`` rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(folder)
        rows: list[tuple] = []

        def run() -> pa.RecordBatch:
            name = uuid.uuid4().hex
            out = arrow_rows([(*r, name) for r in sorted(rows, key=order)])
            rows.clear()
            return out

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_stream(f"{root}/{path}", compression=None) as stream:
                    for offset, length, content in members(stream):
                        rows.append((*parse(content), path, offset, length))
                        if len(rows) >= run_rows:
                            yield run()
        if rows:
            yield run()

    n = max(1, files.count())
    return materialise(files.select("path").repartition(n).mapInArrow(read, INDEX_DDL), "runs")


def loser_tree(runs: list[list[tuple]]) -> Iterator[tuple]:
    """Merges sorted lists of (key, row): a tree of matches keeps the loser of each, so a next row costs one path."""
    k = len(runs)
    if k == 0:
        return
    at = [0] * k

    def ahead(a: int, b: int) -> bool:
        """Whether run a comes before run b; an ended run comes last."""
        if at[a] >= len(runs[a]):
            return False
        return at[b] >= len(runs[b]) or (runs[a][at[a]][0], a) < (runs[b][at[b]][0], b)

    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if ahead(a, b) else (b, a)
    best = winners[1] if k > 1 else 0
    while at[best] < len(runs[best]):
        yield runs[best][at[best]][1]
        at[best] += 1
        node = (best + k) // 2
        while node:
            if ahead(losers[node], best):
                best, losers[node] = losers[node], best
            node //= 2


def merge_runs(runs: DataFrame) -> DataFrame:
    """The runs' rows in global order: partitions are ranges, and rows within a partition are merged."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[list[tuple]] = []
        open_piece: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key, piece = order(row), open_piece.get(row[10])
                if piece is None or key < piece[-1][0]:
                    open_piece[row[10]] = piece = []
                    pieces.append(piece)
                piece.append((key, row))
        out: list[tuple] = []
        for row in loser_tree(pieces):
            out.append(row)
            if len(out) == 10_000:
                yield arrow_rows(out)
                out = []
        if out:
            yield arrow_rows(out)

    return runs.repartitionByRange("url_key", "captured_at", "page_id").mapInArrow(merge, INDEX_DDL)


def capture_history(pages: DataFrame, min_payload: int = 0, file_bytes: int = FILE_BYTES,
                    run_rows: int = RUN_ROWS) -> DataFrame:
    """Archives ``pages`` and returns the merged index of what the archives hold, in capture order."""
    folder = fresh_path(pages.sparkSession, "warc")
    files = write_archives(pages, folder, min_payload, file_bytes)
    return merge_runs(index_runs(files, folder, run_rows)).drop("run")


SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
    SELECT page_id, strlen(body) AS n, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
           (CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31
       ) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""


@query("op10_index_merge", SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_history(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
