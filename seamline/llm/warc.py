"""WARC archives: written as one gzip stream, normalised to a member a record with an offset index, and read back by it.

Cases: a null html is an empty payload; a null url is an empty target; a null page_id is written as such and
is never the record that others revisit, unless no copy has an id: then all copies are responses. Rows that
repeat an id and its payload are all responses. Control characters in urls are percent-encoded in the header.
Payloads of any length are written whole and read in bounded blocks. An empty table gives no archive and an
empty table. Only id_col, url_col and html_col are read; other columns don't reach the archive.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .batches import bounded

#: Copies' digests are broadcast up to this many rows of some 80 bytes; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: A hot digest is dealt out over so many tasks where it is joined by a shuffle.
SALTS = 16
ROLL_BYTES = 256 << 20
CHUNK = 1 << 20
MANIFEST = "archive string, index string, records long, bytes long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record_id(page_id: int | None, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}')}>"


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record_bytes(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One uncompressed record; a revisit keeps the HTTP header, whose Content-Length is the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    url = _clean(url)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, url)}", f"WARC-Target-URI: {url}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def inflated(stream) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, in blocks; an error where the file ends within a member or its trailer."""
    inflater, data, within = zlib.decompressobj(31), b"", False
    while True:
        data = data or stream.read(CHUNK)
        if not data:
            if within:
                raise ValueError("the archive ends within a gzip member")
            return
        within = True
        out = inflater.decompress(data, CHUNK)
        yield out
        while len(out) == CHUNK and not inflater.eof and not inflater.unconsumed_tail:
            yield (out := inflater.decompress(b"", CHUNK))
        if inflater.eof:
            data, inflater, within = inflater.unused_data.lstrip(b"\0"), zlib.decompressobj(31), False
        else:
            data = inflater.unconsumed_tail


def split_records(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an uncompressed WARC stream; holds one record at a time."""
    buffer = bytearray()

    def fill() -> bool:
        for block in blocks:
            if block:
                buffer.extend(block)
                return True
        return False

    while True:
        end = buffer.find(b"\r\n\r\n")
        while end < 0:
            seen = max(0, len(buffer) - 3)
            if not fill():
                if buffer.strip():
                    raise ValueError("the archive ends within a record's header")
                return
            end = buffer.find(b"\r\n\r\n", seen)
        whole = end + 4 + int(_fields(bytes(buffer[:end]))["content-length"]) + 4
        parts = [bytes(buffer)] if len(buffer) < whole else []
        held = len(buffer)
        while held < whole:
            block = next(blocks, None)
            if block is None:
                raise ValueError("the archive ends within a record")
            parts.append(block)
            held += len(block)
        if parts:
            buffer = bytearray(b"".join(parts))
        yield bytes(buffer[:whole])
        del buffer[:whole]


def normalise(files: store.Files, archive: str, name: str) -> tuple[str, str, int, int]:
    """Inflates the archive once and rewrites each record as a gzip member of its own; the index has a JSON row for each.

    Both files are written apart and moved to their names when whole: a repeated or lost attempt leaves no part of one.
    """
    at = records = 0
    out, index = f"{name}.warc.gz", f"{name}.idx"
    attempt = [f"attempts/{uuid.uuid4().hex}" for _ in (out, index)]
    with files.read(archive) as source, files.write(attempt[0]) as sink, files.write(attempt[1]) as rows:
        for record in split_records(inflated(source)):
            member = gzip.compress(record, 6, mtime=0)
            sink.write(member)
            fields = _fields(record[: record.index(b"\r\n\r\n")])
            rows.write(json.dumps({"offset": at, "length": len(member), "type": fields["warc-type"], "id": fields["warc-record-id"], "uri": fields["warc-target-uri"], "digest": fields.get("warc-payload-digest")}).encode() + b"\n")
            at += len(member)
            records += 1
    files.move(attempt[0], out)
    files.move(attempt[1], index)
    return out, index, records, at


def parse(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    revisit = fields["warc-type"] == "revisit"
    number = lambda name: int(fields[name]) if name in fields else None
    if revisit:
        size, digest, payload = int(_fields(http)["content-length"]), fields["warc-payload-digest"].removeprefix("sha256:"), None
    else:
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if fields.get("warc-payload-digest", f"sha256:{digest}") != f"sha256:{digest}":
            raise ValueError(f"{fields['warc-record-id']}: the payload has another digest")
    return {"page_id": number("x-page-id"), "url": fields["warc-target-uri"], "payload_bytes": size, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": number("x-refers-to-page-id"), "payload": payload}


def read_indexed(files: store.Files, archive: str, index: str) -> Iterator[dict]:
    """Records by their offsets, each member by itself."""
    with files.read(index) as rows, files.read(archive) as source:
        text = rows.read()
        for row in map(json.loads, text.splitlines()):
            source.seek(row["offset"])
            yield parse(gzip.decompress(source.read(row["length"])))


def with_revisits(pages: DataFrame, *, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """_id, _url, _payload, _digest and _refers (null: a response) of each page."""
    payload = F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("_url"), payload.alias("_payload")).withColumn("_digest", F.sha2("_payload", 256))
    large = F.octet_length("_payload") >= min_bytes
    copies = rows.where(large).groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and _first is not null")
    copies = store.written(copies.select(F.col("_digest").alias("_copy"), "_first"), "warc-copies")
    if copies.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(copies), large & (F.col("_digest") == F.col("_copy")), "left")
    else:
        salted = copies.select("_copy", "_first", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("_to"))
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
        joined = rows.join(salted, large & (F.col("_digest") == F.col("_copy")) & (F.col("_salt") == F.col("_to")), "left")
    return joined.withColumn("_refers", F.when(~F.col("_id").eqNullSafe(F.col("_first")), F.col("_first")))


def write_archives(pages: DataFrame, root: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 100, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes each partition's rows as gzip streams below root, a new file every roll_bytes of records; returns the manifest.

    A task's files have names of its own; the manifest, which Spark commits, tells which attempts count.
    """
    files = store.Files(root)
    rows = bounded(with_revisits(pages, id_col=id_col, url_col=url_col, html_col=html_col, min_bytes=min_bytes)).select("_id", "_url", "_payload", "_digest", "_refers")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files.make("raw")
        made, sink, raw, held = [], None, None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if sink is None or held >= roll_bytes:
                    if sink:
                        sink.close()
                        raw.close()
                    made.append([f"raw/{uuid.uuid4().hex}.warc.gz", 0, 0])
                    raw, held = files.write(made[-1][0]), 0
                    sink = gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=1, mtime=0)
                record = record_bytes(row["_id"], row["_url"], row["_payload"], row["_digest"], row["_refers"], row["_refers"] is not None)
                sink.write(record)
                held += len(record)
                made[-1][1] += 1
                made[-1][2] = held
        if sink:
            sink.close()
            raw.close()
        if made:
            yield pa.RecordBatch.from_pydict({"archive": [m[0] for m in made], "index": pa.array([None] * len(made), pa.string()), "records": [m[1] for m in made], "bytes": [m[2] for m in made]})

    return store.written(rows.mapInArrow(write, MANIFEST), "warc-manifest")


def normalise_archives(manifest: DataFrame, root: str, *, keep: bool = False) -> DataFrame:
    """The archives of a manifest, each rewritten; once all are committed, the old ones go, unless keep, with what lost attempts left."""
    files = store.Files(root)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files.make("attempts")
        for batch in batches:
            made = []
            for archive, records in zip(batch.column("archive").to_pylist(), batch.column("records").to_pylist()):
                made.append(normalise(files, archive, "part-" + archive.rpartition("/")[2].removesuffix(".warc.gz")))
                if records is not None and made[-1][2] != records:
                    raise ValueError(f"{archive}: {made[-1][2]} records, but {records} were written")
            yield pa.RecordBatch.from_pydict(dict(zip(("archive", "index", "records", "bytes"), map(list, zip(*made)))) if made else {"archive": [], "index": [], "records": [], "bytes": []})

    spread = manifest.repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4)
    done = store.written(spread.mapInArrow(rewrite, MANIFEST), "warc-normal")
    for folder in ["attempts"] if keep else ["attempts", "raw"]:
        store.remove(manifest.sparkSession, f"{root}/{folder}")
    return done


def read_archives(manifest: DataFrame, root: str, *, payloads: bool = True) -> DataFrame:
    files = store.Files(root)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for archive, index in zip(batch.column("archive").to_pylist(), batch.column("index").to_pylist()):
                for row in read_indexed(files, archive, index):
                    size += len(row["payload"] or b"") + 200
                    held.append(row if payloads else row | {"payload": None})
                    if size > 8 * CHUNK:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    spread = manifest.repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4)
    return spread.mapInArrow(read, RECORD)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    root = store.scratch(spark, "warc")
    manifest = normalise_archives(write_archives(pages, root), root)
    return read_archives(manifest, root, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
