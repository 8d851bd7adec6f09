"""WARC (operator 6): writes WARC records, one gzip member each, into ZIP-packaged archives with an index,
and reads them back by ranges: central and ZIP64 directories, stored members, then single records."""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import read_table, stored, text_or_empty, work_dir

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Records whose payloads are this long at least can revisit an equal one.
LEAST_REVISIT = 1000
RECORD_DATE = "2024-01-01T00:00:00Z"
CHUNK = 4 << 20


# ---- ZIP directories, by ranges ----


def _range(file: pafs.NativeFile, start: int, size: int) -> bytes:
    file.seek(start)
    got = file.read(size)
    if len(got) != size:
        raise ValueError("the archive ends too early")
    return got


def directory(file: pafs.NativeFile) -> dict[str, tuple[int, int, int, int]]:
    """name -> (local header offset, stored size, size, method) from the central directory, by the ZIP64
    records where the plain ones overflow."""
    size = file.size()
    tail = _range(file, max(0, size - 65557), min(size, 65557))
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<H2I", tail[end + 10 : end + 20])
    if 0xFFFF in (count,) or 0xFFFFFFFF in (length, start) or tail[max(0, end - 20) : end][:4] == b"PK\x06\x07":
        at = struct.unpack("<Q", tail[end - 12 : end - 4])[0]
        wide = _range(file, at, 56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack("<3Q", wide[32:56])
    raw, at, members = _range(file, start, length), 0, {}
    for _ in range(count):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("a central directory entry is broken")
        method, = struct.unpack_from("<H", raw, at + 10)
        packed, full = struct.unpack_from("<2I", raw, at + 20)
        n, extra, comment = struct.unpack_from("<3H", raw, at + 28)
        offset, = struct.unpack_from("<I", raw, at + 42)
        name, more = raw[at + 46 : at + 46 + n].decode(), raw[at + 46 + n : at + 46 + n + extra]
        while len(more) >= 4:
            kind, width = struct.unpack_from("<2H", more)
            if kind == 1:
                values = iter(struct.unpack(f"<{width // 8}Q", more[4 : 4 + width // 8 * 8]))
                full = next(values) if full == 0xFFFFFFFF else full
                packed = next(values) if packed == 0xFFFFFFFF else packed
                offset = next(values) if offset == 0xFFFFFFFF else offset
            more = more[4 + width :]
        members[name] = offset, packed, full, method
        at += 46 + n + extra + comment
    return members


def stored_at(file: pafs.NativeFile, member: tuple[int, int, int, int]) -> tuple[int, int]:
    """Where a stored (not compressed) member's bytes begin, and how many there are."""
    offset, packed, _, method = member
    if method != zipfile.ZIP_STORED:
        raise ValueError("the member is compressed; ranges of it can't be read")
    head = _range(file, offset, 30)
    n, extra = struct.unpack_from("<2H", head, 26)
    return offset + 30 + n + extra, packed


# ---- WARC records ----


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{digest}')}>"


def make_record(page: int | None, url: str, payload: bytes, digest: str, refers: int | None) -> bytes:
    revisit = refers is not None
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page, digest)), ("WARC-Date", RECORD_DATE),
        ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-Id", "" if page is None else str(page)), ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers, digest)), ("X-Refers-To-Page-Id", str(refers))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in [*fields, ("Content-Length", str(len(body)))]) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, lower-cased, and the payload after the HTTP head."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    body = rest[: int(fields["content-length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def _gzip(raw: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _write(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        index, pages, name = [], [], uuid.uuid4().hex
        path, tmp = f"{root}/{name}.wacz", f"{root}/tmp-{name}"
        zone, position = None, 0
        for batch in batches:
            for page, url, html, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                if zone is None:
                    sink = fs.open_output_stream(tmp)
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
                    zone = archive.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
                member = _gzip(make_record(page, url or "", html.encode(), digest, refers))
                zone.write(member)
                index.append(json.dumps({"page_id": page, "url": url, "offset": position, "length": len(member)}))
                position += len(member)
        if zone is None:
            return
        zone.close()
        archive.writestr(zipfile.ZipInfo(INDEX), "\n".join(index) + "\n")
        archive.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": DATA, "bytes": position}, {"path": INDEX}]}))
        archive.close()
        sink.close()
        fs.move(tmp, path)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(index)], pa.int64())], ["file", "records"])

    return run


def write_archives(pages: DataFrame, uri: str, salts: int = 64) -> DataFrame:
    """Write one archive a partition; returns the manifest (file, records).

    Of rows whose payloads are equal and ``LEAST_REVISIT`` bytes long at least, the one with the largest
    page_id is the response and the others revisit it; shorter ones are all responses. Null html is an
    empty payload; rows with a null page_id are responses; rows repeated with the largest page_id are
    all responses. Equal payloads are pre-aggregated under salts, so any share of the rows may be equal."""
    fs, root = pafs.FileSystem.from_uri(uri)
    fs.create_dir(root)
    html = text_or_empty(F.col("html"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("bytes"))
    keyed = rows.filter(F.col("bytes") >= LEAST_REVISIT).select("page_id", "digest").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    part = stored(keyed.groupBy("digest", "salt").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")), "payloads")
    whole = part.groupBy("digest").agg(F.max("top").alias("top"), F.sum("n").alias("n")).filter("n > 1")
    target = keyed.join(part.select("digest", "salt").join(whole.select("digest", "top"), "digest"), ["digest", "salt"])
    target = target.filter("page_id <> top").select(F.col("page_id").alias("id"), F.col("digest").alias("same"), F.col("top").alias("refers_to")).distinct()
    joined = rows.join(target, (F.col("page_id") == F.col("id")) & (F.col("digest") == F.col("same")), "left")
    made = joined.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(_write(uri), "file string, records long")
    return stored(made, "manifest")


def read_archives(spark: SparkSession, manifest: DataFrame, uri: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, and the payload (null in a
    revisit). Each digest of a payload that is there is checked. Index stretches, not archives, are
    dealt to tasks; nothing is extracted."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for path in batch.column("file").to_pylist():
                with fs.open_input_file(path) as file:
                    members = directory(file)
                    begin, _ = stored_at(file, members[DATA])
                    lines = _range(file, *stored_at(file, members[INDEX])).decode().splitlines()
                spans: list[list] = []
                for entry in map(json.loads, lines):
                    if not spans or spans[-1][1] + entry["length"] > CHUNK:
                        spans.append([begin + entry["offset"], 0, []])
                    spans[-1][1] += entry["length"]
                    spans[-1][2].append(entry["length"])
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(spans)), pa.array([s[0] for s in spans], pa.int64()), pa.array([s[2] for s in spans], pa.list_(pa.int32()))], ["file", "start", "sizes"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for path, start, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                with fs.open_input_file(path) as file:
                    raw, at, out = _range(file, start, sum(sizes)), 0, []
                for size in sizes:
                    fields, payload = parse_record(zlib.decompress(raw[at : at + size], 31))
                    at += size
                    digest, revisit = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"] == "revisit"
                    if not revisit and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(fields["x-payload-length"])):
                        raise ValueError("a payload's digest is wrong")
                    number = lambda k: int(fields[k]) if fields.get(k) else None
                    out.append((number("x-page-id"), fields["warc-target-uri"], number("x-payload-length"), digest, fields["warc-type"], number("x-refers-to-page-id"), None if revisit else payload.decode()))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spans = manifest.select("file").repartition(max(1, min(manifest.count(), tasks)), "file").mapInArrow(plan, "file string, start long, sizes array<int>")
    return spans.repartition(tasks, "file", "start").mapInArrow(fetch, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")


def op6_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = work_dir(spark, "archives")
    manifest = write_archives(read_table(spark, sf_dir, "pages"), uri)
    return read_archives(spark, manifest, uri).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, cast(n AS bigint) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= {LEAST_REVISIT} AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {LEAST_REVISIT} AND page_id < top THEN top END AS refers_to
FROM q
"""
