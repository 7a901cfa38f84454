"""WARC archives: write captures, read records, assemble transactions.

A capture is a request, a response (or a revisit of another capture's response)
and a metadata record; request and metadata name the response in
``WARC-Concurrent-To``. Writing gives each task its own gzip archive (one member
per record) in the shared folder; only files that the stored manifest names
count, so a retried task leaves an orphan and no wrong record.

Reading parses each archive record by record. :func:`assemble` joins the records
through their concurrent-to identifiers, whichever side names the other and
also by way of a request, into one nested row per response or revisit.

Defined results: null html is an empty payload; payloads of ``least`` bytes or
more that are equal have one response, the page with the largest page_id, and
the others revisit it; a null page_id is never revisited and never revisits;
rows repeating page_id and payload are captures of their own with equal fields.
Other columns are ignored; an empty table gives no archive and no row.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import open_output, shared_folder, ship_package, stored

DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = ("file string, record_id string, type string, target_uri string, concurrent_to array<string>, refers_to string, "
          "http_length long, payload_digest string, fields map<string,string>, payload binary")


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, parts)))}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, ident: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {ident}", f"WARC-Date: {DATE}",
             *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _one_line(url: str | None) -> str:
    return "".join(c for c in url or "" if c not in "\r\n")


def capture(page_id: int | None, keep_id: int | None, url: str | None, payload: bytes, place: str) -> list[bytes]:
    """The three records of a page; ``keep_id`` is the page whose response holds the payload."""
    url = _one_line(url)
    parts = urlsplit(url if "[" not in url and "]" not in url else "")
    revisit = keep_id is not None and page_id != keep_id
    ident = record_id("response", page_id) if keep_id is not None and not revisit else record_id("capture", place)
    target = [("WARC-Target-URI", url)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    same = [*target, ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if revisit:
        main = _record("revisit", ident, [*same, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id("response", keep_id))], http)
    else:
        main = _record("response", ident, same, http + payload)
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    asked = f"GET {path} HTTP/1.1\r\nHost: {parts.netloc}\r\n\r\n".encode()
    about = f"page_id: {'' if page_id is None else page_id}\r\n".encode()
    joined = [*target, ("WARC-Concurrent-To", ident)]
    return [_record("request", record_id("request", place), [*joined, ("Content-Type", "application/http; msgtype=request")], asked), main,
            _record("metadata", record_id("metadata", place), [*joined, ("Content-Type", "application/warc-fields")], about)]


def write_archives(pages: DataFrame, least: int = 0, archives: int | None = None) -> tuple[str, DataFrame]:
    """Writes a capture per row of ``pages`` (page_id, url, html); the folder, and the stored manifest (file, records).

    Each task that finds the owners of payloads writes an archive; ``archives`` deals the rows out anew.
    """
    spark = pages.sparkSession
    ship_package(spark)
    folder = shared_folder(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    keep = stored(rows.where(F.col("page_id").isNotNull() & (F.length("payload") >= least)).groupBy("sha").agg(F.max("page_id").alias("keep_id")), "payload-owners")
    marked = rows.join(keep, "sha", "left").select(
        "page_id", F.when(F.length("payload") >= least, F.col("keep_id")).otherwise(F.col("page_id")).alias("keep_id"), "url", "payload")
    marked = marked.withColumn("keep_id", F.when(F.col("page_id").isNotNull(), F.col("keep_id")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = None, 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "keep_id", "url", "payload")), strict=True):
                if out is None:
                    file = f"{uuid.uuid4().hex}.warc.gz"
                    out = open_output(f"{folder}/{file}")
                out.write(b"".join(capture(*row, f"{file}/{n}")))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([3 * n], pa.int64())], names=["file", "records"])

    if archives:
        marked = marked.repartition(archives, F.xxhash64("page_id", "url", "payload"))
    return folder, stored(marked.mapInArrow(write, "file string, records long"), "warc-manifest")


def members(data: bytes, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of an archive, each unpacked; an archive that is not packed comes as one."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(data):
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof and at < len(data):
            out.append(unpack.decompress(view[at:at + chunk]))
            at += min(chunk, len(data) - at) - len(unpack.unused_data)
        yield b"".join(out)


def records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of each record."""
    for member in members(data):
        at = 0
        while (at := member.find(b"WARC/", at)) >= 0:
            end = member.index(b"\r\n\r\n", at)
            lines = member[at:end].decode("utf-8", "replace").split("\r\n")[1:]
            headers = [(k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in lines)]
            size = int(dict(headers)["content-length"])
            yield headers, member[end + 4:end + 4 + size]
            at = end + 4 + size


def _parsed(file: str, headers: list[tuple[str, str]], block: bytes) -> tuple:
    named = dict(headers)
    kind, fields, payload, length = named.get("warc-type"), [], block, None
    if named.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        fields = [(k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])]
        length = next((int(v) for k, v in fields if k == "content-length" and v.isdigit()), None)
    elif named.get("content-type") == "application/warc-fields":
        fields = [(k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n")) if k]
    if kind == "response":
        length, found = len(payload), digest(payload)
    else:
        found = named.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return (file, named.get("warc-record-id"), kind, named.get("warc-target-uri"), [v for k, v in headers if k == "warc-concurrent-to"],
            named.get("warc-refers-to"), length, found, fields, payload)


def read_records(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """One row per record (:data:`RECORD`) of the archives that ``manifest`` names."""
    ship_package(spark)
    names = [c.split()[0] for c in RECORD.replace("map<string,string>", "map").split(", ")]
    kinds = [pa.string()] * 4 + [pa.list_(pa.string()), pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for file, data in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows, size = [], 0
                for headers, block in records(data):
                    rows.append(_parsed(file, headers, block))
                    size += len(block)
                    if size > 4 << 20 or len(rows) >= 1000:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    paths = [f"{folder}/{r['file']}" for r in manifest.select("file").collect()]  # as many as files that Spark lists for any read
    if not paths:
        return spark.createDataFrame([], RECORD)
    found = spark.read.format("binaryFile").load(paths)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(run, RECORD)


def assemble(table: DataFrame) -> DataFrame:
    """One row per capture: ids, uri, type, payload, and its requests and metadata as arrays of structs."""
    main = table.where(F.col("type").isin("response", "revisit", "resource"))
    rest = table.where(F.col("type").isin("request", "metadata")).select("record_id", "type", "concurrent_to", "fields", F.col("payload").alias("block"))
    named = rest.select(F.col("record_id").alias("part"), F.explode("concurrent_to").alias("owner"))
    mains = main.select(F.col("record_id").alias("owner"))
    direct = named.join(mains, "owner", "left_semi")
    reverse = main.select(F.explode("concurrent_to").alias("part"), F.col("record_id").alias("owner"))
    linked = direct.unionByName(reverse).distinct()
    by_way = (named.join(mains, "owner", "left_anti").withColumnRenamed("owner", "way")
              .join(linked.withColumnRenamed("part", "way"), "way").select("part", "owner"))
    linked = linked.unionByName(by_way).distinct()
    parts = (linked.join(rest.withColumnRenamed("record_id", "part"), "part")
             .groupBy("owner").agg(F.array_sort(F.collect_list(F.struct(F.col("part").alias("record_id"), "type", F.map_entries("fields").alias("fields"), "block"))).alias("parts")))
    return (main.join(parts.withColumnRenamed("owner", "record_id"), "record_id", "left")
            .withColumn("parts", F.coalesce("parts", F.array()))
            .select("record_id", "target_uri", "type", "refers_to", F.col("http_length").alias("payload_bytes"), "payload_digest", "payload",
                    F.filter("parts", lambda p: p["type"] == "request").alias("requests"),
                    F.filter("parts", lambda p: p["type"] == "metadata").alias("metadata")))


def page_captures(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (page_id) of assembled captures that :func:`write_archives` wrote."""
    rows = captures.withColumn("about", F.map_from_entries(F.get(F.col("metadata"), F.lit(0))["fields"])).select(
        "record_id", "refers_to", "type", "payload_bytes", "payload_digest", F.expr("try_cast(about['page_id'] as bigint)").alias("page_id"))
    owners = rows.where("type = 'response' and page_id is not null").groupBy(F.col("record_id").alias("refers_to")).agg(F.max("page_id").alias("owner"))
    return (rows.join(owners, "refers_to", "left")
            .select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.when(F.col("type") == "revisit", F.col("owner")).alias("refers_to")))
