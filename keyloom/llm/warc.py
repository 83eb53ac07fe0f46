"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page_id, with splitters that follow from the rows alone and not
from a sample; each task streams its range into gzip files that roll at a compressed size.
Headers, record ids and digests are made anew from the payload, so the same rows and number
of ranges give the same bytes. Files are written under temporary names and renamed; only
those that the manifest names count, and what lost tasks left is deleted at the end. Of records with equal payloads the one
with the largest page_id is the response, found by an aggregate over narrow digest rows;
marker rows that sort just before their page tell the writer which records are revisits, so
the payloads cross the network once.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.ranges import dealt_by_range
from keyloom.llm.storage import discard, materialize, open_output, partitions, sweep

#: Compressed bytes of a file, and bytes that a record counts besides its payload.
ROLL, HEAD = 64 << 20, 600
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "part long, file string, n_records long, compressed_bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url, payload: bytes, sha: str, refers_to, again: int) -> bytes:
    """One uncompressed record; refers_to is (page_id,) of the response for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    name = lambda p, k: f"<urn:keyloom:page:{'null' if p is None else p}:{k}:{sha}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {name(page_id, again)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {urllib.parse.quote(url or 'about:blank', safe=':/?#[]@!$&()*+,;=%~')}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{sha}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if refers_to:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to[0], 0)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def packed(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_warc(df: DataFrame, path: str, least: int = 0, roll: int = ROLL) -> DataFrame:
    """Write df (page_id, url, html) below path; returns the manifest of files.

    Records with equal payloads of at least `least` bytes: the one with the largest page_id
    is the response and the others revisit it; smaller ones are all responses. A null html
    is empty, a null url about:blank, a null page_id smaller than any other. Of repeated rows
    of the largest page_id the first is the response. Other columns are ignored; an empty
    table gives no files.
    """
    spark = df.sparkSession
    body = F.coalesce("html", F.lit("")).cast("binary")
    tie = F.conv(F.hex(F.substring("sha", 1, 4)), 16, 10).cast("long")
    pages = df.select(F.col("page_id").cast("long"), "url", body.alias("body")).withColumn("sha", F.unhex(F.sha2("body", 256)))
    narrow = materialize(pages.select("page_id", "sha", tie.alias("tie"), F.octet_length("body").cast("long").alias("size")), "digests")
    large = narrow.filter(F.col("size") >= least)
    groups = large.groupBy("sha").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    marks = large.join(groups, "sha").select("page_id", F.lit(0).alias("kind"), "sha", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("body"), "keep").distinct()
    rows = marks.unionByName(pages.select("page_id", F.lit(1).alias("kind"), "sha", "url", "body", F.lit(None).cast("long").alias("keep")))
    parts = partitions(spark)
    weight = narrow.select("page_id", "tie", (F.col("size") + HEAD).alias("weight"))
    to = dealt_by_range(rows.withColumn("tie", tie), weight, parts, "page_id", "tie", "weight")
    ordered = to.drop("tie").repartitionById(parts, "to").sortWithinPartitions("page_id", "sha", "kind", "url")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        system, base = open_output(path)
        root = path.rstrip("/")
        sink = temp = None
        done, n, size, mark, again = [], 0, 0, None, 0

        def close():
            nonlocal sink, n, size
            sink.close()
            name = f"part-{part:06d}-{len(done):04d}.warc.gz"
            system.move(temp, f"{base}/{name}")
            done.append({"part": part, "file": f"{root}/{name}", "n_records": n, "compressed_bytes": size})
            sink, n, size = None, 0, 0

        for p, kind, sha, url, payload, keep in (r for b in batches for k in range(0, b.num_rows, 64) for r in zip(*(b.column(c).slice(k, 64).to_pylist() for c in ("page_id", "kind", "sha", "url", "body", "keep")), strict=True)):
            key = (p, sha)
            if kind == 0:
                mark, again = (key, keep), 0
                continue
            revisit = mark and mark[0] == key and (mark[1] != key[0] or again > 0)
            k, again = (again, again + 1) if mark and mark[0] == key else (0, 0)
            if sink is None:
                system.create_dir(base, recursive=True)
                temp = f"{base}/.part-{uuid.uuid4().hex}"
                sink = system.open_output_stream(temp, compression=None)
                info = b"software: keyloom\r\nformat: WARC File Format 1.1\r\n"
                size += sink.write(packed(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:keyloom:file:%d:%d>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (part, len(done), DATE.encode(), len(info), info))) or 0
            data = packed(record(p, url, payload, digest(payload), (mark[1],) if revisit else None, k))
            sink.write(data)
            n, size = n + 1, size + len(data)
            if size >= roll:
                close()
        if sink is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done)

    files = sorted(ordered.mapInArrow(write, FILES).collect())  # one row a file
    sweep(spark, path)
    discard(narrow)
    spark.createDataFrame(files, FILES).coalesce(1).write.json(f"{path.rstrip('/')}/manifest")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILES).json(f"{path.rstrip('/')}/manifest")


def members(stream):
    """The uncompressed gzip members of a stream, one after the other."""
    z, parts, data = zlib.decompressobj(31), [], b""
    while data or (data := stream.read(1 << 20)):
        parts.append(z.decompress(data))
        data = b""
        if z.eof:
            data = z.unused_data
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the last member is cut short")


_page = re.compile(r"<urn:keyloom:page:(null|-?\d+):(\d+):[A-Z2-7]*>")


def parse(data: bytes):
    """page_id, payload size, digest, type and refers_to of a record; None for warcinfo."""
    head, block = data.split(b"\r\n\r\n", 1)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    if fields["WARC-Type"] == "warcinfo":
        return None
    block = block[: int(fields["Content-Length"])]
    if f"sha1:{digest(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} differs")
    http, payload = block.split(b"\r\n\r\n", 1)
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload), digest(payload)) != (size, sha):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs")
    number = lambda x: None if x == "null" else int(x)
    refers = _page.fullmatch(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
    return number(_page.fullmatch(fields["WARC-Record-ID"])[1]), size, sha, fields["WARC-Type"], number(refers[1]) if refers else None


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files of the manifest; digests are checked."""
    files = read_manifest(spark, path)
    n = max(1, files.count())

    def read(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for b in batches:
            for uri in b.column("file").to_pylist():
                system, name = open_output(uri)
                rows = []
                with system.open_input_stream(name, compression=None) as stream:
                    for data in members(stream):
                        if row := parse(data):
                            rows.append(row)
                        if len(rows) == 4096:
                            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.repartition(n).mapInArrow(read, RECORDS)
