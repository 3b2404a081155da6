"""A deterministic sharded WARC writer, and the reader of what it wrote.

Write: records get a shard by ranges of (page id, hash of the payload).  The bounds are quantiles by
payload bytes of a sample that hashes draw, so they depend on the data alone, and ids that lie far
apart, in a few dense ranges, or are missing make no shard larger than others.  Each shard is one
task: its records are sorted by id and written as gzip members, one a record, into files that roll
over when their compressed size reaches a limit.  Headers and digests are made anew from the payload;
a revisit names its response by record id, target and key.  A task writes each file under a name of
its own attempt and renames it when the file is complete; what a file holds does not depend on the
attempt, so a repeated task leaves the bytes that are there.  The tasks return one manifest row a
file; the manifest is written by Spark (atomically) and last, and what attempts left goes then.
A file that no manifest row names is not part of the archive.

Read: a task reads some files (about ``READ_BYTES``) record by record, checks each payload against
its digest and each file against its manifest row, and returns one row a record.

Of records with equal payloads of at least ``min_revisit_bytes`` bytes that with the smallest
id is the response and the others revisit it; smaller payloads are all responses.

Null payloads are empty payloads.  Rows without an id are responses, sort first and refer to
nothing.  Repeated rows with the smallest id of their payload are all responses (revisits
refer to that id); repeated rows of another id are revisits each.  Rows that are equal in id and
payload stay in one shard, however many.  A very long payload is one record.  An empty table writes an
empty manifest.  A null target is written as an empty one.  Columns other than the three named
are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordinal import Key, bucket_of
from .sqltext import quoted

SHARD_BYTES = 64 << 20
FILE_BYTES = 8 << 20
RECORD_BYTES = 300  # headers, counted with each payload
READ_BYTES = 64 << 20
MAX_SHARDS = 100_000  # larger archives have larger shards
KEYS_PER_SHARD = 64  # sampled records behind each bound
MAX_KEYS = 400_000  # sampled records that reach the driver
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "file string, shard long, seq int, records long, bytes long, sha256 string"
RECORDS = "file string, record_id string, record_type string, target string, key long, refers_to long, payload_digest string, payload_bytes long, payload binary"
CRLF = b"\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"


def render(key: int | None, target: str, payload: bytes, refers_to: tuple[int, str] | None) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header and the digest but not the payload."""
    revisit, digest = refers_to is not None, base32_sha1(payload)
    block = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""]) + (b"" if revisit else payload)
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(key, digest, target)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(target, safe=":/?#[]@!$&'()*+,;=%~-._")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if key is not None:
        head.append(("X-Record-Key", str(key)))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Key", str(refers_to[0])),
                 ("WARC-Refers-To", record_id(refers_to[0], digest, refers_to[1])), ("WARC-Refers-To-Target-URI", quote(refers_to[1], safe=":/?#[]@!$&'()*+,;=%~-._"))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1" + CRLF + b"".join(f"{k}: {v}".encode() + CRLF for k, v in head) + CRLF + block + CRLF + CRLF


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if uri.startswith("file:") or "://" not in uri:
        return pyarrow.fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri)


class RollingWriter:
    """Writes one shard at a time; ``put`` returns the manifest rows of files it has completed."""

    def __init__(self, uri: str, limit: int):
        self.fs, self.root = filesystem(uri)
        self.limit, self.attempt = limit, uuid.uuid4().hex
        self.shard, self.seq, self.sink = None, 0, None

    def put(self, shard: int, record: bytes) -> list[tuple]:
        done = []
        if shard != self.shard:
            done += self.close()
            self.shard, self.seq = shard, 0
        if self.sink is None:
            self.name = f"shard-{shard:08d}-{self.seq:05d}.warc.gz"
            self.temporary = f"{self.root}/_temporary/{self.attempt}-{self.name}"
            self.sink = self.fs.open_output_stream(self.temporary, compression=None)
            self.sha, self.size, self.records = hashlib.sha256(), 0, 0
        member = gzip.compress(record, compresslevel=6, mtime=0)
        self.sink.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1
        if self.size >= self.limit:
            done += self.close()
        return done

    def close(self) -> list[tuple]:
        if self.sink is None:
            return []
        self.sink.close()
        self.sink = None
        there = self.fs.get_file_info(f"{self.root}/{self.name}")
        if there.type == pyarrow.fs.FileType.NotFound:
            self.fs.move(self.temporary, f"{self.root}/{self.name}")
        else:  # an earlier attempt was complete
            if there.size != self.size:
                raise ValueError(f"{self.name} was written with other content; archives need a folder of their own")
            self.fs.delete_file(self.temporary)
        self.seq += 1
        return [(self.name, self.shard, self.seq - 1, self.records, self.size, self.sha.hexdigest())]


def shard_bounds(sizes: DataFrame, shard_bytes: int) -> list[tuple]:
    """First (key, place) of all shards but the first, from (key, place, n): quantiles by bytes of a
    sample of at most about ``MAX_KEYS`` rows, drawn by the hash of key and place."""
    total = sizes.agg(F.count("*").alias("rows"), (F.sum("n") + RECORD_BYTES * F.count("*")).alias("bytes")).first()
    shards = min(MAX_SHARDS, -(-(total["bytes"] or 0) // shard_bytes))
    if shards <= 1:
        return []
    share = max(1, total["rows"] // min(KEYS_PER_SHARD * shards, MAX_KEYS))
    drawn = sizes.where(F.pmod(F.xxhash64("key", "place"), F.lit(share)) == 0)
    rows = drawn.groupBy("key", "place").agg(F.sum(F.col("n") + RECORD_BYTES).alias("n")).collect()
    rows = sorted(((r["key"], r["place"], r["n"]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    upto, size, bounds, filled = 0, sum(r[2] for r in rows), [], 0
    for key, place, n in rows:
        if upto * shards // size > filled:  # a record that fills several shards opens one
            filled = upto * shards // size
            bounds.append((key, place))
        upto += n
    return bounds


def revisits(rows: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """(key, place, exact, first, first_target): the rows that revisit another, as narrow rows.

    A payload in a third of all rows is one group whose smallest id is a partial aggregate, and
    the large side of the join can be split."""
    able = rows.where((F.col("n") >= min_revisit_bytes) & F.col("key").isNotNull()).select("key", "place", "exact", "target")
    firsts = able.groupBy("exact").agg(F.min(F.struct("key", "target")).alias("f"), F.count("*").alias("copies")).where("copies > 1")
    firsts = firsts.select("exact", F.col("f.key").alias("first"), F.col("f.target").alias("first_target"))
    return able.join(firsts, "exact").where("key > first").select("key", "place", "exact", "first", "first_target").distinct()


def write_archive(
    pages: DataFrame, out: str, key: str = "page_id", target: str = "url", payload: str = "html",
    min_revisit_bytes: int = 0, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write ``pages`` under the folder URI ``out`` (shared by all executors); returns the manifest."""
    spark = pages.sparkSession
    text = F.encode(F.coalesce(F.col(quoted(payload)), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(quoted(key)).cast("long").alias("key"), F.unhex(F.sha2(text, 256)).alias("exact"), F.lit(None).cast("long").alias("refers"),
        F.coalesce(F.col(quoted(target)).cast("string"), F.lit("")).alias("target"), F.col(quoted(payload)).alias("payload"),
    ).withColumn("place", F.xxhash64("exact"))
    # what refers to what travels as rows of its own that sort before the payloads they are about,
    # so that payloads are exchanged once
    sizes = rows.select("key", "place", "exact", "target", F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long").alias("n"))
    about = revisits(sizes, min_revisit_bytes).select(
        "key", "exact", F.col("first").alias("refers"), F.col("first_target").alias("target"), F.lit(None).cast("string").alias("payload"), "place",
    )
    bounds = shard_bounds(sizes, shard_bytes)
    every = rows.unionByName(about)
    placed = every.withColumn("shard", bucket_of(every, [Key(F.col("key")), Key(F.col("place"))], bounds).cast("int"))
    fs, root = filesystem(out)
    fs.create_dir(f"{root}/_temporary", recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done, subject, refers = RollingWriter(out, file_bytes), [], None, None
        for batch in batches:
            for r in range(batch.num_rows):
                k, exact, first, url, html, shard = (batch.column(c)[r].as_py() for c in range(6))
                if first is not None:
                    subject, refers = (k, exact), (first, url)
                    continue
                body = b"" if html is None else html.encode()
                done += writer.put(shard, render(k, url, body, refers if subject == (k, exact) else None))
        done += writer.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["file", "shard", "seq", "records", "bytes", "sha256"])

    dealt = placed.repartitionById(len(bounds) + 1, "shard")  # shard i is task i
    ordered = dealt.sortWithinPartitions("shard", F.col("key").asc_nulls_first(), "place", "exact", F.col("refers").desc_nulls_last(), "target")
    ordered.select("key", "exact", "refers", "target", "payload", "shard").mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{out}/manifest")
    fs.delete_dir(f"{root}/_temporary")
    return read_manifest(spark, out)


def read_manifest(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{out}/manifest")


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed WARC stream."""
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) != CRLF:
            name, _, value = line.rstrip(CRLF).decode().partition(": ")
            headers[name] = value
        block = stream.read(int(headers["Content-Length"]))
        if stream.read(4) != CRLF + CRLF:
            raise ValueError("a record does not end where its length says")
        yield headers, block


def read_archive(spark: SparkSession, out: str, keep_payload: bool = True) -> DataFrame:
    """One row a record of all files that the manifest names; ``payload`` is null for revisits
    (and for all if ``keep_payload`` is off).  Raises where a digest or a count does not agree."""
    manifest = read_manifest(spark, out)
    n = max(1, -(-(manifest.agg(F.sum("bytes")).first()[0] or 0) // READ_BYTES))
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(out)
        for batch in batches:
            for file, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held, seen = [], 0, 0
                with fs.open_input_stream(f"{root}/{file}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as plain:
                    for h, block in parse(io.BufferedReader(plain)):
                        if f"sha1:{base32_sha1(block)}" != h["WARC-Block-Digest"]:
                            raise ValueError(f"{file}: block digest of {h['WARC-Record-ID']}")
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        body = block.partition(CRLF + CRLF)[2] if h["WARC-Type"] == "response" else None
                        if body is not None and base32_sha1(body) != digest:
                            raise ValueError(f"{file}: payload digest of {h['WARC-Record-ID']}")
                        number = lambda name, h=h: int(h[name]) if name in h else None
                        rows.append((file, h["WARC-Record-ID"], h["WARC-Type"], unquote(h["WARC-Target-URI"]), number("X-Record-Key"), number("X-Refers-To-Key"), digest, number("X-Payload-Length"), body if keep_payload else None))
                        seen += 1
                        held += len(block)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
                if seen != records:
                    raise ValueError(f"{file}: {seen} records, the manifest says {records}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return manifest.select("file", "records").repartition(n).mapInArrow(read, RECORDS)
