"""Deterministic sharded WARC writer and reader.

Pages are range-sorted by id into shards whose bounds the table decides. A shard's task streams its records, each a gzip member of its own, rolls a
new file when the compressed size passes a limit, and regenerates every header and digest from the page itself, so a
rerun writes the same bytes. Files are written under temporary names that no other attempt uses; the rows that a
task returns about its files form the manifest, written as a table. Only files of the manifest are renamed to their
final names, so what a lost or repeated task left behind is never read. The reader takes the files of the manifest.

A payload of at least `revisit_from` bytes that several pages share is stored once, with the page of the largest id;
the others are revisit records that carry digest and length and refer to it.

Defined cases: NULL html is an empty payload; NULL url an empty target; a NULL id sorts first and counts as smaller
than any id (record id of the NULL page: empty); repeated rows of the staying id are all responses; an empty table
gives a manifest without files and an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.exchange import partitions
from tidemark.llm.text import text_batches
from tidemark.session import checkpoint_dir, materialize

REVISIT_FROM = 1000
FILE_BYTES = 32 << 20
KEY = ("page_id", "url", "payload_digest")
SAMPLE = 100
# Record headers.
VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, number int, temporary string, final string, records bigint, bytes bigint, sha1 string"
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has no payload."""
    head = [VERSION, f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    body = payload or b""
    head += ["Content-Type: text/html; charset=utf-8", f"WARC-Block-Digest: sha1:{hashlib.sha1(body).hexdigest()}", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member without time stamp or name: equal input gives equal bytes."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return headers, rest[:int(headers["Content-Length"])]


def members(stream, block: int = 1 << 20):
    """Decompressed gzip members of a file, one at a time."""
    unpack, parts = zlib.decompressobj(31), []
    data = stream.read(block)
    while data:
        parts.append(unpack.decompress(data))
        data = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []
        if not data:
            data = stream.read(block)


def classified(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = REVISIT_FROM) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to): refers_to is set for revisits, whose payload is dropped."""
    payload = F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("payload_digest", F.sha1("payload"))
    owner = rows.where(F.col("payload_bytes") >= revisit_from).groupBy("payload_bytes", "payload_digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = rows.join(materialize(owner), ["payload_bytes", "payload_digest"], "left")
    refers = F.when(F.expr("owner IS NOT NULL AND NOT page_id <=> owner"), F.col("owner"))
    return shared.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", refers.alias("refers_to"))


def with_shard(rows: DataFrame, shards: int) -> DataFrame:
    """The rows with their shard, a range of (page_id, url, payload_digest) whose bounds depend on the rows and the number of shards only.

    Bounds are weighted quantiles over the keys whose hash is divisible by a step that leaves about SAMPLE keys a shard.
    Which task writes a shard has no influence on its bytes.
    """
    step = max(1, rows.count() // (SAMPLE * shards))
    sample = rows.where(F.pmod(F.xxhash64(*KEY), F.lit(step)) == 0).groupBy(*KEY).count().collect()
    place = lambda page, url, digest: (page is not None, page or 0, url, digest)
    keys = sorted((place(*r[:3]), r[3]) for r in sample)
    total, upto, bounds = sum(n for _, n in keys), 0, []
    for key, n in keys:
        upto += n
        while len(bounds) < shards - 1 and upto * shards >= total * (len(bounds) + 1):
            bounds.append(key)

    def shard_of(stream: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pages, urls, digests in stream:
            yield pa.array([bisect.bisect_left(bounds, place(*k)) for k in zip(pages.to_pylist(), urls.to_pylist(), digests.to_pylist())], pa.int32())

    return text_batches(rows).withColumn("shard", F.arrow_udf(shard_of, "int")(*KEY))


def write_archive(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, shards: int | None = None, **columns: str) -> DataFrame:
    """Write the pages below `folder` (any URI that pyarrow's file systems open) and return the manifest, a table."""
    spark = pages.sparkSession
    rows = classified(pages, **columns)
    count = shards or partitions(pages)
    ordered = with_shard(rows, count).repartitionByRange(count, "shard").sortWithinPartitions("shard", *KEY)

    def write(stream):
        system, root = fs.FileSystem.from_uri(folder)
        attempt, at, number, out = uuid.uuid4().hex, None, 0, None
        done = []

        def close():
            out.close()
            done.append((at, number, posixpath.join(root, temporary), final, records, size, digest.hexdigest()))

        for batch in stream:
            for page, url, payload, n, sha1, refers_to, shard in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to", "shard"))):
                if out is not None and (size >= file_bytes or shard != at):
                    close()
                    number, out = number + 1, None
                if shard != at:
                    at, number = shard, 0
                if out is None:
                    final = f"pages-{shard:05d}-{number:05d}.warc.gz"
                    temporary = f"_temporary/{attempt}-{final}"
                    out, records, size, digest = system.open_output_stream(posixpath.join(root, temporary)), 0, 0, hashlib.sha1()
                data = member(record(page, url, payload, n, sha1, refers_to))
                out.write(data)
                digest.update(data)
                records, size = records + 1, size + len(data)
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                         names=["shard", "number", "temporary", "final", "records", "bytes", "sha1"])

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(posixpath.join(root, "_temporary"), recursive=True)
    manifest = f"{folder.rstrip('/')}/_manifest"
    text_batches(ordered).mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(manifest)
    listed = spark.read.schema(MANIFEST).parquet(manifest)

    def commit(stream):
        system, root = fs.FileSystem.from_uri(folder)
        for batch in stream:
            for temporary, final in zip(batch.column("temporary").to_pylist(), batch.column("final").to_pylist()):
                target = posixpath.join(root, final)
                if system.get_file_info(temporary).type != fs.FileType.NotFound:
                    system.move(temporary, target)
                elif system.get_file_info(target).type == fs.FileType.NotFound:
                    raise FileNotFoundError(target)
            yield batch

    listed.mapInArrow(commit, MANIFEST).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/_committed")
    return spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/_committed")


def read_archive(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the manifest's files; every digest is checked against the bytes read."""
    files = manifest.select("final", "records").repartition(partitions(manifest), "final")

    def read(stream):
        system, root = fs.FileSystem.from_uri(folder)
        for batch in stream:
            for name, expected in zip(batch.column("final").to_pylist(), batch.column("records").to_pylist()):
                found, rows = 0, []
                with system.open_input_stream(posixpath.join(root, name)) as source:
                    for data in members(source):
                        head, body = parse(data)
                        digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                        if hashlib.sha1(body).hexdigest() != (digest if kind == "response" else head["WARC-Block-Digest"].removeprefix("sha1:")):
                            raise ValueError(f"digest of {head['WARC-Record-ID']} in {name}")
                        page, other = (head.get(k, "").removeprefix("<urn:page:").removesuffix(">") for k in ("WARC-Record-ID", "WARC-Refers-To"))
                        rows.append((int(page) if page else None, head["WARC-Target-URI"], int(head["X-Payload-Length"]), digest, kind, int(other) if other else None, body if payloads else None))
                        found += 1
                        if len(rows) >= 500:
                            yield _records(rows)
                            rows = []
                if found != expected:
                    raise ValueError(f"{name} has {found} records, its manifest {expected}")
                yield _records(rows)

    return files.mapInArrow(read, RECORDS)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def archive_folder(pages: DataFrame) -> str:
    """A new folder below the shared checkpoint folder."""
    base = checkpoint_dir(pages.sparkSession).rstrip("/")
    base = base.removeprefix("file:") if base.startswith("file:/") and not base.startswith("file://") else base
    base = base if "://" in base else f"file://{base}"
    return f"{base}/warc-{uuid.uuid4().hex}"
