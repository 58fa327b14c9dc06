"""WARC archives: a deterministic sharded writer and a reader.

Records are sorted by (page_id, digest) and dealt to parts by range. The bounds are keys whose hash divides by a
number that follows from the rows' count and bytes alone, so they depend on the data and on nothing else, neither
on sampling nor on the number of partitions: writing the same pages again gives the same bytes. A part is written as
archives of gzip members, a warcinfo record and then one member a record, and a new file starts once the compressed
size of the current one reaches the limit. Headers, record ids and digests are made anew. A file is written under a
temporary name and renamed when whole; the manifest, which Spark's committer publishes at the end, names the files
that count, and the reader takes no others.

Of records with equal payloads of ``least`` bytes or more, the one with the largest page_id is a response and
the rest are revisits of it. Winners are found by partial maxima over (digest, salt), and joined by both, so a
payload that a third of all pages have is no key of one task.

Edge cases: a null html is an empty payload; null page_ids sort first, never win over known ones and are
responses where there are no others; rows that repeat with the winning page_id are all responses, and their
record ids are told apart by a copy number; a page_id with many payloads is cut by digest; very long pages are a record
like any other, held one at a time; line ends in a URL are percent-encoded; columns other than page_id, url and html
are not used, so clashing names do no harm; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialise, session

ROLL_BYTES = 8 << 20
LEAST_REVISIT = 1000
#: Payload bytes of a part, and how many parts there are at most (then parts grow); keys that are looked at to find a bound.
PART_BYTES, MOST_PARTS, KEYS_PER_PART = 16 << 20, 8192, 16
#: Salts of a digest.
SALTS = 64
MANIFEST = "file string, records long, bytes long, first_page long, last_page long"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def with_record_types(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """A row per page (page_id, url, html, digest) and, with is_page false, one per page_id and digest that is a revisit, with refers_to.

    Only ids and digests are grouped and joined; write() sorts a revisit's row right before its pages, so
    that the payloads move once.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    page_id = F.col("page_id").cast("long").alias("page_id")
    rows = pages.select(page_id, F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("digest"), F.lit(None).cast("long").alias("refers_to"), F.lit(True).alias("is_page"))
    large = pages.filter(F.octet_length(html) >= least).select(page_id, F.sha1(html).alias("digest"))
    large = large.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    by_salt = large.groupBy("digest", "salt").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n"))
    winners = by_salt.groupBy("digest").agg(F.max("top").alias("winner"), F.sum("n").alias("n")).filter("n > 1").select("digest", "winner")
    named = by_salt.select("digest", "salt").join(winners, "digest")
    revisits = large.join(named, ["digest", "salt"]).filter(~F.col("page_id").eqNullSafe(F.col("winner"))).select("page_id", "digest", "winner").distinct()
    none = F.lit(None)
    return rows.union(revisits.select("page_id", none.cast("string").alias("url"), none.cast("binary").alias("html"), "digest", F.col("winner").alias("refers_to"), F.lit(False).alias("is_page")))


def _name(page_id: int | None, digest: str, copy: int = 0) -> str:
    """A record's id: the page_id comes last."""
    return f"<urn:page:{digest[:16]}.{copy}:{'' if page_id is None else page_id}>"


def bounds_of(keys: DataFrame) -> list[tuple[int, int]]:
    """Where parts begin, from keys (p, d, bytes): every KEYS_PER_PART-th of the distinct keys whose hash divides by a number."""
    sums = keys.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).first()
    parts = min(MOST_PARTS, -(-(sums["bytes"] or 0) // PART_BYTES))
    if parts < 2:
        return []
    every = max(1, sums["n"] // (parts * KEYS_PER_PART))
    some = keys.filter(F.pmod(F.xxhash64("p", "d"), F.lit(every)) == 0).select("p", "d").distinct().collect()
    return sorted((r["p"], r["d"]) for r in some)[KEYS_PER_PART - 1 :: KEYS_PER_PART]


def part_of(bounds: list[tuple[int, int]]) -> Column:
    """How many bounds lie at or below a row's key: first among the heads of runs of bounds, then within one run."""
    if not bounds:
        return F.lit(0)
    width = max(1, round(len(bounds) ** 0.5))
    runs = [[{"p": p, "d": d} for p, d in bounds[i : i + width]] for i in range(0, len(bounds), width)]
    heads = F.from_json(F.lit(json.dumps([r[0] for r in runs])), "array<struct<p: bigint, d: bigint>>")
    table = F.from_json(F.lit(json.dumps(runs)), "array<array<struct<p: bigint, d: bigint>>>")
    below = lambda list_: F.size(F.filter(list_, lambda b: b <= F.col("key")))
    run = below(heads)
    return F.when(run == 0, F.lit(0)).otherwise((run - 1) * width + below(F.get(table, run - 1))).cast("int")


def sort_key() -> tuple[Column, Column]:
    """p and d of a row: its page_id, null lowest, and the first bits of its digest."""
    return F.coalesce(F.col("page_id"), F.lit(-(1 << 63))).alias("p"), F.conv(F.substring("digest", 1, 15), 16, 10).cast("long").alias("d")


def record(page_id: int | None, url: str | None, html: bytes, digest: str, refers_to: int | None, date: str, copy: int = 0) -> bytes:
    """One WARC record, uncompressed."""
    target = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    kind = "response"
    extra = ""
    if refers_to is None:
        block += html
    else:
        kind = "revisit"
        extra = f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: {_name(refers_to, digest)}\r\n"
    whole = base64.b32encode(hashlib.sha1(block).digest()).decode()
    head = (
        f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {_name(page_id, digest, copy)}\r\nWARC-Date: {date}\r\nWARC-Target-URI: {target}\r\n"
        f"WARC-Payload-Digest: sha1:{sha1}\r\nWARC-Block-Digest: sha1:{whole}\r\n{extra}"
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return head.encode() + block + b"\r\n\r\n"


def file_info(name: str, date: str) -> bytes:
    """The warcinfo record of a file."""
    block = b"software: quillon\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:{name}>\r\nWARC-Filename: {name}\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (by lower-case name) and block of every page's record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode().partition(":")
            head[key.lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        if head["warc-type"] != "warcinfo":
            yield head, block


def _page(value: str) -> int | None:
    number = value.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def parsed(head: dict[str, str], block: bytes) -> tuple[int | None, str, int, str, str, int | None]:
    """A row of READ; a response's digests are checked against its block."""
    top, _, payload = block.partition(b"\r\n\r\n")
    http = dict(x.lower().split(": ", 1) for x in top.decode().split("\r\n")[1:])
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = head["warc-type"]
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"{head['warc-record-id']}: the payload doesn't match its digest")
    refers = _page(head["warc-refers-to"]) if kind == "revisit" else None
    return _page(head["warc-record-id"]), head["warc-target-uri"], int(http["content-length"]), digest, kind, refers


def write(typed: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the rows of with_record_types() as archives under ``folder`` (a URI of a shared file system)."""
    session(typed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        now: int | None = None
        seq = count = size = copy = 0
        sink = temporary = name = None
        done: list[dict] = []
        first = last = None
        revisit: tuple = ()
        before: tuple = ()

        def close() -> None:
            nonlocal sink, seq, count, size
            sink.close()
            system.move(temporary, f"{root}/{name}")
            done.append({"file": name, "records": count, "bytes": size, "first_page": first, "last_page": last})
            sink, seq, count, size = None, seq + 1, 0, 0

        for batch in batches:
            for part, page_id, url, html, digest, refers_to, is_page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    if sink is not None:
                        close()
                    now, seq = part, 0
                if not is_page:
                    revisit = (page_id, digest, refers_to)
                    continue
                copy = copy + 1 if before == (page_id, digest) else 0
                before = (page_id, digest)
                refers_to = revisit[2] if revisit[:2] == before else None
                if sink is None:
                    name, temporary = f"part-{part:06d}-{seq:06d}.warc.gz", f"{root}/.{part:06d}-{seq:06d}.{uuid.uuid4().hex}.tmp"
                    sink, first = system.open_output_stream(temporary, compression=None), page_id
                    size = sink.write(gzip.compress(file_info(name, date), 6, mtime=0))
                member = gzip.compress(record(page_id, url, html, digest, refers_to, date, copy), 6, mtime=0)
                sink.write(member)
                count, size, last = count + 1, size + len(member), page_id
                if size >= roll_bytes:
                    close()
        if sink is not None:
            close()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("first_page", pa.int64()), ("last_page", pa.int64())]))

    p, d = sort_key()
    keys = materialise(typed.filter("is_page").select(p, d, F.octet_length("html").cast("long").alias("bytes")), "archive-keys")
    bounds = bounds_of(keys)
    columns = ["page_id", "url", "html", "digest", "refers_to", "is_page"]
    placed = typed.select(*columns, F.struct(p, d).alias("key")).select(part_of(bounds).alias("part"), *columns)
    ordered = placed.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "page_id", "digest", "is_page", "url")
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row of READ for each record of the archives that the manifest names."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], READ)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(manifest.select("file"), "file", "left_semi").select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        kinds = [pa.int64() if "long" in x else pa.string() for x in READ.split(", ")]
        for batch in batches:
            for content in batch.column(0):
                rows = [parsed(*x) for x in records(io.BufferedReader(gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer()))))]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.mapInArrow(run, READ)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write every page and read the archives back."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    write(with_record_types(pages), folder)
    return read(spark, folder).drop("url")
