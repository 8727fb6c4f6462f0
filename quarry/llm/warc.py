"""WARC archives: a writer with revisit records, and a reader that salvages damaged archives.

Every record is a gzip member of its own. The reader takes members (or, in plain archives, records) one
after another and checks length and digests; after a failure it searches for the next member whose
content begins with a version line (or the next version line), goes on there, and logs the bytes between
as a gap. If a damaged plain record's own length leads to a sound record or the end, the gap ends there, so
that records quoted in its payload are not taken for records. Otherwise what the search finds counts if it
is whole, names its type and id, and proves itself: by a digest that holds, by the member's checksum, or, if
it has neither, by a record or the end right behind it. Archives are read through a window, so memory is
bounded by the largest record.

Writing: equal payloads of at least `least` bytes are stored once, in the record of the smallest page_id;
the others revisit it. Only digests are grouped; each payload is shuffled once, to the task that writes it.
A task writes to a name of its own try and renames, so a task that runs again leaves the same archives.

read_archives logs gaps as rows; read_pages, for archives that must be whole, raises on any.

Defined results: a null html is an empty payload; a null url is an empty URI; line breaks in URLs are
percent-encoded; rows that repeat page_id and payload are each a response if they hold the smallest id; a
null page_id counts as the largest and is never referred to. No rows give no archives and no records.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, checkpointed, fresh_dir, slices, spread_join, table

ARCHIVE_BYTES = 32 << 20
#: What executor and worker hand over at once, however long the pages are.
BATCH_BYTES = 4 << 20
WINDOW_BYTES = 1 << 20
#: What a gzip member and an uncompressed record begin with.
MEMBER, VERSION = b"\x1f\x8b\x08", b"WARC/1."
#: The largest head of a record of a plain archive; one that is larger is damage.
HEAD_BYTES = 1 << 26
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record: an HTTP response with its payload, or a revisit with the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    name = "" if page_id is None else page_id
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Window:
    """Random reads of a file through one cached piece."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.data)) and at < self.size:
            self.file.seek(at)
            self.at, self.data = at, self.file.read(max(n, WINDOW_BYTES))
        return self.data[at - self.at : at - self.at + n]


class Damaged(ValueError):
    pass


def _member(source: Window, at: int) -> tuple[bytes, int]:
    """Content and end of the gzip member at a place."""
    inflate, out, place, step = zlib.decompressobj(31), [], at, 1 << 13
    while not inflate.eof:
        piece = source.read(place, step)
        if not piece:
            raise Damaged("member is cut off")
        try:
            out.append(inflate.decompress(piece))
        except zlib.error as error:
            raise Damaged(str(error)) from None
        if not out[0].startswith(b"WARC/"[: len(out[0])]):
            raise Damaged("no version line")
        place, step = place + len(piece), min(2 * step, 1 << 20)
    return b"".join(out), place - len(inflate.unused_data)


def _head(data: bytes) -> tuple[dict, int]:
    stop = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/") or stop < 0:
        raise Damaged("no record head")
    fields = {}
    for line in data[:stop].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdigit():
        raise Damaged("no content length")
    return fields, stop + 4


def _checked(fields: dict, block: bytes) -> dict:
    if len(block) != int(fields["content-length"]):
        raise Damaged("wrong length")
    if (own := fields.get("warc-block-digest", "")).startswith("sha1:") and own[5:] != digest(block):
        raise Damaged("wrong block digest")
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    if fields.get("warc-type") != "revisit" and (own := fields.get("warc-payload-digest", "")).startswith("sha1:") and own[5:] != digest(payload):
        raise Damaged("wrong payload digest")
    return {"fields": fields, "payload": payload}


def _plain_head(source: Window, at: int) -> bytes:
    """What holds the head of an uncompressed record; a head may be of HEAD_BYTES at most."""
    n = 1 << 13
    while b"\r\n\r\n" not in (data := source.read(at, n)) and n < HEAD_BYTES and len(data) == n:
        n *= 2
    return data


def _record_at(source: Window, at: int, packed: bool) -> tuple[dict, int]:
    """The record at a place, and where it ends."""
    if packed:
        data, end = _member(source, at)
        fields, start = _head(data)
        if data[start + int(fields["content-length"]) :].strip(b"\r\n"):
            raise Damaged("more than a record in the member")
        return _checked(fields, data[start : start + int(fields["content-length"])]), end
    fields, start = _head(_plain_head(source, at))
    found = _checked(fields, source.read(at + start, int(fields["content-length"])))
    return found, _past_breaks(source, at + start + int(fields["content-length"]))


def _past_breaks(source: Window, at: int) -> int:
    while source.read(at, 2) == b"\r\n":
        at += 2
    return at


def salvage(file, size: int) -> Iterator[tuple[str, int, int, object]]:
    """('record', from, to, record) and ('gap', from, to, reason), which together cover the archive."""
    source, at = Window(file, size), 0
    packed = source.read(0, 2) == MEMBER[:2] or (source.read(0, 5) != VERSION[:5] and _first(source, MEMBER) < _first(source, VERSION))
    mark = MEMBER if packed else VERSION
    while at < size:
        try:
            found, end = _record_at(source, at, packed)
        except Damaged as error:
            why, start = str(error), at
            at = _claimed(source, at, packed) or _next(source, at + 1, mark, packed)
            yield "gap", start, at, why
            continue
        yield "record", at, end, found
        at = end


def _claimed(source: Window, at: int, packed: bool) -> int | None:
    """The end of a damaged plain record by its own length, if a sound record or the end of the archive is there."""
    if packed:
        return None
    try:
        fields, start = _head(_plain_head(source, at))
        end = _past_breaks(source, at + start + int(fields["content-length"]))
        return end if end == source.size or (end < source.size and _sound(source, end, packed)) else None
    except Damaged:
        return None


def _first(source: Window, mark: bytes, at: int = 0) -> int:
    """The first place of the mark from a place on; the end if there is none."""
    while at < source.size:
        piece = source.read(at, 1 << 16)
        hit = piece.find(mark)
        if hit >= 0:
            return at + hit
        at += max(1, len(piece) - len(mark) + 1)
    return source.size


def _next(source: Window, at: int, mark: bytes, packed: bool) -> int:
    """The next place where a record that proves itself begins; the end if there is none."""
    while (at := _first(source, mark, at)) < source.size:
        try:
            if _sound(source, at, packed):
                return at
        except Damaged:
            pass
        at += 1
    return source.size


def _sound(source: Window, at: int, packed: bool) -> bool:
    """Whether the whole record at a place names its type and id and proves itself; damage raises."""
    found, end = _record_at(source, at, packed)
    fields = found["fields"]
    if not fields.get("warc-type") or not fields.get("warc-record-id"):
        return False
    checked = ["warc-block-digest"] + ["warc-payload-digest"] * (fields["warc-type"] != "revisit")
    return packed or any(fields.get(name, "").startswith("sha1:") for name in checked) or end >= source.size or source.read(end, len(VERSION)) == VERSION


def referred(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, refers_to: the smallest page_id with the same payload, null for that one itself.

    Only digests are grouped; a payload travels once, to the task of its page_id and digest.
    """
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    sha = F.sha2(F.col("html").cast("binary"), 256)
    small = own.where(F.octet_length("html") >= least).select("page_id", sha.alias("sha"))
    firsts = small.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = spread_join(small, firsts, ["sha"], "n").where(~F.col("page_id").eqNullSafe(F.col("first")))
    again = again.select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), F.col("first").alias("refers_to")).distinct()
    rows = own.withColumn("sha", sha)
    return rows.join(again.hint("merge"), F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left").select("page_id", "url", "html", "refers_to")


def write_archives(pages: DataFrame, directory: str, least: int = 0, packed: bool = True) -> DataFrame:
    """Writes archives of about ARCHIVE_BYTES to the directory; returns their list: path, records, bytes."""
    spark = pages.sparkSession
    rows = referred(pages, least)
    rows = rows.sortWithinPartitions(*rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(directory)
        store.create_dir(base, recursive=True)
        context = TaskContext.get()
        part, attempt, made = context.partitionId(), context.taskAttemptId(), 0
        out, path, records = None, "", 0

        def close() -> pa.RecordBatch:
            size = out.tell()
            out.close()
            store.move(f"{path}.{attempt}.tmp", path)
            return pa.RecordBatch.from_pylist([{"path": f"{directory}/{posixpath.basename(path)}", "records": records, "bytes": size}])

        for batch in batches:
            for piece in slices(batch):
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    if out is None:
                        path, records = f"{base}/part-{part:05d}-{made:05d}.warc{'.gz' * packed}", 0
                        out, made = store.open_output_stream(f"{path}.{attempt}.tmp", compression=None), made + 1
                    data = record(page_id, url, html.encode(), refers_to)
                    if packed:
                        deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
                        data = deflate.compress(data) + deflate.flush()
                    out.write(data)
                    records += 1
                    if out.tell() >= ARCHIVE_BYTES:
                        yield close()
                        out = None
        if out is not None:
            yield close()

    listed = f"{directory}-list"
    with batches_of(spark, BATCH_BYTES):
        rows.mapInArrow(run, "path string, records long, bytes long").write.parquet(listed)
    return spark.read.parquet(listed)


def read_archives(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record and gap of the archives named in path: kind, path, begin, end, and the record's fields.

    Without payloads, payload is null and only its length leaves the worker that reads the archive.
    """
    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["path", "kind", "begin", "end", "reason", "type", "record_id", "uri", "refers_to", "payload_digest", "payload_bytes", "payload"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]

    def rows(path: str) -> Iterator[tuple]:
        store, name = fs.FileSystem.from_uri(path)
        with store.open_input_file(name) as file:
            for kind, begin, end, what in salvage(file, file.size()):
                if kind == "gap":
                    yield path, kind, begin, end, what, None, None, None, None, None, None, None
                    continue
                f = what["fields"]
                own = f.get("warc-payload-digest", "").removeprefix("sha1:") if f.get("warc-type") == "revisit" else digest(what["payload"])
                yield path, kind, begin, end, None, f.get("warc-type"), f.get("warc-record-id"), f.get("warc-target-uri"), f.get("warc-refers-to"), own, len(what["payload"]), what["payload"] if payloads else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows(path):
                    held.append(row)
                    size += len(row[-1] or b"")
                    if size > 1 << 22 or len(held) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    return paths.select("path").repartition(parts, "path").mapInArrow(run, "path string, kind string, begin long, end long, reason string, type string, record_id string, uri string, refers_to string, payload_digest string, payload_bytes long, payload binary")


def read_pages(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; a gap raises.

    A revisit has the length of the response that it refers to, null if that is not in the archives.
    """
    page = lambda c: F.regexp_extract(c, r"urn:page:(-?\d+)", 1).try_cast("long")
    lost = F.raise_error(F.concat(F.lit("gap in "), "path", F.lit(" at "), F.col("begin").cast("string"), F.lit(": "), "reason")).cast("string")
    name = F.when(F.col("kind") == "record", F.col("record_id")).otherwise(lost)
    rows = read_archives(archives, payloads=False).select(page(name).alias("page_id"), F.col("payload_bytes").alias("n"), "payload_digest", F.col("type").alias("record_type"), page(F.coalesce("refers_to", F.lit(""))).alias("refers_to"))
    found = checkpointed(rows)
    kept = found.where("record_type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    whole = kept.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    again = found.where("record_type <> 'response'").drop("n")
    asked = again.groupBy("refers_to", "payload_digest").agg(F.count("*").alias("asks")).join(whole.hint("merge"), ["refers_to", "payload_digest"], "left")
    vague = again.where("refers_to IS NULL OR payload_digest IS NULL").withColumn("payload_bytes", F.lit(None).cast("long"))
    return kept.unionByName(spread_join(again, asked, ["refers_to", "payload_digest"], "asks").select(kept.columns)).unionByName(vague.select(kept.columns))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(write_archives(table(spark, sf_dir, "pages"), fresh_dir(spark, "warc")))


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(((('0x' || substr(hex, 5 * i // 4 + 1, 2))::INT >> (3 - 5 * i % 4)::INT) & 31) + 1)::INT]), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
