"""WARC archives: written from rows with identical-payload revisits, read back by a reader that salvages.

Each record is its own gzip member. The reader checks version line, headers, lengths and block digest; where a check
fails it looks for the next member (or, in plain archives, the next version line) from which a record passes, goes on
there, and reports the bytes between as a gap. A member of over MOST bytes, more than a cell of a Spark row holds, is a gap.

Which record a row becomes is decided on digests alone. Payloads meet the decision by digest and id, so that the many
rows of one payload are dealt out, and revisits never carry theirs.

Defined results: a null payload is empty; records of equal payload revisit the smallest non-null id (a group without
any id is all responses, and repeated rows of the smallest id are all responses); a null url is written empty; control
characters in a url are percent-encoded; an empty table writes no archive and reads back no record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import long, scratch, small_batches, table

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
MOST = (1 << 31) - 1
SCHEMA = T.StructType([T.StructField("kind", T.StringType()), T.StructField("archive", T.StringType()), long("start"), long("end"), T.StructField("record_type", T.StringType()), long("page_id"), long("refers_to"), T.StructField("target_uri", T.StringType()), long("payload_bytes"), T.StructField("payload_digest", T.StringType()), T.StructField("payload", T.BinaryType()), T.StructField("reason", T.StringType())])
ARROW = pa.schema([("kind", pa.string()), ("archive", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("reason", pa.string())])


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False, date: str = DATE, size: int | None = None, sha: bytes | None = None) -> bytes:
    """One WARC/1.1 record, uncompressed. A revisit keeps the HTTP head, which states the payload's length.

    size, sha: length and SHA-1 of the full payload, for a revisit that comes without it.
    """
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "").encode()
    said = digest(payload) if sha is None else base64.b32encode(sha).decode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (len(payload) if size is None else size)
    kind = b"revisit" if revisit else b"response"
    extra = f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: {_urn(refers_to)}\r\n".encode() if revisit else b""
    if not revisit:
        block += payload
    head = b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: %s\r\nWARC-Date: %s\r\nWARC-Target-URI: %s\r\n%sWARC-Payload-Digest: sha1:%s\r\nWARC-Block-Digest: sha1:%s\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: %d\r\n\r\n"
    return head % (kind, _urn(page_id).encode(), date.encode(), uri, extra, said.encode(), digest(block).encode(), len(block)) + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


VERSION, BLANK = re.compile(rb"WARC/1\.[01]\r\n"), re.compile(rb"\r\n\r\n")


class Bad(ValueError):
    pass


def parse_record(data: memoryview | bytes, at: int) -> tuple[dict, bytes, int]:
    """(headers in lower case, block, end) of the record that starts at `at`. Raises Bad where a check fails."""
    if not VERSION.match(data, at):
        raise Bad("version line")
    if not (blank := BLANK.search(data, at)):
        raise Bad("headers do not end")
    headers = {}
    for line in bytes(data[at : blank.start()]).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[\x21-\x7e]+", name.strip()):
            raise Bad("header line")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not {"warc-type", "warc-record-id", "warc-date"} <= headers.keys():
        raise Bad("mandatory header")
    if not headers.get("content-length", "").isdigit():
        raise Bad("content length")
    begin = blank.end()
    end = begin + int(headers["content-length"])
    if bytes(data[end : end + 4]) != b"\r\n\r\n":
        raise Bad("record end")
    block = bytes(data[begin:end])
    if (said := headers.get("warc-block-digest", "")).startswith("sha1:") and said[5:] != digest(block):
        raise Bad("block digest")
    return headers, block, end + 4


def plain_records(data: bytes) -> Iterator[tuple]:
    """("record", start, end, headers, block) and ("gap", start, end, reason) of an uncompressed archive."""
    at = 0
    while at < len(data):
        try:
            headers, block, end = parse_record(data, at)
            yield ("record", at, end, headers, block)
            at = end
        except Bad as why:
            start, reason, at = at, str(why), at + 1
            while 0 <= (at := data.find(b"WARC/1.", at)):
                try:
                    parse_record(data, at)
                    break
                except Bad:
                    at += 1
            at = len(data) if at < 0 else at
            yield ("gap", start, at, reason)


def inflate(data: memoryview, at: int, most: int = MOST) -> tuple[bytes, int]:
    """(contents, end) of the gzip member at `at`, checked by its CRC and length."""
    z, out, pos, size = zlib.decompressobj(31), [], at, 0
    try:
        while not z.eof:
            if pos >= len(data):
                raise Bad("member is cut off")
            out.append(z.decompress(data[pos : pos + 65536]))
            size += len(out[-1])
            pos = min(pos + 65536, len(data))
            if size > most:
                raise Bad("member is too large")
    except zlib.error as e:
        raise Bad(f"gzip: {str(e)[:60]}") from e
    return b"".join(out), pos - len(z.unused_data)


def records(data: bytes) -> Iterator[tuple]:
    """As plain_records, of an archive of gzip members or a plain one; start and end are offsets in the file."""
    if data[:2] != b"\x1f\x8b" and (b"\nWARC/1." in data or data[:7] == b"WARC/1." or b"\x1f\x8b\x08" not in data):
        yield from plain_records(data)
        return
    view, at = memoryview(data), 0
    while at < len(data):
        try:
            inner, end = inflate(view, at)
            found = list(plain_records(inner))
        except Bad as why:
            start, reason, at = at, str(why), at + 1
            while 0 <= (at := data.find(b"\x1f\x8b\x08", at)):
                try:
                    inner, _ = inflate(view, at)
                    if any(x[0] == "record" for x in plain_records(inner)):
                        break
                except Bad:
                    pass
                at += 1
            at = len(data) if at < 0 else at
            yield ("gap", start, at, reason)
            continue
        for x in found:
            yield (x[0], at, end, *x[3:])
        at = end


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def _row(archive: str, x: tuple, payloads: bool) -> dict:
    if x[0] == "gap":
        return {"kind": "gap", "archive": archive, "start": x[1], "end": x[2], "reason": x[3]}
    headers, block = x[3:]
    head, _, body = block.partition(b"\r\n\r\n")
    revisit = headers.get("warc-type") == "revisit"
    said = re.search(rb"(?im)^content-length:\s*(\d+)", head)
    out = {"kind": "record", "archive": archive, "start": x[1], "end": x[2], "record_type": headers.get("warc-type"), "page_id": _page(headers.get("warc-record-id")), "refers_to": _page(headers.get("warc-refers-to")), "target_uri": headers.get("warc-target-uri"), "payload_bytes": int(said[1]) if revisit and said else len(body), "payload_digest": headers.get("warc-payload-digest", "").removeprefix("sha1:") or None if revisit else digest(body)}
    return out | ({"payload": body} if payloads and not revisit else {})


def assign(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to, revisit, size, sha): which record each row becomes. A revisit's payload is null."""
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumns({"sha": F.unhex(F.sha1("payload")), "size": F.octet_length("payload").cast("long")})
    keys = rows.where(F.col("size") >= min_bytes).select("sha", "page_id").distinct()
    first = keys.groupBy("sha").agg(F.min("page_id").alias("first")).where("first is not null")
    # by digest and id: the rows of one payload, and their payloads, are dealt out
    known = keys.join(first, "sha").select(F.col("sha").alias("_sha"), F.col("page_id").alias("_id"), "first")
    found = rows.join(known, (F.col("sha") == F.col("_sha")) & F.col("page_id").eqNullSafe(F.col("_id")), "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    return found.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"), "size", "sha")


def write_archives(rows: DataFrame, folder: str, roll_bytes: int = 16 << 20, level: int = 1) -> tuple[int, int]:
    """Writes the rows of assign() as .warc.gz files of about roll_bytes. Returns the numbers of records and of files.

    folder: a URI in the shared store. A task sorts its rows, writes under names of its own and renames at the end, so a
    task that runs again replaces its files by equal ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, n, size, out, file, total = TaskContext.get().partitionId(), 0, 0, None, "", 0

        def close():
            nonlocal out, n
            if out is not None:
                out.close()
                target = f"{root}/part-{part:06d}-{n:05d}.warc.gz"
                if store.get_file_info(target).type != fs.FileType.NotFound:
                    store.delete_file(target)
                store.move(file, target)
                out, n = None, n + 1

        for b in batches:
            for page_id, url, payload, refers_to, revisit, length, sha in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", "revisit", "size", "sha")), strict=True):
                if out is None:
                    file, size = f"{root}/_{uuid.uuid4().hex}", 0
                    out = store.open_output_stream(file, compression=None)
                data = member(record(page_id, url, payload or b"", refers_to, revisit, size=length, sha=sha), level)
                out.write(data)
                size, total = size + len(data), total + 1
                if size >= roll_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([n], pa.int64())], names=["records", "files"])

    small_batches(rows.sparkSession)
    made = rows.sortWithinPartitions("page_id", "url", "revisit").mapInArrow(run, "records long, files long")
    return tuple(made.agg(F.coalesce(F.sum("records"), F.lit(0)), F.coalesce(F.sum("files"), F.lit(0))).first())


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """SCHEMA: a row for each record (kind record) and for each gap of quarantined bytes (kind gap, with the reason)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                rows, size = [], 0
                for x in records(content.as_py()):
                    rows.append(_row(path.as_py(), x, payloads))
                    size += len(x[4]) if payloads and x[0] == "record" else 200
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path", "content")
    return files.mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(hadoop)
    _, files = write_archives(assign(table(spark, sf_dir, "pages")), folder)
    found = sum(f.getPath().getName().endswith(".warc.gz") for f in store.listStatus(hadoop))
    if found != files:
        raise RuntimeError(f"{files} archives written, {found} found in {folder}")
    # the archives are new, so every byte is a record's: a gap is a fault, not a row to leave out
    sound = F.when(F.col("kind") == "record", True).otherwise(F.raise_error(F.format_string("%s: bytes %d to %d: %s", "archive", "start", "end", "reason")).cast("boolean"))
    return read_archives(spark, folder, payloads=False).where(sound).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def sql() -> str:
    """The query's rows in DuckDB SQL; base32 is spelled out from the bits of the hexadecimal digest."""
    bit = lambda j: f"(ascii(substring(bits, 5 * k + {j + 1}, 1)) - 48) * {16 >> j}"
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
b AS (SELECT page_id, strlen(body) AS n, sha1(body) AS sha, array_to_string(list_transform(string_split(sha1(body), ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '') AS bits FROM p),
d AS (SELECT page_id, n, sha, array_to_string(list_transform(range(0, 32), lambda k: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', {' + '.join(bit(j) for j in range(5))} + 1, 1)), '') AS digest, min(page_id) OVER (PARTITION BY sha) AS first FROM b)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CAST(CASE WHEN page_id <> first THEN first END AS BIGINT) AS refers_to FROM d"""
