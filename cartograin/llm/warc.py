"""WARC archives: writing response and revisit records with Spark, and a salvage reader.

Each record is a gzip member of its own, so a damaged one takes no other with it. Tasks write WARC/1.1 archives of bounded
size straight to the store (through pyarrow's file systems) and return a row for each; that table of archives is committed
by Spark, and what a lost or repeated attempt left behind is not in it. The reader takes each archive (plain, or gzip
members) and checks every record: version line, header and the numbers in it, length, the end mark and the block's digest. After a failed check
it searches for the next valid gzip member or version line, goes on from there and reports the bytes between as a
quarantined gap; a version line inside a page is passed over, for the record that it would begin fails its checks.
"""

from __future__ import annotations

import gzip
import re
import uuid
import zlib
from base64 import b32encode
from hashlib import sha1

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, table, written

_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_MEMBER, _VERSION, _END = b"\x1f\x8b\x08", b"WARC/1.", b"\r\n\r\n"
_NO_ID = -(1 << 63)
_DIGITS, _PAGE = re.compile(r"[0-9]{1,18}"), re.compile(r"<urn:page:(-?[0-9]{1,20})>")
#: Bytes of records that a reading task hands on at a time.
FLUSH = 8 << 20


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return b32encode(sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, n: int, refers_to: int | None) -> str:
    """A record without its last line end: a response with the payload, or a revisit if refers_to is given."""
    block = _HTTP if refers_to is not None else _HTTP + payload.decode()
    raw = block.encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f-\xa0\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"X-Payload-Length: {n}", f"WARC-Block-Digest: sha1:{digest(raw)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(raw)}"]
    return "\r\n".join(lines) + "\r\n\r\n" + block + "\r\n"


def _number(value: str) -> int:
    """A count of bytes in a header; anything but up to 18 digits raises ValueError."""
    if not _DIGITS.fullmatch(value):
        raise ValueError(value)
    return int(value)


def _page_id(value: str | None) -> int | None:
    """The page's id in a record's name; None for other names. An id beyond 64 bits raises ValueError."""
    if not (found := _PAGE.fullmatch(value or "")):
        return None
    if not -(1 << 63) <= (page_id := int(found[1])) < 1 << 63:
        raise ValueError(value)
    return page_id


def _parsed(data: bytes, at: int) -> tuple[int, dict[str, str], bytes] | str:
    """The end, header and block of the record at a place, or why there is none."""
    if not data.startswith(_VERSION, at):
        return "no version line"
    if (end := data.find(_END, at)) < 0:
        return "header does not end"
    try:
        lines = data[at:end].decode().split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        start = end + 4
        stop = start + _number(head["content-length"])
        _number(head.get("x-payload-length", "0"))
        for name in ("warc-record-id", "warc-refers-to"):
            _page_id(head.get(name))
    except (ValueError, KeyError):
        return "bad header"
    if not ("warc-type" in head and "warc-record-id" in head):
        return "missing field"
    if stop < start or data[stop : stop + 4] != _END:
        return "bad length"
    block = data[start:stop]
    if "warc-block-digest" in head and head["warc-block-digest"] != f"sha1:{digest(block)}":
        return "bad digest"
    return stop + 4, head, block


def _plain(data: bytes, at: int, stop: int):
    """Records and gaps of data[at:stop]: ("record", offset, length, head, block) or ("gap", offset, length, reason)."""
    while at < stop:
        if not isinstance(found := _parsed(data, at), str):
            yield "record", at, found[0] - at, found[1], found[2]
            at = found[0]
            continue
        after = at
        while (after := data.find(_VERSION, after + 1, stop)) >= 0 and isinstance(_parsed(data, after), str):
            pass
        after = stop if after < 0 else after
        yield "gap", at, after - at, found
        at = after


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """Content and end of the gzip member at a place; fails unless its check sum holds."""
    unpack, parts = zlib.decompressobj(31), []
    while not unpack.eof and at < len(data):
        parts.append(unpack.decompress(data[at : at + (1 << 16)]))
        at += 1 << 16
    if not unpack.eof:
        raise zlib.error("member does not end")
    return b"".join(parts), min(at, len(data)) - len(unpack.unused_data)


def salvage(data: bytes):
    """Records and gaps of an archive, in order, which together cover all its bytes; offsets and lengths as stored."""
    if _MEMBER not in data[:3] and _MEMBER not in data:
        yield from _plain(data, 0, len(data))
        return
    at, gap, why = 0, None, ""
    while at < len(data):
        if data.startswith(_MEMBER, at):
            try:
                content, end = _member(data, at)
                parts = [*_plain(content, 0, len(content))]
                if gap is not None:
                    yield "gap", gap, at - gap, why
                    gap = None
                for kind, _, _, *rest in parts:
                    yield kind, at, end - at, *rest
                at = end
                continue
            except zlib.error as e:
                reason = str(e)
        elif data.startswith(_VERSION, at) and not isinstance(found := _parsed(data, at), str):
            if gap is not None:
                yield "gap", gap, at - gap, why
                gap = None
            yield "record", at, found[0] - at, found[1], found[2]
            at = found[0]
            continue
        else:
            reason = "no member or version line"
        if gap is None:
            gap, why = at, reason
        after = [x for x in (data.find(_MEMBER, at + 1), data.find(_VERSION, at + 1)) if x >= 0]
        at = min(after, default=len(data))
    if gap is not None:
        yield "gap", gap, len(data) - gap, why


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = 100_000, file_bytes: int = 64 << 20) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) to new archives under path; (file, records, bytes) of each.

    The payload is html in UTF-8; null is empty. Of rows with equal payloads of min_bytes at least, those with the smallest
    id are responses, the others revisits that refer to it; shorter payloads are all responses. Rows without an id are
    written too: as revisits if a row with an id has their payload. Repeated rows give repeated records. A null url gives
    no target line. Other columns are ignored. An empty table gives no archives. An archive ends at file_bytes (or
    records_per_file), so that any of them fits into one task; path is any that pyarrow can open for writing.
    """

    def sign(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            bodies = [(h or "").encode() for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([digest(x) for x in bodies]), pa.array([len(x) for x in bodies], pa.int64()), pa.array([pack.compress(x) for x in bodies], pa.binary())], ["key", "url", "digest", "n", "z"])

    def archive(batches):
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        store, folder = FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        at, unpack = TaskContext.get(), zstandard.ZstdDecompressor()
        name, out, records, size, done = "", None, 0, 0, []
        for b in batches:
            for k, url, d, n, z, first in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name = f"part-{at.partitionId():06d}-{len(done):04d}-{uuid.uuid4().hex}.warc.gz"
                    out, records, size = store.open_output_stream(f"{folder}/{name}", compression=None), 0, 0
                body = unpack.decompress(z) if first is None else b""
                member = gzip.compress((record(None if k == _NO_ID else k, url, body, d, n, first) + "\r\n").encode(), 6, mtime=0)
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= file_bytes or records >= records_per_file:
                    out.close()
                    done.append((name, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, records, size))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "records", "bytes"])

    pages = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(_NO_ID)).alias("key"), F.col("url").cast("string"), F.col("html").cast("string"))
    signed = pages.mapInArrow(sign, "key long, url string, digest string, n long, z binary")
    alone = signed.select("key", "digest", "n").filter(F.col("n") >= min_bytes)
    same = alone.groupBy("digest", "n").agg(F.min(F.when(F.col("key") != _NO_ID, F.col("key"))).alias("first"), F.count("*").alias("rows")).filter("rows > 1 and first is not null")
    same = same.select(F.col("digest").alias("digest_"), F.col("n").alias("n_"), "first")
    again = alone.join(same, (F.col("digest") == F.col("digest_")) & (F.col("n") == F.col("n_"))).filter("key <> first").select(F.col("key").alias("key_"), "digest_", "first").distinct()
    rows = signed.join(again, (F.col("key") == F.col("key_")) & (F.col("digest") == F.col("digest_")), "left")
    rows = rows.select("key", "url", "digest", "n", F.when(F.col("first").isNull(), F.col("z")).otherwise(F.lit(b"")).alias("z"), "first")
    return written(rows.mapInArrow(archive, "file string, records long, bytes long"), "warc-archives")


def read_warc(spark, path: str, with_payload: bool = False, names_like: str = "*.{txt,warc,warc.gz}") -> DataFrame:
    """(file, offset, length, kind, reason, page_id, record_type, payload_bytes, payload_digest, refers_to[, payload]).

    kind is "record" or "gap" (then reason says which check failed first). A response's length and digest come from the
    payload as read, a revisit's from its header. Payload is null for gaps and revisits. names_like: a glob of the files'
    names. An empty archive, or a folder without archives, gives no rows. Each archive is read whole by one task, so it
    must be under 2 GB.
    """
    names = ["file", "offset", "length", "kind", "reason", "page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(10 + with_payload)], names[: 10 + with_payload])

    def read(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                rows, held = [], 0
                for kind, offset, length, *rest in salvage(data.as_buffer().to_pybytes()):
                    if kind == "gap":
                        rows.append((name, offset, length, kind, rest[0], *[None] * 6))
                        continue
                    head, block = rest
                    revisit = head.get("warc-type") == "revisit"
                    body = block.partition(_END)[2]
                    n, d = (_number(head.get("x-payload-length", "0")), head.get("warc-payload-digest", "").removeprefix("sha1:")) if revisit else (len(body), digest(body))
                    rows.append((name, offset, length, kind, None, _page_id(head.get("warc-record-id")), head.get("warc-type"), n, d, _page_id(head.get("warc-refers-to")), None if revisit or not with_payload else body))
                    held += len(rows[-1][-1] or b"") + 256
                    if held >= FLUSH:
                        yield batch(rows)
                        rows, held = [], 0
                yield batch(rows)

    schema = "file string, offset long, length long, kind string, reason string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * with_payload
    files = spark.read.format("binaryFile").option("pathGlobFilter", names_like).load(path)
    return files.select("path", "content").mapInArrow(read, schema)


def quarantined(found: DataFrame, path: str) -> DataFrame:
    """Writes the gaps of read_warc()'s rows as a log of JSON lines (file, offset, length, reason) under path, and returns the records."""
    found.filter("kind = 'gap'").select("file", "offset", "length", "reason").write.json(path)
    return found.filter("kind = 'record'")


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """Archives of all pages, written and read back; gaps go to a log beside them. Nulls and repeats as write_warc() says."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archives = write_warc(table(spark, sf_dir, "pages"), path)
    found = read_warc(spark, path).withColumn("name", F.element_at(F.split("file", "/"), -1))
    found = found.join(archives.select(F.col("file").alias("name")), "name", "left_semi")
    found = quarantined(written(found, "warc-found"), f"{path}-quarantine")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)  # read back and written as a table: the archives are not needed any more
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same in DuckDB; base 32 from the digest's bits.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
b AS (SELECT page_id, html, from_hex(sha1(html))::BIT::VARCHAR AS bits, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * (substr(bits, 5 * k + 1, 1) = '1')::INT + 8 * (substr(bits, 5 * k + 2, 1) = '1')::INT
    + 4 * (substr(bits, 5 * k + 3, 1) = '1')::INT + 2 * (substr(bits, 5 * k + 4, 1) = '1')::INT + (substr(bits, 5 * k + 5, 1) = '1')::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b
"""
