"""Web archives in ZIP packages: writing WARC records with an index, and reading them by ranges without extraction.

A package is one ZIP file with stored (not deflated) members: `archive/data.warc.gz`, where every record is a gzip member of its
own, and `indexes/index.cdx`, a JSON line with place and length for each record. Stored members are plain ranges of the package,
so the reader parses the end record, the ZIP64 record and the central directory, reads the index's range, and then each
record's range.

Packages are rows (package, content), as `spark.read.format("binaryFile")` gives them for files in any store. Writing cuts the
stream of a task into packages of about PACKAGE_BYTES, or of one record if that is longer, so that tasks hold one package.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlake.llm.common import register, table, written

PACKAGE_BYTES = 8 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
WRITTEN_AT = "2024-01-01T00:00:00Z"  # the pages carry no time
# Fixed values of the ZIP format: signatures of its records, and the sizes that say "see the ZIP64 field".
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
IN_64_2, IN_64_4 = 0xFFFF, 0xFFFFFFFF


# ---- ZIP ----

def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members; with zip64, sizes and places stand in ZIP64 fields even if they would fit."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        raw, at, crc, size = name.encode(), len(out), zlib.crc32(data), len(data)
        wide = zip64 or size >= IN_64_4 or at >= IN_64_4
        short = IN_64_4 if wide else size
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        out += LOCAL + struct.pack("<HHHHHIIIHH", 45 if wide else 20, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(extra)) + raw + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
        central += CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(extra), 0, 0, 0, 0,
                                         IN_64_4 if wide else at) + raw + extra
    at, size, n = len(out), len(central), len(members)
    out += central
    if zip64 or at >= IN_64_4 or n >= IN_64_2:
        end64 = len(out)
        out += END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, at) + LOCATOR64 + struct.pack("<IQI", 0, end64, 1)
        n, size, at = IN_64_2, IN_64_4, IN_64_4
    return bytes(out + END + struct.pack("<HHHHIIH", 0, 0, n, n, size, at, 0))


class Ranges:
    """A file of which only ranges are read."""

    def __init__(self, content):
        self.view = memoryview(content)
        self.size = len(self.view)

    def read(self, at: int, size: int) -> bytes:
        if at < 0 or size < 0 or at + size > self.size:
            raise ValueError(f"range {at}+{size} is outside a file of {self.size} bytes")
        return bytes(self.view[at:at + size])


def stored_members(file: Ranges) -> dict[str, tuple[int, int]]:
    """Place and size of the data of each stored member, from the central directory; compressed members are left out."""
    tail_at = max(0, file.size - 22 - 0xFFFF)
    tail = file.read(tail_at, file.size - tail_at)
    k = tail.rfind(END)
    while k >= 0 and (len(tail) < k + 22 or k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail)):
        k = tail.rfind(END, 0, k)
    if k < 0:
        raise ValueError("no end record: not a ZIP file")
    n, size, at = struct.unpack_from("<HII", tail, k + 10)
    end_at = tail_at + k
    if end_at >= 20 and (n == IN_64_2 or IN_64_4 in (size, at)):
        locator = file.read(end_at - 20, 20)
        if locator[:4] == LOCATOR64:
            record = file.read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != END64:
                raise ValueError("the ZIP64 end record is missing")
            n, size, at = struct.unpack_from("<QQQ", record, 32)
    directory, out, p = file.read(at, size), {}, 0
    for _ in range(n):
        if directory[p:p + 4] != CENTRAL:
            raise ValueError("the central directory is broken")
        flags, method = struct.unpack_from("<HH", directory, p + 8)
        packed, plain, names, extras, comments = struct.unpack_from("<IIHHH", directory, p + 20)
        local = struct.unpack_from("<I", directory, p + 42)[0]
        name = directory[p + 46:p + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        q, stop = p + 46 + names, p + 46 + names + extras
        while q + 4 <= stop:
            kind, length = struct.unpack_from("<HH", directory, q)
            if kind == 1:  # in this order, those that the short fields leave to it
                f = q + 4
                if plain == IN_64_4:
                    plain, f = struct.unpack_from("<Q", directory, f)[0], f + 8
                if packed == IN_64_4:
                    packed, f = struct.unpack_from("<Q", directory, f)[0], f + 8
                if local == IN_64_4:
                    local = struct.unpack_from("<Q", directory, f)[0]
            q += 4 + length
        if method == 0 and packed == plain:
            head = file.read(local, 30)
            if head[:4] != LOCAL:
                raise ValueError(f"no local header of {name}")
            out[name] = (local + 30 + sum(struct.unpack_from("<HH", head, 26)), packed)
        p = stop + comments
    return out


# ---- WARC ----

def _record(page: int | None, url: str | None, payload: bytes | None, digest: str, size: int, response: int | None) -> bytes:
    """A record as one gzip member; payload None: a revisit of the page `response`."""
    kind = "revisit" if payload is None else "response"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {WRITTEN_AT}",
             "WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url or ""), f"WARC-Payload-Digest: sha1:{digest}",
             f"X-Payload-Length: {size}"]
    if payload is None:
        lines += [f"WARC-Refers-To: <urn:page:{response}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = payload or b""
    head = "\r\n".join([*lines, "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]) + "\r\n\r\n"
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(head.encode()) + pack.compress(body) + pack.compress(b"\r\n\r\n") + pack.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record's gzip member; its digest is checked."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[:int(fields["content-length"])]
    if fields["warc-type"] == "response" and "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["warc-payload-digest"]:
        raise ValueError("a payload doesn't have its digest")
    return fields, block


def _packages(package_bytes: int, zip64: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, data, index = TaskContext.get().partitionId() << 32, bytearray(), []

        def close():
            nonlocal number, data, index
            content = zip_stored([(DATA, bytes(data)), (INDEX, "".join(index).encode())], zip64)
            out = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([content], pa.binary())], names=["package", "content"])
            number, data, index = number + 1, bytearray(), []
            return out

        for batch in batches:
            for page, url, payload, sha, size, response in zip(*(c if i == 2 else c.to_pylist() for i, c in enumerate(batch.columns))):
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                record = _record(page, url, None if response is not None else (payload.as_py() or "").encode(), digest, size, response)
                index.append(json.dumps({"page": page, "offset": len(data), "length": len(record)}) + "\n")
                data += record
                if len(data) >= package_bytes:
                    yield close()
        if data:
            yield close()

    return run


def write_packages(pages: DataFrame, min_bytes: int = 0, package_bytes: int = PACKAGE_BYTES, zip64: bool = False) -> DataFrame:
    """(package, content): ZIP packages with one WARC record for each row of pages.

    The payload is html in UTF-8 (null: empty). Of records with equal payloads of min_bytes or more, that with the smallest page_id
    is a response and the others revisit it; smaller ones are responses. Rows that repeat a page_id and payload are written each;
    all but one row with the smallest page_id are revisits. A payload known only from rows without page_id is always a response.
    Only digests are grouped; the texts are shuffled once, to meet the first page of their digest.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("size", F.octet_length("html").cast("long")).withColumn("sha", F.sha1("html"))
    long_ = rows.where(F.col("size") >= min_bytes)
    firsts = long_.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    firsts = written(firsts.drop("n"), "warc-firsts")
    met = rows.join(firsts, ["sha", "size"], "left")
    is_first = F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    response = F.when(F.col("first").isNotNull() & ~is_first, F.col("first"))
    # rows that repeat the first page's id: one stays a response
    again = written(long_.where("page_id IS NOT NULL").groupBy("page_id", "sha", "size").agg(F.count("*").alias("n")).where("n > 1").select("page_id", "sha", "size"), "warc-again")
    if not again.isEmpty():
        held = met.join(again.withColumn("again", F.lit(True)), ["page_id", "sha", "size"], "left")
        repeated = held.where("again AND page_id = first")
        one = repeated.dropDuplicates(["page_id", "sha", "size"]).withColumn("response", F.lit(None).cast("long"))
        counts = repeated.groupBy("page_id", "sha", "size").agg((F.count("*") - 1).alias("n"), F.min("url").alias("url"), F.min("first").alias("response"))
        more = counts.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).withColumn("html", F.lit(None).cast("string"))
        rest = held.where("NOT coalesce(again AND page_id = first, false)").withColumn("response", response)
        names = ["page_id", "url", "html", "sha", "size", "response"]
        decided = rest.select(names).unionByName(one.select(names)).unionByName(more.select(names))
    else:
        decided = met.select("page_id", "url", "html", "sha", "size", response.alias("response"))
    decided = decided.withColumn("html", F.when(F.col("response").isNull(), F.col("html")))
    return decided.select("page_id", "url", "html", "sha", "size", "response").mapInArrow(_packages(package_bytes, zip64), "package long, content binary")


def _records(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                file = Ranges(content.as_buffer())
                members = stored_members(file)
                (data_at, data_size), (index_at, index_size) = members[DATA], members[INDEX]
                out: list[list] = [[] for _ in range(7)]
                for line in file.read(index_at, index_size).splitlines():
                    entry = json.loads(line)
                    if entry["offset"] + entry["length"] > data_size:
                        raise ValueError("the index points outside the archive")
                    fields, block = parse_record(file.read(data_at + entry["offset"], entry["length"]))
                    page, refers = (re.fullmatch(r"<urn:page:(-?\d*)>", fields[k])[1] if k in fields else "" for k in ("warc-record-id", "warc-refers-to"))
                    for column, value in zip(out, (int(page) if page else None, fields["warc-target-uri"], int(fields["x-payload-length"]),
                                                   fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"], int(refers) if refers else None,
                                                   block.decode() if with_payload and fields["warc-type"] == "response" else None)):
                        column.append(value)
                types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=names)

    return run


def read_packages(packages: DataFrame, with_payload: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, html) of every record of the packages in `content`.

    html: of responses, if asked for. An empty table gives an empty result; a broken package, record or digest is an error.
    """
    return packages.select("content").mapInArrow(_records(with_payload), "page_id long, url string, payload_bytes long, payload_digest string, "
                                                 "record_type string, refers_to long, html string")


_BASE32 = "||".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v{i} >> {s}) & 31 AS INT) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))
_PARTS = ", ".join(f"CAST('0x' || substr(s, {5 * i + 1}, 5) AS BIGINT) AS v{i}" for i in range(8))
WARC_SQL = f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS s FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY s, payload_bytes) AS first, {_PARTS} FROM p)
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
        CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""


@register("op8_warc_zip", WARC_SQL)
def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = written(write_packages(table(spark, sf_dir, "pages")), "warc")
    return read_packages(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
