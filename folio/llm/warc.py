"""Web archives: legacy ARC files to WARC files, and a reader of WARC records.

Archives are written by Spark's text writer, so they lie in whatever store Spark writes to;
each file is one gzip stream of records and is read as a whole by one task. Files are
sized by the bytes of the pages. The converter parses ARC header lines of version 1 (URL,
address, date, type, length) and version 2 (URL, address, date, type, status, checksum,
location, offset, file name, length), follows the declared lengths, and makes WARC
identifiers, timestamps, types and digests from them.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm import common

#: Payload bytes for each archive file; and from which size equal payloads become revisits.
FILE_BYTES, REVISIT_BYTES = 8 << 20, 1000
_V1 = "URL IP-address Archive-date Content-type Archive-length"
_V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _escaped(url: Column) -> Column:
    """Header lines are split at spaces."""
    return F.regexp_replace(F.when(F.length(url) > 0, url).otherwise("about:blank"), r"[\s\x00-\x20]", "%20")


def write_arc(pages: DataFrame, path: str, version: Column, date: str = "20240101000000", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """An ARC record for every row; version: a column of 1 or 2. Null payloads are empty."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), _escaped(F.col(url_col)).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), version.alias("version"))
    size = F.octet_length("html")
    total = rows.agg(F.sum(size)).first()[0] or 0
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\nX-Page-Id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("\r\n\r\n")
    )
    rows = rows.withColumn("body", F.concat(head, "html")).withColumn("length", F.octet_length("body").cast("string"))
    one = F.concat_ws(" ", "url", F.lit("0.0.0.0"), F.lit(date), F.lit("text/html"), "length")
    two = F.concat_ws(" ", "url", F.lit("0.0.0.0"), F.lit(date), F.lit("text/html"), F.lit("200"), F.md5(F.encode("body", "UTF-8")), F.lit("-"), F.lit("0"), F.lit("pages.arc"), "length")
    record = F.concat(F.when(F.col("version") == 2, two).otherwise(one), F.lit("\n"), "body")
    # a hash of the id deals pages evenly, and the number of files follows the bytes; a file is of one version
    files = max(1, total // FILE_BYTES)
    for v, fields in ((1, _V1), (2, _V2)):
        names = f"{v} 0 folio\n{fields}\n"
        block = f"filedesc://pages.arc 0.0.0.0 {date} text/plain {len(names)}\n{names}"

        def opened(batches, block=block):
            first = True
            for batch in batches:
                if first and batch.num_rows:  # a version block opens each file
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.string())], names=["value"])
                    first = False
                yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])

        dealt = rows.where(F.col("version") == v).select(record.alias("value"), "id").repartition(max(1, files // 2), "id")
        dealt.mapInArrow(opened, "value string").write.option("lineSep", "\n").option("compression", "gzip").text(f"{path}/v{v}")


def parse_arc(data: bytes):
    """(version, url, address, date, type, body) of every record of an ARC file.

    The version block at the start declares the version and with it the fields of header lines. A header line with other
    fields, or a record that ends early, is an error: what follows could not be told from payloads."""
    at, version = 0, 0
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].rstrip(b"\r")
        if not line:  # blank lines stand between records
            at = at + 1 if end < 0 else end + 1
            continue
        fields = line.split(b" ")
        opens = fields[0].startswith(b"filedesc://")
        if end < 0 or not fields[-1].isdigit() or len(fields) != {0: 5, 1: 5, 2: 10}[0 if opens else version] or not (opens or version):
            raise ValueError(f"no ARC header line at byte {at}: {line[:80]!r}")
        length = int(fields[-1])
        body = data[end + 1 : end + 1 + length]
        if len(body) < length:
            raise ValueError(f"the ARC record at byte {at} ends early")
        at = end + 1 + length
        if opens:
            version = int(body.split(b" ", 1)[0])
            if version not in (1, 2):
                raise ValueError(f"ARC version {version} is not known")
        else:
            yield version, *(f.decode("utf-8", "replace") for f in fields[:4]), body


def split_http(body: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of an HTTP response."""
    head, mark, payload = body.partition(b"\r\n\r\n")
    if not body.startswith(b"HTTP/") or not mark:
        return {}, body
    headers = (line.partition(":") for line in head.decode("latin-1").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in headers}, payload


def unpacked(raw: bytes) -> bytes:
    """A file's bytes: plain, or gzip of one member or of many (a member a record is the usual form)."""
    out = []
    while raw[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(47)
        out.append(member.decompress(raw))
        if not member.eof:
            raise ValueError("a gzip member ends early")
        raw = member.unused_data.lstrip(b"\0")  # files may be padded
    if out and raw:
        raise ValueError(f"no gzip member: {raw[:20]!r}")
    return b"".join(out) if out else raw


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def _archive(batches, parse):
    for batch in batches:
        for content in batch.column(0):
            yield from parse(unpacked(content.as_py()))


_ARC_SCHEMA = "page_id long, url string, address string, date string, type string, payload_bytes long, payload_digest string, body binary"


def read_arc(spark, path: str) -> DataFrame:
    """The records of ARC files, one row each; body is the HTTP response, of whatever bytes."""

    @common.frugal
    def run(batches):
        rows, held = [], 0
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = [x.strip().split(" ")[0] for x in _ARC_SCHEMA.split(",")]
        block = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, types)], names=names)
        for _, url, address, date, kind, body in _archive(batches, parse_arc):
            headers, payload = split_http(body)
            rows.append((_number(headers.get("x-page-id")), url, address, date, kind, len(payload), hashlib.sha1(payload).hexdigest(), body))
            held += len(body)
            if held > common.CHUNK_BYTES:
                yield block()
                rows, held = [], 0
        yield block()

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, _ARC_SCHEMA)


def record_id(digest: Column, url: Column, date: Column, page: Column) -> Column:
    """urn:uuid of version 5 from what identifies the legacy record."""
    h = F.sha1(F.concat(F.lit(bytearray(_SPACE.bytes)), F.encode(F.concat_ws(" ", url, date, digest, page.cast("string")), "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), F.conv(part(17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat(F.lit("urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def convert(records: DataFrame) -> DataFrame:
    """WARC records (column value) of ARC records: revisits of equal payloads refer to the one with
    the largest page id; records without an id revisit it too, and stand as they are if no equal one has an id.

    Which records are revisits is told by small rows without bodies, and then by the record's own identifier, so
    that no payload, however common, brings bodies together."""
    named = records.withColumn("rid", record_id(F.col("payload_digest"), F.col("url"), F.col("date"), F.col("page_id")))
    small = common.cut(named.where(f"payload_bytes >= {REVISIT_BYTES}").select("payload_digest", "page_id", "rid", "url", "date"), "digests")
    stands = small.where("page_id is not null").groupBy("payload_digest").agg(F.max(F.struct("page_id", "rid", "url", "date")).alias("keeper"))
    again = small.join(stands, "payload_digest").where("not page_id <=> keeper.page_id").select(F.col("rid").alias("again"), "keeper").distinct()
    seen = named.join(common.few(again, "revisits"), F.col("rid") == F.col("again"), "left")
    revisit = F.col("keeper").isNotNull()
    stamp = lambda date: F.concat_ws("", *[x for a, n, s in ((1, 4, "-"), (5, 2, "-"), (7, 2, "T"), (9, 2, ":"), (11, 2, ":"), (13, 2, "Z")) for x in (F.substring(date, a, n), F.lit(s))])
    body = F.col("body").cast("string")  # the same bytes, whatever they are
    block = F.when(revisit, F.concat(F.substring_index(body, "\r\n\r\n", 1), F.lit("\r\n\r\n"))).otherwise(body)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    bracketed = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    refers = F.concat(
        line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", bracketed(F.col("keeper.rid"))), line("WARC-Refers-To-Target-URI", F.col("keeper.url")),
        line("WARC-Refers-To-Date", stamp("keeper.date")), line("WARC-Refers-To-Page", F.col("keeper.page_id").cast("string")),
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
    )
    text = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", bracketed(F.col("rid"))), line("WARC-Date", stamp("date")),
        line("WARC-Target-URI", F.col("url")), line("WARC-IP-Address", F.col("address")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(revisit, refers).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block,
    )
    return seen.select(text.alias("value"))


#: What a file says of itself, in its first record.
INFO = "software: folio\r\nformat: WARC File Format 1.1\r\n"


def write_warc(records: DataFrame, path: str) -> None:
    """Records (column value) as WARC files; each record ends in two line breaks, and a warcinfo record opens each file."""
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # of its partition, which is one file
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    info = F.concat(F.lit("WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:"), F.expr("uuid()"), F.lit(">\r\nWARC-Date: "), stamp, F.lit(f"\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(INFO)}\r\n\r\n{INFO}\r\n\r\n"))
    records = records.select(F.when(first, F.concat(info, "value")).otherwise(F.col("value")).alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def parse_warc(data: bytes):
    """(headers with names in lower case, block) of every record."""
    at = 0
    while True:
        at = data.find(b"WARC/1.", at)
        if at < 0:
            return
        end = data.find(b"\r\n\r\n", at)
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])}
        length = int(headers["content-length"])
        yield headers, data[end + 4 : end + 4 + length]
        at = end + 4 + length


_WARC_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, refers_to_record string, intact boolean"


def read_warc(spark, path: str) -> DataFrame:
    """The responses and revisits of WARC files; intact: a response's payload has the declared digest and length."""

    @common.frugal
    def run(batches):
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
        names = [x.strip().split(" ")[0] for x in _WARC_SCHEMA.split(",")]
        rows = []
        block = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, types)], names=names)
        for headers, body in _archive(batches, parse_warc):
            kind = headers["warc-type"]
            if kind not in ("response", "revisit"):
                continue
            http, payload = split_http(body)
            declared = _number(headers.get("warc-payload-length") or http.get("content-length"))
            digest = headers.get("warc-payload-digest", "").partition(":")[2] or hashlib.sha1(payload).hexdigest()
            intact = kind == "revisit" or (declared in (None, len(payload)) and hashlib.sha1(payload).hexdigest() == digest)
            page, refers = _number(http.get("x-page-id")), _number(headers.get("warc-refers-to-page"))
            rows.append((page, len(payload) if declared is None else declared, digest, kind, refers, headers["warc-record-id"].strip("<>"), headers.get("warc-target-uri"), headers.get("warc-refers-to", "").strip("<>") or None, intact))
            if len(rows) >= 5000:
                yield block()
                rows = []
        yield block()

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _WARC_SCHEMA)


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Pages as ARC files of both versions, converted to WARC files, read back: one row a page.

    Null and empty payloads have no bytes and are responses; null URLs become about:blank; repeated rows
    have a record each, and of equal payloads all with the largest page id are responses; rows without an id revisit
    that one; payloads of any length are taken whole (a record is held in memory); other columns are not looked at; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    arc, warc = common.scratch(spark, "arc"), common.scratch(spark, "warc")
    version = F.lit(1) + F.abs(F.coalesce(F.col(columns.get("id_col", "page_id")), F.lit(0))) % 2
    write_arc(pages, arc, version.cast("int"), **columns)
    write_warc(convert(read_arc(spark, arc)), warc)
    return read_warc(spark, warc)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    back = round_trip(common.read_table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


#: What the archives give back is plain SQL over the pages.
ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, payload_bytes >= {REVISIT_BYTES} AND page_id IS DISTINCT FROM max(page_id) OVER (PARTITION BY payload_digest) AS again, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN keeper END AS refers_to, true AS intact FROM k
"""
