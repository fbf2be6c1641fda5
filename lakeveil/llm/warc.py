"""WARC archives: writing captures, reading records, assembling transactions (operator 13).

A capture is three records: the request, the response (or a revisit, where an earlier capture has the same payload) and a
metadata record; request and metadata name the main record in WARC-Concurrent-To. Archives are written by Spark's text
sink, a record a row and CRLF CRLF between them, and read file by file. Assembly joins records by their identifiers and
gives one nested row per capture.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakeveil.llm.common import Scratch, as_array

#: Captures of a file at most: it is read as one row.
FILE_CAPTURES = 4_000
#: Smallest payload, in bytes, that a revisit stands for.
LEAST_BYTES = 0
#: Rows that one key is dealt to in joins by content.
SALT = 16
#: Bytes of records in one Arrow batch, and of an archive decompressed at a time.
BATCH_BYTES = 8 << 20

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAIN = ("response", "revisit")

RECORDS = pa.schema(
    [
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("warc_date", pa.string()),
        ("target_uri", pa.string()),
        ("concurrent_to", pa.list_(pa.string())),
        ("refers_to", pa.string()),
        ("fields", pa.map_(pa.string(), pa.string())),
        ("http_status", pa.int32()),
        ("payload", pa.binary()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("problem", pa.string()),
    ]
)
RECORDS_DDL = "record_id string, record_type string, warc_date string, target_uri string, concurrent_to array<string>, refers_to string, fields map<string,string>, http_status int, payload binary, payload_bytes long, payload_digest string, problem string"


def base32(hexed: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: five of them are four of base 32."""
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(*parts) -> Column:
    h = F.md5(F.concat_ws("\x00", *[p if isinstance(p, Column) else F.lit(p) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind, record_id: Column, date: str, uri: Column, headers: list, block: Column) -> Column:
    """A record without the two line ends that close it; headers whose value is null are left out."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri), *headers, ("Content-Length", F.octet_length(block).cast("string"))]
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), *[F.concat(F.lit(f"{name}: "), value) for name, value in lines])  # a null line is skipped
    return F.concat(head, F.lit("\r\n\r\n"), block)


def captures(scratch: Scratch, pages: DataFrame, least: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, html, digest, rid, refers_rid): captures with a number of their own; ``refers_rid`` names the capture that
    a revisit repeats: of equal payloads the one with the smallest page_id (a null one is the largest), else null."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    own = own.withColumn("digest", base32(F.sha1(F.col("html").cast("binary")))).withColumn("same", F.unhex(F.sha2(F.col("html").cast("binary"), 256))).withColumn("rid", F.monotonically_increasing_id())
    own = scratch.table("captures", own, compression="zstd")  # numbers are given once
    small = own.where(F.octet_length("html") >= least).select("same", "page_id", "rid")
    first = small.groupBy("same").agg(F.min(F.struct(F.col("page_id").isNull(), "page_id", "rid")).alias("b"), F.count("*").alias("n")).where("n > 1").select("same", F.col("b.rid").alias("refers_rid"))
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    again = small.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALT)).cast("int")).join(first, ["same", "salt"]).where("rid <> refers_rid").select("rid", "refers_rid")
    return own.drop("same").join(again, "rid", "left")


def write_archive(pages: DataFrame, path: str, scratch: Scratch, least: int = LEAST_BYTES, compression: str = "gzip", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a capture for every row to WARC files below ``path``.

    A null payload is empty. Repeated rows are captures of their own. A null url gives no target; blanks and line ends in
    one are escaped, other control characters left out. An empty table gives a folder without records. Further columns are ignored.
    """
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    df = captures(scratch, pages, least, id_col, url_col, html_col)
    url = F.col("url")
    for raw in " \t\r\n":
        url = F.replace(url, F.lit(raw), F.lit(f"%{ord(raw):02X}"))
    url = F.regexp_replace(url, r"[\x00-\x1F\x7F]", "")
    run = scratch.root.rsplit("-", 1)[-1]
    main, request, notes = (_urn(run, kind, F.col("rid").cast("string")) for kind in ("main", "request", "metadata"))
    again = F.col("refers_rid").isNotNull()
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    place = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)(.*)$", 1), F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)", 2)
    asked = F.concat(F.lit("GET "), F.when(place[1].startswith("/"), place[1]).otherwise(F.concat(F.lit("/"), place[1])), F.lit(" HTTP/1.1\r\nHost: "), place[0], F.lit("\r\n\r\n"))
    known = F.concat(F.concat_ws("\r\n", F.lit("via: pages"), F.concat(F.lit("page_id: "), F.col("page_id").cast("string"))), F.lit("\r\n"))
    joined = ("WARC-Concurrent-To", main)
    records = [
        _record(F.lit("request"), request, date, url, [joined, ("Content-Type", F.lit("application/http;msgtype=request"))], asked),
        _record(
            F.when(again, "revisit").otherwise("response"),
            main,
            date,
            url,
            [
                ("WARC-Payload-Digest", digest),
                ("WARC-Profile", F.when(again, PROFILE)),
                ("WARC-Refers-To", F.when(again, _urn(run, "main", F.col("refers_rid").cast("string")))),
                ("Content-Type", F.lit("application/http;msgtype=response")),
            ],
            F.when(again, http).otherwise(F.concat(http, "html")),
        ),
        _record(F.lit("metadata"), notes, date, url, [joined, ("Content-Type", F.lit("application/warc-fields"))], known),
    ]
    rows = df.select(F.explode(F.array(*records)).alias("value"))
    rows.write.mode("overwrite").option("lineSep", "\r\n\r\n").option("compression", compression).option("maxRecordsPerFile", 3 * FILE_CAPTURES).text(path)


def _plain(content: memoryview):
    """The bytes of a file, decompressed if it is gzip (any number of members)."""
    if bytes(content[:2]) != b"\x1f\x8b":
        for lo in range(0, len(content), BATCH_BYTES):
            yield bytes(content[lo : lo + BATCH_BYTES])
        return
    while len(content):
        inflate, at = zlib.decompressobj(31), 0
        while not inflate.eof:
            if at >= len(content):
                raise EOFError("a gzip member is cut off")
            part = content[at : at + (1 << 16)]
            at += len(part)
            yield inflate.decompress(part)
        content = content[at - len(inflate.unused_data) :]


def _header(head: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and out:  # a folded line
            out[-1] = (out[-1][0], out[-1][1] + " " + line.strip())
        else:
            name, _, value = line.partition(":")
            out.append((name.strip().lower(), value.strip()))
    return out


def raw_records(content):
    """(headers, block) of every record of a file; a length is taken from Content-Length alone, whatever the block holds."""
    chunks, buffer, at = _plain(memoryview(content)), bytearray(), 0

    def fill() -> bool:
        nonlocal at
        if at > BATCH_BYTES:
            del buffer[:at]
            at = 0
        more = next(chunks, None)
        if more is not None:
            buffer.extend(more)
        return more is not None

    while True:
        while buffer[at : at + 2] == b"\r\n" or (len(buffer) - at < 2 and fill()):
            if buffer[at : at + 2] == b"\r\n":
                at += 2
        if at >= len(buffer):
            return
        seen = at
        while (end := buffer.find(b"\r\n\r\n", seen)) < 0:
            seen, before = max(at, len(buffer) - 3), at
            if not fill():
                raise ValueError("a header is cut off")
            seen -= before - at
        head = bytes(buffer[at:end])
        if not head.startswith(b"WARC/"):
            raise ValueError("no record where one should begin")
        headers = _header(head.partition(b"\r\n")[2])
        length = next((int(v) for k, v in headers if k == "content-length"), None)
        if length is None or length < 0:
            raise ValueError("a record without its length")
        at = end + 4
        while len(buffer) - at < length:
            if not fill():
                raise ValueError("a block is cut off")
        block = bytes(buffer[at : at + length])
        at += length
        yield headers, block


def _parsed(headers: list, block: bytes, place: str) -> dict:
    first = dict(reversed(headers))
    kind = first.get("warc-type", "")
    row = {
        "record_id": first.get("warc-record-id") or place,
        "record_type": kind,
        "warc_date": first.get("warc-date"),
        "target_uri": first.get("warc-target-uri"),
        "concurrent_to": [v for k, v in headers if k == "warc-concurrent-to"],
        "refers_to": first.get("warc-refers-to"),
    }
    http = first.get("content-type", "").lower().startswith("application/http")
    payload = block
    if http:
        head, _, payload = block.partition(b"\r\n\r\n")
        line, _, rest = head.partition(b"\r\n")
        inner = _header(rest) if rest else []
        row["fields"] = list(dict(reversed(inner)).items())
        status = line.split(b" ")[1:2]
        if kind in MAIN and status and status[0].isdigit():
            row["http_status"] = int(status[0][:9])
    elif first.get("content-type", "").lower().startswith("application/warc-fields"):
        row["fields"] = list(dict(reversed(_header(block.strip(b"\r\n")))).items()) if block.strip(b"\r\n") else []
    told = first.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "revisit":  # the payload is elsewhere: what the headers tell of it
        length = dict(row.get("fields") or []).get("content-length", "")
        return row | {"payload_digest": told, "payload_bytes": int(length) if length.isdigit() else None}
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    problem = f"payload digest {told} is not that of the payload" if told and kind == "response" and told.upper() != digest else None
    return row | {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest, "problem": problem}


def _read(batches):
    rows, size = [], 0
    for batch in batches:
        paths = batch.column(0).to_pylist()
        for path, value in zip(paths, as_array(batch.column(1))):
            n = 0
            try:
                for headers, block in raw_records(value.as_buffer()):
                    rows.append(_parsed(headers, block, f"{path}#{n}"))
                    n, size = n + 1, size + len(block) + 500
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=RECORDS)
                        rows, size = [], 0
            except (ValueError, EOFError, zlib.error) as e:
                rows.append({"record_id": f"{path}#{n}", "record_type": "invalid", "concurrent_to": [], "problem": f"{path}, record {n}: {e}"})
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=RECORDS)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``, plain or gzip. What follows a damaged place of a file is not read: a record
    of type ``invalid`` says where. A payload that is not what its digest says keeps its row, with a ``problem``."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_read, RECORDS_DDL)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: the main record's columns, ``requests`` and ``metadata`` as arrays of records.

    A record belongs to a main record (response or revisit) that it names in WARC-Concurrent-To, that names it, or that the
    record it names belongs to. Of records with one identifier one stays. Records that belong to none (and invalid ones)
    are left out; a main record without others has empty arrays. An empty table gives no row.
    """
    main = records.where(F.col("record_type").isin(*MAIN)).dropDuplicates(["record_id"])
    other = records.where(F.col("record_type").isin("request", "metadata")).dropDuplicates(["record_id"])
    names = other.select(F.col("record_id").alias("other"), F.explode("concurrent_to").alias("id"))
    ids = main.select(F.col("record_id").alias("id"))
    named = names.join(ids, "id").select("other", F.col("id").alias("main"))
    naming = main.select(F.col("record_id").alias("main"), F.explode("concurrent_to").alias("other")).select("other", "main")
    direct = named.unionByName(naming).distinct()
    further = names.join(direct.select(F.col("other").alias("id"), "main"), "id").select("other", "main")
    links = direct.unionByName(further).distinct()
    told = other.select(F.col("record_id").alias("other"), "record_type", F.struct("record_id", "warc_date", "fields", "payload").alias("record"))
    parts = links.join(told, "other").groupBy("main").agg(*[F.array_sort(F.collect_list(F.when(F.col("record_type") == kind, F.struct(F.col("record.record_id").alias("record_id"), F.to_json("record.fields").alias("fields"), F.col("record.payload").alias("payload"))))).alias(name) for kind, name in (("request", "requests"), ("metadata", "metadata"))])
    rows = main.join(parts.withColumnRenamed("main", "record_id"), "record_id", "left")
    return rows.withColumns({name: F.coalesce(F.col(name), F.array()) for name in ("requests", "metadata")})


def resolved(caps: DataFrame, key: Column, name: str) -> DataFrame:
    """``caps`` with a column ``name``: ``key`` of the capture that a revisit refers to, null for others and for dangling ones."""
    again = caps.where(F.col("refers_to").isNotNull()).select(F.col("refers_to").alias("record_id")).distinct()
    to = caps.where("record_type = 'response'").select("record_id", key.alias(name)).join(again, "record_id").select(F.col("record_id").alias("refers_to"), name)
    to = to.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return caps.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALT)).cast("int")).join(to, ["refers_to", "salt"], "left").drop("salt")


def page_captures(pages: DataFrame, least: int = LEAST_BYTES, compression: str = "gzip", payload: bool = True) -> DataFrame:
    """Archive every page, read the archives back: one nested row per capture, with ``page_id`` and, for revisits, the
    ``page_id`` of the response as ``refers_to_page``. ``payload``: carry the payloads of the main records, too."""
    scratch = Scratch(pages.sparkSession, "warc")
    path = f"{scratch.root}/archive"
    write_archive(pages, path, scratch, least, compression)
    scratch.drop("captures")
    records = read_records(pages.sparkSession, path)
    if not payload:
        records = records.withColumn("payload", F.when(~F.col("record_type").isin(*MAIN), F.col("payload")))
    caps = assemble(scratch.table("records", records))  # archives are parsed once
    page = F.get_json_object(F.get("metadata", F.lit(0))["fields"], "$.page_id").cast("long")
    caps = scratch.table("assembled", caps.withColumn("page_id", page))
    return resolved(caps, F.col("page_id"), "refers_to_page")


def op13_warc(spark, sf_dir: str) -> DataFrame:
    caps = page_captures(spark.read.parquet(f"{sf_dir}/pages.parquet"), payload=False)
    return caps.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"))


QUERIES = {"op13_warc": op13_warc}
SQL = {
    "op13_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, strlen(h) AS payload_bytes, upper(sha1(h)) AS x,
    row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST) AS nth, first_value(page_id) OVER (PARTITION BY h ORDER BY page_id NULLS LAST) AS first
  FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + CAST(
    (CAST('0x' || substr(x, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER)]), '') AS payload_digest,
  CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN first END AS refers_to
FROM d
"""
}
