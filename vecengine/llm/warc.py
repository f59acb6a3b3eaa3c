"""WARC archives: writing, reading and assembly of transactions (op 3).

Each capture is written as three records, each a gzip member of its own: request, response (or revisit, where another
capture has the same payload) and metadata. Request and metadata name the response in WARC-Concurrent-To. The reader makes
one row per record; assembly joins requests and metadata to their responses through concurrent-to identifiers, in either
direction and over one record between, and emits one nested row per capture.

Of the captures of a payload, that with the largest page_id is the response. Payloads are told apart by SHA-1 and length. The
largest ids are aggregated from (digest, id) pairs alone; html moves once, by page_id. A payload that a third of all
captures share is joined over salted keys.

Files are written under a name of their own attempt and moved into place whole.

Defined results: null html is an empty payload; a null page_id is less than any other and is null again in the result; rows that
repeat the largest page_id of their payload are responses all; null url is an empty target; an empty table makes no archive and
gives no rows; other columns are ignored. Of records that name no known response, an assembly has none: they are left out, and
``read_records`` shows them.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecengine.llm import common

SALTS = 16
#: Input bytes of one archive; compressed bytes read at once.
ARCHIVE_BYTES, READ_BYTES = 32 << 20, 1 << 16
RECORDS = "record_id string, record_type string, concurrent_to array<string>, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, page_id long, file string, offset long, length long, payload binary"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space of URLs in RFC 4122
#: Fixed date of synthetic captures, so that repeated tasks write the same bytes.
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(kind: str, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind}:{key}')}>"


def record(kind: str, rid: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines if v) + "\r\n"
    squeeze = zlib.compressobj(3, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode() + block + b"\r\n\r\n") + squeeze.flush()


def one_line(text: str) -> str:
    return "".join(c if c > " " else "%20" if c == " " else "" for c in text)


def capture(page_id: int | None, url: str, payload: bytes, first_key: str | None, row_key: str) -> bytes:
    """The three records of a capture."""
    digest, target = digest_of(payload), one_line(url)
    own = record_id("response", row_key)
    shared = [("WARC-Target-URI", target)]
    facts = [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload))), ("X-Page-Id", "" if page_id is None else str(page_id))]
    request = record("request", record_id("request", row_key), [*shared, ("WARC-Concurrent-To", own), ("Content-Type", "application/http; msgtype=request")], f"GET {target or '/'} HTTP/1.1\r\n\r\n".encode())
    if first_key is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        answer = record("revisit", own, [*shared, *facts, ("WARC-Profile", profile), ("WARC-Refers-To", record_id("response", first_key)), ("Content-Type", "application/http; msgtype=response")], HTTP)
    else:
        answer = record("response", own, [*shared, *facts, ("Content-Type", "application/http; msgtype=response")], HTTP + payload)
    metadata = record("metadata", record_id("metadata", row_key), [*shared, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")], f"payload-length: {len(payload)}\r\n".encode())
    return request + answer + metadata


def key_of(page_id: int | None, url: str | None, digest: str) -> str:
    return f"{page_id}:{digest}:{url}"


def with_first(pages: DataFrame, parts: int) -> DataFrame:
    """pages (page_id, url, html) with first: page_id and url of the payload's response; null for responses. Repeated rows lie in one partition."""
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    keys = pages.select("page_id", "url", "digest", F.octet_length("html").alias("size")).distinct()
    first = keys.groupBy("digest", "size").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1")
    # The rows of one payload may be a third of all: they meet its largest id in SALTS places.
    salted = first.select("digest", "size", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    revisits = keys.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "size", "salt"])
    # One key without nulls: html moves to its partition once, and the join needs no other.
    key = F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "digest", F.coalesce(F.concat(F.lit("="), "url"), F.lit("-")))
    revisits = revisits.where(~F.col("page_id").eqNullSafe(F.col("first.page_id"))).select(key.alias("key"), "first")
    return pages.withColumn("key", key).repartition(parts, "key").join(revisits, "key", "left").select("page_id", "url", "html", "first")


def write_archives(pages: DataFrame, folder: str) -> list[str]:
    """Write pages (page_id, url, html) as archives in folder; return their paths."""
    common.ship(pages.sparkSession)
    n = common.parts_for(pages, ARCHIVE_BYTES)
    ready = with_first(pages, n)

    def write(batches):
        fs, root = common.filesystem(folder)
        fs.create_dir(root, recursive=True)
        name = hashlib.sha1()
        rows, path = 0, f"{root}/{uuid.uuid4().hex}.tmp"
        with fs.open_output_stream(path, compression=None, buffer_size=1 << 20) as out:
            seen: dict[str, int] = {}
            for batch in common.slices(batches):
                for r in batch.to_pylist():
                    payload = (r["html"] or "").encode()
                    digest, first = digest_of(payload), r["first"]
                    key = key_of(r["page_id"], r["url"], digest)
                    number = seen[key] = seen.get(key, -1) + 1  # repeated rows lie in one task
                    data = capture(r["page_id"], r["url"] or "", payload, first and key_of(first["page_id"], first["url"], digest), f"{key}:{number}" if number else key)
                    name.update(data[-8:])
                    out.write(data)
                    rows += 1
        if not rows:
            fs.delete_file(path)
            return
        final = f"{root}/capture-{name.hexdigest()}.warc.gz"
        fs.move(path, final)
        yield pa.RecordBatch.from_pydict({"file": [final.rsplit("/", 1)[1]], "rows": [rows]}, schema=common.schema_of("file string, rows long"))

    return [f"{folder.rstrip('/')}/{r['file']}" for r in ready.mapInArrow(write, "file string, rows long").collect()]  # one row per archive


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """The gzip members of a stream, one at a time: first byte, bytes in the file, content."""
    engine, parts, rest, start, fed = zlib.decompressobj(31), [], b"", 0, 0
    while True:
        data = rest or stream.read(READ_BYTES)
        if not data:
            return
        parts.append(engine.decompress(data))
        rest, fed = b"", fed + len(data)
        if engine.eof:
            rest = engine.unused_data
            fed -= len(rest)
            yield start, fed - start, b"".join(parts)
            engine, parts, start = zlib.decompressobj(31), [], fed


def parse(member: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers, by lower-cased name, and block of a record."""
    head, _, rest = member.partition(b"\r\n\r\n")
    headers = [(k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])]
    return headers, rest[: int(dict(headers)["content-length"])]


def payload_at(file: str, offset: int, length: int) -> bytes:
    """The payload of the response at that place, from these bytes of the file alone."""
    fs, path = common.filesystem(file)
    with fs.open_input_file(path) as f:
        return parse(zlib.decompress(f.read_at(length, offset), 31))[1].partition(b"\r\n\r\n")[2]


def read_records(spark: SparkSession, files: list[str], with_payload: bool = True) -> DataFrame:
    """One row per record, with its place in the archives. Payload length and digest are those of what a response holds, and those that a revisit states.

    Without payloads a row still has their place: ``payload_at`` reads one by file, offset and length.
    """
    common.ship(spark)
    names = spark.createDataFrame([(f,) for f in sorted(files)], "file string")
    if files:
        names = names.repartitionByRange(min(len(files), common.MOST_PARTS), "file")

    def read(batches):
        schema = common.schema_of(RECORDS)
        for batch in batches:
            for file in batch.column("file").to_pylist():
                fs, path = common.filesystem(file)
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
                    for offset, length, member in members(stream):
                        headers, block = parse(member)
                        one = dict(headers)
                        payload, digest, size_of = None, None, None
                        if one["warc-type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            digest, size_of = digest_of(payload), len(payload)
                            if one.get("warc-payload-digest", f"sha1:{digest}") != f"sha1:{digest}":
                                raise ValueError(f"{one['warc-record-id']}: its payload doesn't have the stated digest")
                        elif one["warc-type"] == "revisit":
                            digest, size_of = one["warc-payload-digest"].removeprefix("sha1:"), int(one["x-payload-length"])
                        page = one.get("x-page-id")
                        rows.append((one["warc-record-id"], one["warc-type"], [v for k, v in headers if k == "warc-concurrent-to"], one.get("warc-target-uri"), one.get("warc-date"), one.get("warc-refers-to"), digest, size_of, int(page) if page else None, file, offset, length, payload if with_payload else None))
                        size += len(member)
                        if len(rows) >= 1024 or size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return names.mapInArrow(read, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: response (or revisit), with its payload if records have them and its place in the archives anyway, requests and metadata, joined through concurrent-to identifiers."""
    answers = records.where(F.col("record_type").isin("response", "revisit"))
    others = records.where(F.col("record_type").isin("request", "metadata"))
    named = others.select("record_id", F.explode("concurrent_to").alias("to"))
    by_answer = answers.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("to"))
    links = named.unionByName(by_answer)  # repeated ones go below
    ids = answers.select(F.col("record_id").alias("to"), F.col("record_id").alias("capture"))
    direct = links.join(ids, "to").select("record_id", "capture")
    # A record may name another of its capture instead of the response.
    between = links.join(ids, "to", "left_anti").join(direct.select(F.col("record_id").alias("to"), "capture"), "to").select("record_id", "capture")
    of = direct.unionByName(between).repartition("record_id").distinct()  # dealt out once, for this and the join
    part = F.struct(*[c for c in records.columns if c != "payload"])
    joined = others.join(of, "record_id").select("capture", "record_type", part.alias("part"))
    grouped = joined.groupBy("capture").agg(
        F.array_sort(F.collect_list(F.when(F.col("record_type") == "request", F.col("part")))).alias("requests"),
        F.array_sort(F.collect_list(F.when(F.col("record_type") == "metadata", F.col("part")))).alias("metadata"),
    )
    answer = answers.select(F.col("record_id").alias("capture"), F.struct(*records.columns).alias("response"))
    return answer.join(grouped, "capture", "left")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.shared_path(spark, "warc")
    files = write_archives(common.table(spark, sf_dir, "pages"), folder)
    records = read_records(spark, files, with_payload=False)
    captures = common.written(assemble(common.written(records, "records")), "captures")
    r = F.col("response")
    flat = captures.select(r["page_id"].alias("page_id"), r["payload_bytes"].alias("payload_bytes"), r["payload_digest"].alias("payload_digest"), r["record_type"].alias("record_type"), r["record_id"].alias("record_id"), r["refers_to"].alias("to"), (F.size("requests") + F.size("metadata")).alias("n_concurrent"))
    # What a revisit refers to, over salted keys: a third of all captures may refer to one.
    targets = flat.where("record_type = 'response'").join(flat.where("to IS NOT NULL").select(F.col("to").alias("record_id")).distinct(), "record_id", "left_semi")
    salted = targets.select(F.col("record_id").alias("to"), F.col("page_id").alias("refers_to"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = flat.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int")).join(salted, ["to", "salt"], "left")
    return met.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "n_concurrent")


#: SHA-1 in base 32: five hexadecimal digits are four of its digits.
SQL = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
t AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) // CAST(32 ** (3 - i % 4) AS BIGINT)) % 32 + 1 AS INTEGER), 1)), '') AS payload_digest FROM d),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM t)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, CAST(2 AS INTEGER) AS n_concurrent FROM f
"""
