"""WARC archives: captures written as request, response or revisit, and metadata records; read back and joined.

Writing stays in the JVM: a record is one string, and Spark's text writer with the line separator
CR LF adds the second of the two line ends that close a record. A payload that many pages share is
gathered once, by an aggregation that combines before it shuffles; revisits are narrow rows. Reading
unpacks archives as a stream and walks them by Content-Length. Each capture's request and metadata
records name its response or revisit record in WARC-Concurrent-To; the transaction is assembled by
joins on that identifier.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costloom.llm.common import durable, frugal

#: The digits of RFC 4648 base32, in order (fixed values).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 SHA-1 of a string's UTF-8 bytes, in built-in functions."""
    hexed = F.sha1(payload.cast("binary"))
    five = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * g, 5), 16, 32), 4, "0") for g in range(8)]
    return F.translate(F.concat(*five), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def record_id(*parts: Column) -> Column:
    """A urn:uuid identifier that is a function of its parts."""
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x1e")) for p in parts]).cast("binary"))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


def record(kind: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its last CR LF. Headers whose value is null are left out."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block, F.lit(CRLF))


def write_captures(pages: DataFrame, path: str, min_revisit_bytes: int = 0, file_bytes: int = 64_000_000, salts: int = 64) -> None:
    """Write gzip archives under ``path`` for ``pages`` (page_id, url, html).

    Of captures with equal payloads of at least ``min_revisit_bytes`` bytes one with the largest
    page_id is the response, the others revisit it. A null html is an empty payload; a null url leaves
    out the target; null page_ids sort lowest. Other columns are ignored. Rows equal in page_id, url
    and html are numbered and stay captures of their own. An empty table writes no record. Files hold
    about ``file_bytes`` of payloads.
    """
    rows = pages.select("page_id", F.regexp_replace("url", "[\\r\\n]", "").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", sha1_base32(F.col("html"))).withColumn("n", F.octet_length("html"))
    small = F.col("n") < min_revisit_bytes
    # narrow rows: how often each capture repeats, in up to `salts` parts so that repeated rows are no hot key
    parted = rows.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    seen = parted.groupBy("page_id", "url", "digest", "n", "part").agg(F.count(F.lit(1)).alias("times"))
    seen = durable(seen, "warc-captures")
    keep = F.struct("page_id", "url", "part")
    chosen = seen.where(~small).groupBy("digest").agg(F.max(keep).alias("first"), F.max("n").alias("n"))
    again = seen.join(chosen.select("digest", "first"), "digest", "left").withColumn("is_first", F.coalesce(keep.eqNullSafe(F.col("first")), F.lit(False)))
    # the first of its repeats is the response, and is written with the payload
    again = again.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).where(~(F.col("is_first") & (F.col("copy") == 1)))
    payloads = rows.where(~small).groupBy("digest").agg(F.first("html").alias("html"))
    full = payloads.join(chosen, "digest").select("first.page_id", "first.url", "first.part", "digest", "n", F.lit(1).cast("long").alias("copy"), "html", F.lit(None).cast(again.schema["first"].dataType).alias("first"))
    empty = F.lit(None).cast("string").alias("html")
    revisits = again.where(~small).select("page_id", "url", "part", "digest", "n", "copy", empty, "first")
    parts = [full, revisits]
    if min_revisit_bytes:
        texts = rows.where(small).groupBy("digest").agg(F.first("html").alias("html"))
        parts.append(again.where(small).select("page_id", "url", "part", "digest", "n", "copy", "first").join(texts, "digest").select(*full.columns))
    size = seen.agg(F.sum("n"), F.sum("times")).first()
    per_file = max(1, min(20_000, int(file_bytes * (size[1] or 1) / max(1, size[0] or 0))))
    for part in parts:
        write_records(part, path, per_file)


def write_records(rows: DataFrame, path: str, captures_per_file: int) -> None:
    """The three records of every row (page_id, url, part, digest, n, copy, html, first); a null html is a revisit of ``first``."""
    own = record_id(F.lit("capture"), *[F.col(c) for c in ("page_id", "url", "digest", "part", "copy")])
    refers = record_id(F.lit("capture"), F.col("first.page_id"), F.col("first.url"), F.col("digest"), F.col("first.part"), F.lit(1).cast("long"))
    common = [("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", F.col("url"))]
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF + CRLF))
    hashed = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    http = ("Content-Type", F.lit("application/http; msgtype=response"))
    full = record("response", [("WARC-Record-ID", own), *common, hashed, http], F.concat(head, F.col("html")))
    profile = ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    again = record("revisit", [("WARC-Record-ID", own), *common, hashed, ("WARC-Refers-To", refers), ("WARC-Refers-To-Target-URI", F.col("first.url")), profile, http], head)
    get = F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{CRLF}{CRLF}"))
    ask = record("request", [("WARC-Record-ID", record_id(F.lit("request"), own)), *common, ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http; msgtype=request"))], get)
    fields = F.concat_ws(CRLF, F.concat(F.lit("pageId: "), F.col("page_id").cast("string")), F.concat(F.lit("payloadBytes: "), F.col("n").cast("string")), F.lit(""))
    about = record("metadata", [("WARC-Record-ID", record_id(F.lit("metadata"), own)), *common, ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))], fields)
    lines = rows.select(F.explode(F.array(ask, F.when(F.col("html").isNotNull(), full).otherwise(again), about)).alias("value"))
    lines.write.mode("append").option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", 3 * captures_per_file).text(path)


def unpacked(data: bytes, step: int = 1 << 20):
    """The contents of all members of a gzip file, a piece at a time."""
    view = memoryview(data)
    member, at = zlib.decompressobj(31), 0
    while at < len(view) or member.unconsumed_tail:
        given = member.unconsumed_tail
        if not given:
            given, at = view[at : at + step], at + step
        yield member.decompress(given, step)
        while member.eof:
            rest = member.unused_data
            member = zlib.decompressobj(31)
            if not rest:
                break
            yield member.decompress(rest, step)


def parse(pieces):
    """(headers, block) of each record of an uncompressed archive, given in pieces; one record is held at a time."""
    held, at, pieces = bytearray(), 0, iter(pieces)

    def fill(n: int) -> bool:
        nonlocal at
        while len(held) - at < n:
            more = next(pieces, None)
            if more is None:
                return False
            del held[:at]
            at = 0
            held.extend(more)
        return True

    while fill(1):
        if not fill(5) or held[at : at + 5] != b"WARC/":
            raise ValueError("no record where one should begin")
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not fill(len(held) - at + 1):
                raise ValueError("a record's head is cut off")
        headers = {}
        for line in bytes(held[at:end]).split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        head, size = end + 4 - at, int(headers["content-length"])
        if not fill(head + size):
            raise ValueError("a record's block is cut off")
        yield headers, bytes(held[at + head : at + head + size])
        fill(head + size + 4)
        at += head + size + 4


TEXTS = ["kind", "record_id", "concurrent_to", "target_uri", "date", "refers_to", "declared_digest"]
RECORD = ", ".join(f"{c} string" for c in TEXTS) + ", payload_bytes long, payload_digest string, fields map<string,string>, payload binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``.

    The payload of a response or request is what follows the HTTP head; its digest is computed from
    the archived bytes. A file's compressed bytes and one record are in memory at a time.
    """

    arrow = pa.schema([*((c, pa.string()) for c in TEXTS), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])

    def rows(batches):
        for batch in batches:
            for content in batch.column(0):
                out = []
                size = 0
                for headers, block in parse(unpacked(content.as_py())):
                    payload = block.partition(b"\r\n\r\n")[2] if "http" in headers.get("content-type", "") else block
                    fields = dict(line.split(": ", 1) for line in block.decode("utf-8", "replace").split("\r\n") if ": " in line) if headers["warc-type"] == "metadata" else {}
                    out.append({
                        "kind": headers["warc-type"], "record_id": headers["warc-record-id"], "concurrent_to": headers.get("warc-concurrent-to"),
                        "target_uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"), "refers_to": headers.get("warc-refers-to"),
                        "declared_digest": (headers.get("warc-payload-digest") or "").removeprefix("sha1:") or None, "payload_bytes": len(payload),
                        "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode(), "fields": list(fields.items()), "payload": payload,
                    })
                    size += len(payload)
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(out, arrow)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(frugal(rows), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``response`` (or revisit), ``request`` and ``metadata`` structs.

    Requests and metadata are joined to the record that their WARC-Concurrent-To names. A response
    without a request or metadata record keeps a null struct; orphans are left out.
    """
    stored = durable(records, "warc-records", compression="zstd")
    held = F.struct(*[F.col(c) for c in stored.columns])
    main = stored.where(F.col("kind").isin("response", "revisit")).dropDuplicates(["record_id"]).select(F.col("record_id").alias("capture"), held.alias("response"))
    asks = stored.where(F.col("kind") == "request").dropDuplicates(["concurrent_to"]).select(F.col("concurrent_to").alias("capture"), held.alias("request"))
    about = stored.where(F.col("kind") == "metadata").dropDuplicates(["concurrent_to"]).select(F.col("concurrent_to").alias("capture"), held.alias("metadata"))
    return main.join(asks, "capture", "left").join(about, "capture", "left")
