"""WARC archives written and read back as Spark jobs, with reassembly of segmented records.

Writing: every page is an HTTP response with chunked transfer framing. A block longer than `segment_bytes` is
cut into a first record and ``continuation`` records (WARC-Segment-Number, WARC-Segment-Origin-ID, and
WARC-Segment-Total-Length on the last). Of pages with equal payloads the one with the smallest id is written
in full, the others are ``revisit`` records without a payload. The text sink with the blank lines of the
format as line separator writes exactly the bytes of an archive, one gzip file per task, on any file system.

Reading: gzip files are read by one task each, record by record; Content-Length decides where a record ends,
so a payload may hold anything. Continuation records are grouped by the identifier of their origin, ordered by
segment number, and must be complete and add up to the total length; then the chunks are decoded and the
payload's SHA-1 is compared with the one in the header. Only segmented records are shuffled.

Defined results: null html counts as empty. A null page id is larger than all others. Rows that repeat page id and payload are
written each; if they are the smallest of their payload, all of them are responses. A missing segment, a wrong
total, a broken chunk or a wrong digest gives status ``incomplete``, ``length``, ``framing`` or ``digest``
instead of ``ok``, with a null payload where it is unknown. A record that its file ends in (an archive cut off) is kept with what came and
its number of missing bytes, and is ``incomplete``; the next file of the task starts anew. An empty table gives an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.session import ensure_checkpoint_dir

from .registry import query

VERSION, GAP = "WARC/1.1\r\n", "\r\n\r\n"
SEGMENT_BYTES = 32_768
CHUNK_BYTES = 8_192
DATE = "2024-01-01T00:00:00Z"
RECORD = "page_id long, type string, record_id string, target string, refers_to string, digest string, segment int, origin string, total long, block binary, missing long"
MESSAGE = "status string, payload binary, payload_bytes long, payload_digest string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def frame_chunks(body: bytes, size: int) -> bytes:
    """Chunked transfer framing of a body."""
    parts = [b"%x\r\n%s\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def decode_chunks(framed: bytes) -> bytes | None:
    """The body within chunked framing; chunk extensions and trailers are skipped, None if it is broken."""
    at, parts = 0, []
    while True:
        line = framed.find(b"\r\n", at)
        if line < 0:
            return None
        try:
            size = int(framed[at:line].split(b";")[0], 16)
        except ValueError:
            return None
        if size < 0:
            return None
        if size == 0:
            return b"".join(parts) if framed.find(b"\r\n", line + 2) >= 0 else None
        at = line + 2 + size
        if framed[at : at + 2] != b"\r\n":
            return None
        parts.append(framed[line + 2 : at])
        at += 2


def _header(fields: list[tuple[str, object]]) -> bytes:
    return (VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)).encode() + b"\r\n"


def record_name(page_id: int | None, digest: str) -> str:
    """Record identifier from page id and payload digest: the same on every attempt."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def page_records(page_id: int | None, url: str | None, digest: str, body: bytes, first: bool, first_id: int | None, segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    """The records of one page, each without the blank lines behind it."""
    name, target = record_name(page_id, digest), "".join((url or "").split()) or None
    common: list[tuple[str, object]] = [("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if not first:
        return [_header([("WARC-Type", "revisit"), ("WARC-Record-ID", name), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                         ("WARC-Refers-To", record_name(first_id, digest)), *common, ("Content-Length", len(head))]) + head]
    block = head + frame_chunks(body, chunk_bytes)
    if len(block) <= segment_bytes:
        return [_header([("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("Content-Length", len(block))]) + block]
    pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [_header([("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("WARC-Segment-Number", 1), ("Content-Length", len(pieces[0]))]) + pieces[0]]
    for k, piece in enumerate(pieces[1:], 2):
        total = len(block) if k == len(pieces) else None
        out.append(_header([("WARC-Type", "continuation"), ("WARC-Record-ID", record_name(k, name)), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k),
                            ("WARC-Segment-Total-Length", total), ("Content-Length", len(piece))]) + piece)
    return out


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0,
                  segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write the pages as gzip WARC files below `folder`, a shared one; equal payloads of `min_revisit_bytes` or more are written once."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("body"))
    rows = rows.withColumn("sha1", F.sha1("body"))
    repeated = rows.where(F.length("body") >= min_revisit_bytes).groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").select("sha1", "first_id")
    rows = rows.join(repeated, "sha1", "left").withColumn("first", F.col("first_id").isNull() | F.col("page_id").eqNullSafe(F.col("first_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            held = 0
            for page_id, url, sha1, body, first, first_id in zip(*(batch.column(c) for c in ("page_id", "url", "sha1", "body", "first", "first_id")), strict=True):
                digest = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                records = page_records(page_id.as_py(), url.as_py(), digest, body.as_py(), first.as_py(), first_id.as_py(), segment_bytes, chunk_bytes)
                out += records
                held += sum(map(len, records))
                if held > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    lines = rows.select("page_id", "url", "sha1", "body", "first", "first_id").mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", GAP).option("compression", "gzip").text(folder)


def _parse(raw: bytes) -> dict:
    """Header fields and block of one record, which starts behind the version line."""
    head, gap, block = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        key, _, value = line.partition(":")
        fields[key.strip().lower()] = value.strip()
    number = lambda k: int(fields[k]) if fields.get(k, "").isdigit() else None
    length = number("content-length") or 0
    missing = length - len(block) if gap else max(length, 1)  # without a gap even the header is cut off
    page = fields.get("warc-page-id")
    return {
        "page_id": int(page) if page and page.lstrip("-").isdigit() else None, "type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "target": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to"), "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, "segment": number("warc-segment-number"),
        "origin": fields.get("warc-segment-origin-id"), "total": number("warc-segment-total-length"), "block": block[:length], "missing": max(missing, 0),
    }


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the gzip archives below `folder`: header fields, block, and how many of its bytes the file lacks."""
    separator = GAP + VERSION
    lines = spark.read.option("lineSep", separator).text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("raw"))
    fields = [("page_id", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("target", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()),
              ("segment", pa.int32()), ("origin", pa.string()), ("total", pa.int64()), ("block", pa.binary()), ("missing", pa.int64())]

    def rows(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
        """File and content row by row; paths that repeat are read once."""
        files = batch.column("file").dictionary_encode()
        names = files.dictionary.to_pylist()
        for k, raw in zip(files.indices.to_pylist(), batch.column("raw"), strict=True):
            yield names[k], raw.as_py()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, pieces, missing, last = [], 0, [], 0, None
        table = lambda: pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in fields], [n for n, _ in fields])
        for batch in batches:
            for file, raw in rows(batch):
                if file != last and pieces:  # the file before ended inside a record
                    out.append(_parse(separator.encode().join(pieces)))
                    pieces = []
                last = file
                if pieces:  # the separator stood inside a payload
                    pieces.append(raw)
                    missing -= len(separator) + len(raw)
                    if missing > 0:
                        continue
                    raw, pieces = separator.encode().join(pieces), []
                elif raw.startswith(VERSION.encode()):  # the first of a file
                    raw = raw[len(VERSION) :]
                if not raw:
                    continue
                record = _parse(raw)
                if record["missing"]:
                    pieces, missing = [raw], record["missing"]
                    continue
                out.append(record)
                held += len(record["block"])
                if held > 1 << 22:
                    yield table()
                    out, held = [], 0
        if pieces:
            out.append(_parse(separator.encode().join(pieces)))
        if out:
            yield table()

    return lines.mapInArrow(run, RECORD)


def _message_reader():
    @F.pandas_udf(MESSAGE)
    def read(block, digest):  # noqa: ANN001
        import pandas as pd

        def one(data: bytes | None, want: str | None) -> tuple:
            if data is None:
                return "incomplete", None, None, None
            head, gap, body = bytes(data).partition(b"\r\n\r\n")
            if b"transfer-encoding: chunked" in head.lower():
                body = decode_chunks(body)
            if not gap or body is None:
                return "framing", None, None, None
            got = base32_sha1(body)
            return "ok" if want is None or want == got else "digest", body, len(body), got

        return pd.DataFrame([one(b, d) for b, d in zip(block, digest, strict=True)], columns=["status", "payload", "payload_bytes", "payload_digest"])

    return read


def reassemble(records: DataFrame) -> DataFrame:
    """Responses with their whole messages: continuation records joined to their origin, lengths verified, framing decoded.

    Columns: page_id, record_id, target, n_segments, status, payload, payload_bytes, payload_digest."""
    whole = records.where("(type = 'response' or type is null and missing > 0) and segment is null").select(
        "page_id", "record_id", "target", "digest", F.lit(1).alias("n_segments"), F.when(F.col("missing") > 0, "incomplete").alias("fault"), F.when(F.col("missing") == 0, F.col("block")).alias("block"))
    parts = records.where("segment is not null and type in ('response', 'continuation')").withColumn("key", F.coalesce("origin", "record_id"))
    groups = parts.groupBy("key").agg(
        F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("segments"), F.max("total").alias("total"), F.max("missing").alias("missing"),
        F.greatest(F.sum(F.when(F.col("segment") == 1, 1).otherwise(0)), F.lit(1)).cast("int").alias("copies"),
        *(F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("page_id", "target", "digest")))
    joined = groups.withColumn("joined", _concat(F.transform("segments", lambda s: s["block"])))
    n = F.size("segments")
    fault = F.when((F.get("segments", F.lit(0))["segment"] != 1) | (F.get("segments", n - 1)["segment"] != n) | F.col("total").isNull() | (F.col("missing") > 0), "incomplete").when(F.length("joined") != F.col("total"), "length")
    joined = joined.select("page_id", F.col("key").alias("record_id"), "target", "digest", n.alias("n_segments"), fault.alias("fault"), "joined", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy"))
    joined = joined.select("page_id", "record_id", "target", "digest", "n_segments", "fault", F.when(F.col("fault").isNull(), F.col("joined")).alias("block"))
    message = whole.unionByName(joined).withColumn("message", _message_reader()("block", "digest"))
    return message.select("page_id", "record_id", "target", "n_segments", F.coalesce("fault", "message.status").alias("status"), "message.payload", "message.payload_bytes", "message.payload_digest")


def _concat(blocks: Column) -> Column:
    """Concatenation of an array of binaries."""
    return F.reduce(blocks, F.lit(b""), lambda a, b: F.concat(a, b))


def resolve_revisits(records: DataFrame, responses: DataFrame) -> DataFrame:
    """Revisit records with length, digest and page id of the response they refer to."""
    found = responses.where("status = 'ok'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("response_id"), "payload_bytes", "payload_digest").distinct()
    return records.where("type = 'revisit'").select("page_id", "refers_to").join(found, "refers_to", "left")


@query("op9_warc_segments", """
WITH rows AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
firsts AS (SELECT hex, min(page_id) AS first_id FROM rows GROUP BY hex)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, (5 * i + 1)::INT, 5))::BIGINT >> s) & 31) + 1)::INT, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM rows JOIN firsts USING (hex)
""")
def op9_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc/{uuid.uuid4().hex}"
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    records = read_records(spark, folder)
    responses = reassemble(records)
    kinds = responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return kinds.unionByName(resolve_revisits(records, responses).select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("response_id").alias("refers_to")))
