"""WARC archives: write captures, read records back, assemble transactions."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.staging import new_path, stage

CRLF = "\r\n"
#: Captures in one archive file, so that a reader holds a few MB at a time.
CAPTURES_PER_FILE = 1000


def _digest(payload: Column) -> Column:
    return F.sha1(F.encode(payload, "UTF-8"))


def revisits(captures: DataFrame, least_bytes: int) -> DataFrame:
    """(capture_id, refers_to) of the captures whose payload an equal one with a larger id holds.

    Only ids and digests are shuffled; the largest id of a digest is a partial aggregate, so a digest that a
    third of all captures share costs one row per task.
    """
    digests = captures.select("capture_id", F.octet_length("payload").alias("n"), _digest(F.col("payload")).alias("digest")).where(F.col("n") >= least_bytes)
    kept = digests.groupBy("digest").agg(F.max("capture_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1")
    return digests.join(kept, "digest").where("capture_id <> refers_to").select("capture_id", "refers_to").distinct()


def _record(kind: str, headers: list[Column], block: Column) -> Column:
    lines = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}"), *headers]
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block)


def _id(kind: str, of: Column | None = None) -> Column:
    return F.concat(F.lit("<urn:capture:"), (F.col("capture_id") if of is None else of).cast("string"), F.lit(f":{kind}>"))


def write_warc(captures: DataFrame, path: str, least_bytes: int = 1000) -> None:
    """Write captures (capture_id, url, payload) as gzipped WARC 1.1 files with Spark's text writer.

    Each capture becomes a request, a response (or, where an equal payload of at least ``least_bytes`` has a
    larger id, a revisit without payload) and a metadata record; the request and metadata name the response in
    WARC-Concurrent-To.  Null payloads are empty, null urls ``urn:unknown``; line ends in urls are escaped.
    Ids must identify captures: rows with a repeated id are one capture when read back.
    """
    rows = captures.select("capture_id", F.coalesce("url", F.lit("urn:unknown")).alias("url"), F.coalesce("payload", F.lit("")).alias("payload")).where("capture_id IS NOT NULL")
    rows = rows.join(revisits(rows, least_bytes).hint("shuffle_hash"), "capture_id", "left")
    url = F.regexp_replace("url", r"[\r\n]", "%0A")
    head = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    main = F.when(F.col("refers_to").isNull(), _id("response")).otherwise(_id("revisit"))
    own = [head("WARC-Target-URI", url), head("WARC-Date", F.lit("2024-01-01T00:00:00Z"))]
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF * 2))
    sha = head("WARC-Payload-Digest", F.concat(F.lit("sha1:"), _digest(F.col("payload"))))
    host = F.coalesce(F.nullif(F.regexp_extract(url, r"^[a-z]+://([^/?#\s]+)", 1), F.lit("")), F.lit("unknown"))
    request = _record("request", [head("WARC-Record-ID", _id("request")), head("WARC-Concurrent-To", main), *own], F.concat(F.lit("GET "), url, F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2)))
    response = _record("response", [head("WARC-Record-ID", main), *own, sha], F.concat(http, F.col("payload")))
    revisit = _record("revisit", [head("WARC-Record-ID", main), *own, sha, head("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), head("WARC-Refers-To", _id("response", F.col("refers_to")))], http)
    metadata = _record("metadata", [head("WARC-Record-ID", _id("metadata")), head("WARC-Concurrent-To", main), *own], F.concat(F.lit("capture-id: "), F.col("capture_id").cast("string"), F.lit(CRLF)))
    text = F.concat_ws(CRLF * 2, request, F.when(F.col("refers_to").isNull(), response).otherwise(revisit), metadata)
    rows.select(text.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", CAPTURES_PER_FILE).text(path)


RECORD = "record_id string, record_type string, concurrent_to array<string>, refers_to string, target_uri string, payload_digest string, payload_bytes long, payload_sha1 string, payload binary"


def _inflate(raw: bytes) -> bytes:
    out, data = [], raw
    while data[:2] == b"\x1f\x8b":  # one member or many
        z = zlib.decompressobj(31)
        out.append(z.decompress(data) + z.flush())
        data = z.unused_data
    return b"".join(out) if out else raw


def _parse(raw: bytes) -> Iterator[tuple]:
    """Records of one file, found by their Content-Length and never by searching for marks in payloads."""
    at = 0
    while (at := raw.find(b"WARC/", at)) >= 0:
        end = raw.index(b"\r\n\r\n", at)
        heads: dict[str, list[str]] = {}
        for line in raw[at:end].split(b"\r\n")[1:]:
            k, _, v = line.decode("utf-8", "replace").partition(":")
            heads.setdefault(k.strip().lower(), []).append(v.strip())
        size = int(heads["content-length"][0])
        block = raw[end + 4 : end + 4 + size]
        at = end + 4 + size
        one = lambda k, h=heads: h.get(k, [None])[0]
        kind = one("warc-type")
        payload = block.partition(b"\r\n\r\n")[2] if kind in ("response", "revisit", "request") else block
        yield one("warc-record-id"), kind, heads.get("warc-concurrent-to", []), one("warc-refers-to"), one("warc-target-uri"), (one("warc-payload-digest") or "").removeprefix("sha1:") or None, payload


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the WARC files under ``path``, gzipped or not, one row each.

    ``payload=False`` leaves the bytes out once their length and SHA-1 are taken, so that joins move headers
    only.  Memory is bounded by one file.
    """

    def records(batches):
        for batch in batches:
            for raw in batch.column(0):
                rows = [(i, kind, to, ref, uri, digest, len(body), hashlib.sha1(body).hexdigest(), body if payload else None) for i, kind, to, ref, uri, digest, body in _parse(_inflate(raw.as_py()))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()))],
                    names=["record_id", "record_type", "concurrent_to", "refers_to", "target_uri", "payload_digest", "payload_bytes", "payload_sha1", "payload"],
                )

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(records, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit with the requests and metadata concurrent to it.

    A record belongs to the capture that its WARC-Concurrent-To names, that names it, or that a record it names
    belongs to; records whose identifiers lead to no response or revisit are left out.  Rows repeated exactly
    count once.  Records of one capture meet by shuffling on its identifier.
    """
    main = F.col("record_type").isin("response", "revisit")
    body = F.struct("record_id", "record_type", "refers_to", "target_uri", "payload_digest", "payload_bytes", "payload_sha1", "payload")
    links = records.select("record_id", F.explode("concurrent_to").alias("other"), main.alias("is_main"))
    forward = links.where("NOT is_main").select(F.col("record_id").alias("member"), F.col("other").alias("capture"))
    backward = links.where("is_main").select(F.col("other").alias("member"), F.col("record_id").alias("capture"))
    direct = forward.unionByName(backward)
    second = direct.alias("a").join(direct.alias("b"), F.col("a.capture") == F.col("b.member")).select(F.col("a.member"), F.col("b.capture"))
    known = direct.unionByName(second)
    keyed = records.where(main).select(F.col("record_id").alias("capture"), body.alias("r")).unionByName(
        records.where(~main).select(F.col("record_id").alias("member"), body.alias("r")).join(known, "member").select("capture", "r")
    )
    is_main = F.col("r.record_type").isin("response", "revisit")
    return (
        keyed.groupBy("capture")
        .agg(
            F.first(F.when(is_main, F.col("r")), ignorenulls=True).alias("response"),
            F.collect_set(F.when(F.col("r.record_type") == "request", F.col("r"))).alias("requests"),
            F.collect_set(F.when(F.col("r.record_type") == "metadata", F.col("r"))).alias("metadata"),
        )
        .where("response IS NOT NULL")
    )


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip of ``pages`` through archives: what each page's record holds or refers to."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("capture_id"), "url", F.col("html").alias("payload"))
    path = new_path(spark, "warc")
    write_warc(pages, path)
    records = stage(read_warc(spark, path, payload=False), "records")
    captures = assemble(records).select("response.*", "requests", "metadata")
    number = lambda c: F.regexp_extract(c, r"^<urn:capture:(-?\d+):", 1).cast("long")
    rows = stage(captures.select(number("record_id").alias("page_id"), "record_type", number("refers_to").alias("refers_to"), "payload_bytes", F.coalesce("payload_digest", "payload_sha1").alias("payload_digest"), "payload_sha1", F.size("requests").alias("n_requests"), F.size("metadata").alias("n_metadata")), "captures")
    full = rows.where("record_type = 'response'")
    back = rows.where("record_type = 'revisit'").drop("payload_bytes").join(full.select(F.col("page_id").alias("refers_to"), "payload_bytes"), "refers_to")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return full.select("page_id", "payload_bytes", F.col("payload_sha1").alias("payload_digest"), "record_type", "refers_to").unionByName(back.select(*cols))


OP1_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS keep FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN keep IS NULL OR keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keep <> page_id THEN keep END AS refers_to
FROM p LEFT JOIN k ON p.payload_digest = k.payload_digest
"""
