"""Write pages as WARC archives, and read archives back as one nested row per capture.

A capture has a request, a response (or a revisit, if an equal payload is stored already) and a metadata record. The
latter point to the response through WARC-Concurrent-To (metadata may also point to the request), by which reading
joins them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import materialize

GAP = "\r\n\r\n"
MIN_BYTES = 100


def _record(kind: str, record_id: Column, date: Column, uri: Column, headers: list[Column], block: Column) -> Column:
    return F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), record_id, F.lit("\r\nWARC-Date: "), date, F.lit("\r\nWARC-Target-URI: "), uri,
        *headers, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(GAP), block,
    )


def write(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", per_file: int = 20_000) -> None:
    """Archive every row of pages(page_id, url, html) at path (gzip). Nulls: an empty payload, an empty URL, an empty id.

    Of rows with equal payloads of at least 100 bytes, those with the smallest page_id are responses and the others
    revisits of it; a null page_id counts as larger than any. Repeated rows are captures of their own. White space in URLs is
    percent-encoded. Other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    sized = rows.withColumns({"digest": F.sha2(F.col("html").cast("binary"), 256), "bytes": F.octet_length("html")})
    first = sized.filter(F.col("bytes") >= MIN_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("digest", "first")
    first = materialize(first, "first")  # its size is known then: the payloads are only shuffled if it is large
    told = sized.join(first, "digest", "left").withColumn("again", F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False)))
    uri = F.col("url")
    for code in (9, 10, 13, 32):
        uri = F.replace(uri, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    told = told.withColumns({"uri": uri, "row": F.concat_ws("-", F.col("page_id").cast("string"), F.monotonically_increasing_id().cast("string"))})
    name = lambda kind: F.concat(F.lit("<urn:md5:"), F.md5(F.concat(F.lit(f"{kind} "), F.col("row"))), F.lit(">"))
    told = told.withColumns({"rid": name("response"), "qid": name("request"), "mid": name("metadata")})
    head = lambda key, value: F.concat(F.lit(f"\r\n{key}: "), value)
    d, page = F.lit(date), head("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    digest = head("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    again = [page, digest, head("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), head("X-Refers-To-Page-ID", F.col("first").cast("string"))]
    main = F.when(F.col("again"), _record("revisit", F.col("rid"), d, F.col("uri"), again, F.lit(""))).otherwise(_record("response", F.col("rid"), d, F.col("uri"), [page, digest, head("Content-Type", F.lit("text/html; charset=utf-8"))], F.col("html")))
    to = lambda c: head("WARC-Concurrent-To", F.col(c))
    request = _record("request", F.col("qid"), d, F.col("uri"), [to("rid")], F.concat(F.lit("GET "), F.col("uri"), F.lit(" HTTP/1.1")))
    metadata = _record("metadata", F.col("mid"), d, F.col("uri"), [to("qid")], F.concat(F.lit("payload-bytes: "), F.col("bytes").cast("string")))
    out = told.select(F.explode(F.array(request, main, metadata)).alias("value"))
    out.write.option("lineSep", GAP).option("compression", "gzip").option("maxRecordsPerFile", 3 * per_file).text(path)


def _parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive, gzip (one or many members) or plain; a truncated last record is an error."""
    if raw[:2] == b"\x1f\x8b":
        whole = []
        while raw:
            one = zlib.decompressobj(31)
            whole.append(one.decompress(raw))
            raw = one.unused_data
        raw = b"".join(whole)
    at = 0
    while at < len(raw):
        if raw[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        start, size = end + 4, int(headers["content-length"])
        if start + size > len(raw):
            raise ValueError(f"record at byte {at} is cut off")
        yield headers, raw[start : start + size]
        at = start + size + 4


FIELDS = {"warc-type": "type", "warc-record-id": "record_id", "warc-concurrent-to": "concurrent_to", "warc-target-uri": "uri", "warc-date": "date", "warc-payload-digest": "digest", "x-page-id": "page_id", "x-refers-to-page-id": "refers_to"}


def records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives at path: the fields above and payload (binary)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                held, size = [], 0
                for headers, payload in _parse(content):
                    held.append([headers.get(k) for k in FIELDS] + [payload])
                    size += len(payload)
                    if size > 8_000_000:
                        yield pd.DataFrame(held, columns=[*FIELDS.values(), "payload"])
                        held, size = [], 0
                yield pd.DataFrame(held, columns=[*FIELDS.values(), "payload"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(run, ", ".join(f"{c} string" for c in FIELDS.values()) + ", payload binary")


def captures(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per capture: page_id, uri, type, refers_to, and the nested records response, request and metadata.

    The response of a revisit has the bytes and digest of the payload that it refers to (by digest), and no payload.
    payloads=False leaves the payloads
    out after they are read and digested, so that joins don't move them. Records without partners leave nulls. An archive without records gives an empty table.
    """
    all_ = records(spark, path)
    main = all_.filter("type in ('response', 'revisit')").withColumns({"bytes": F.octet_length("payload").cast("long"), "sha256": F.sha2("payload", 256)})
    main = main if payloads else main.drop("payload")
    stored = main.filter(f"type = 'response' and bytes >= {MIN_BYTES}").groupBy("sha256").agg(F.max("bytes").alias("full_bytes"))
    stored = stored.withColumnRenamed("sha256", "full_sha256")
    found = main.withColumn("want", F.when(F.col("type") == "revisit", F.substring("digest", 8, 64))).join(stored, F.col("want") == F.col("full_sha256"), "left")
    again = F.col("type") == "revisit"
    asked = all_.filter("type = 'request'").select(F.col("record_id").alias("q_id"), F.col("concurrent_to").alias("q_to"), F.col("payload").cast("string").alias("q_block"))
    noted = all_.filter("type = 'metadata'").select(F.col("record_id").alias("m_id"), F.col("concurrent_to").alias("m_to"), F.col("payload").cast("string").alias("m_block"))
    through = asked.select(F.col("q_id").alias("t_id"), F.col("q_to").alias("t_to"))
    noted = noted.join(through, F.col("m_to") == F.col("t_id"), "left").withColumn("m_to", F.coalesce("t_to", "m_to"))
    rows = found.join(asked, F.col("record_id") == F.col("q_to"), "left").join(noted, F.col("record_id") == F.col("m_to"), "left")
    return rows.select(
        F.expr("try_cast(page_id as long)").alias("page_id"), "uri", "type", F.expr("try_cast(refers_to as long)").alias("refers_to"),
        F.struct("record_id", "date", *["payload"] * payloads, F.when(again, F.col("full_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"), F.when(again, F.col("full_sha256")).otherwise(F.col("sha256")).alias("payload_digest")).alias("response"),
        F.struct(F.col("q_id").alias("record_id"), F.col("q_block").alias("block")).alias("request"),
        F.struct(F.col("m_id").alias("record_id"), F.col("m_block").alias("block")).alias("metadata"),
    )
