"""WARC captures: reading and writing records, and resolving not-modified revisits.

A revisit of the server-not-modified profile holds the headers of a 304 answer
and no body.  It is resolved by an as-of join: the latest full response for
the same canonical URL that is strictly earlier.  Its validators are checked
against that response (ETag by weak comparison, else Last-Modified, else the
payload digest), and the response's headers are updated by those of the 304
that a cache may take over.

Defined results: without an earlier response the verdict is ``no_response``;
with a validator that differs ``mismatch``; where no validator is on both sides
``no_validator``; else ``resolved``.  Only a resolved revisit gets headers.  Of
responses at one time the one with the largest id (null is smallest) counts as
latest.  A null URL or time never matches; a null id is an id like others.
Repeated revisits are resolved each and stay as many as they were.  Of responses
with one id, URL and time the one with the largest digest, then the largest
sorted headers, counts (null is smallest).  Columns other than those of the
result are carried along whatever their names; those named as a column of the
result (response_id, response_at, verdict, headers) are replaced.  Empty tables
give empty results.
"""

from __future__ import annotations

import gzip
import io
import itertools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from muster.llm.store import free_name, stored, with_row_id
from muster.operators import pieces

#: Headers of a 304 that never replace stored ones (RFC 9110, RFC 9111).
NOT_MERGED = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Pieces of a URL with very many captures.
PIECES = pieces.PIECES
#: Query parameters that do not select content.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)"
_URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www., m. and the default port, path without a
    last slash, sorted query without tracking parameters; no scheme or fragment."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), r"^([^@]*@)?(www\.|m\.)?", ""), r":(80|443)?$", "")
    path = F.regexp_replace(F.regexp_extract(url, _URL, 2), r"/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(url, _URL, 3), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(url.rlike(_URL), F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise("")))


def merged_headers(kept: Column, update: Column) -> Column:
    """``kept`` with the permitted headers of ``update``; names are in lower case."""
    update = F.map_filter(F.coalesce(update, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*NOT_MERGED) & v.isNotNull())
    kept = F.map_filter(F.coalesce(kept, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(update, k))
    return F.map_concat(kept, update)


def _compare(new: Column, old: Column) -> Column:
    """Whether they are equal; null unless both are there."""
    return F.when(new.isNotNull() & old.isNotNull(), new == old)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def timed(records: DataFrame) -> DataFrame:
    """Records of ``read_warc`` with ``at``, the microseconds of their date; null where there is none."""
    return records.withColumn("at", F.unix_micros(F.try_to_timestamp("date")))


def _answers(told: DataFrame) -> DataFrame:
    """row, response_row of the revisits in ``told`` (row, kind, id, at, key) that a response precedes."""
    told = stored(pieces.with_pieces(told, "key", "at", PIECES), "told")
    mark = F.when(F.col("kind") == "response", F.struct("at", "id", "row"))
    inside = Window.partitionBy("key", "piece").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    here = told.withColumn("near", F.max(mark).over(inside)).where("kind = 'revisit'")
    # the latest response of earlier pieces: one row for each URL and piece
    ends = told.groupBy("key", "piece").agg(F.max(mark).alias("end"))
    earlier = Window.partitionBy("key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    ends = stored(ends.withColumn("far", F.max("end").over(earlier)).where("far IS NOT NULL").select("key", "piece", "far"), "ends")
    found = here.join(ends, ["key", "piece"], "left").select("row", F.coalesce("near", "far")["row"].alias("response_row"))
    return found.where("response_row IS NOT NULL")


def resolve_revisits(records: DataFrame, bodies: bool = False) -> DataFrame:
    """Every revisit of ``records`` with response_id, response_at, verdict and merged headers,
    and with ``bodies`` the body of the response of each resolved one.

    ``records`` (stored): record_id, kind (``response`` or ``revisit``), url,
    at (long, any unit), headers (map, names in lower case), digest, and body if asked for.
    """
    row = free_name(records, "row")
    rows = with_row_id(records, row)
    made = ["headers", "response_id", "response_at", "verdict", *(["body"] if bodies else [])]
    names = [c for c in records.columns if c.lower() not in ("kind", *made)]
    col = lambda c: F.col(f"`{c}`")

    placed = rows.where("kind IN ('response', 'revisit') AND at IS NOT NULL").select(
        col(row).alias("row"), "kind", F.col("record_id").alias("id"), "at", canonical_url(F.col("url")).alias("key"), "digest", "headers").where("key IS NOT NULL")
    entries = F.array_sort(F.map_entries("headers"))
    best = placed.where("kind = 'response'").groupBy("id", "key", "at").agg(F.max_by("row", F.struct("digest", entries)).alias("row"))
    best = best.select("row", F.lit("response").alias("kind"), "id", "at", "key")
    told = stored(placed.where("kind = 'revisit'").select("row", "kind", "id", "at", "key").unionByName(best), "captures")
    found = _answers(told)

    revisits = rows.where("kind = 'revisit'").select(col(row).alias("row"), F.struct(*[col(c) for c in names]).alias("own"), F.col("headers").alias("new"), F.col("digest").alias("new_digest"))
    answers = rows.where("kind = 'response'").select(
        col(row).alias("response_row"), F.col("record_id").alias("response_id"), F.col("at").alias("response_at"),
        F.struct("headers", "digest", *(["body"] if bodies else [])).alias("old"))
    out = revisits.join(found, "row", "left").join(answers, "response_row", "left")
    new, old = F.col("new"), F.col("old")["headers"]
    same = F.coalesce(
        _compare(_weak(new["etag"]), _weak(old["etag"])), _compare(new["last-modified"], old["last-modified"]), _compare(F.col("new_digest"), F.col("old")["digest"]))
    verdict = F.when(F.col("response_row").isNull(), "no_response").when(same.isNull(), "no_validator").when(same, "resolved").otherwise("mismatch")
    out = out.withColumn("verdict", verdict)
    resolved = lambda c: F.when(F.col("verdict") == "resolved", c)
    result = ["response_id", "response_at", "verdict", resolved(merged_headers(old, new)).alias("headers"), *([resolved(F.col("old")["body"]).alias("body")] if bodies else [])]
    return out.select("own", F.struct(*result).alias("made")).select("own.*", "made.*")


def warc_bytes(record: dict) -> bytes:
    """One gzip member: a record of record_id, kind, url, date, headers, body, status."""
    revisit = record["kind"] == "revisit"
    status = record.get("status") or ("304 Not Modified" if revisit else "200 OK")
    head = f"HTTP/1.1 {status}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in (record.get("headers") or {}).items()) + "\r\n"
    block = head.encode() + (b"" if revisit else record.get("body") or b"")
    fields = {
        "WARC-Type": record["kind"], "WARC-Record-ID": f"<{record['record_id']}>", "WARC-Target-URI": record["url"], "WARC-Date": record["date"],
        "Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block)),
    }
    if revisit:
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
    if record.get("digest"):
        fields["WARC-Payload-Digest"] = record["digest"]
    return gzip.compress(b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n", mtime=0)


def _fields(stream: io.BufferedIOBase) -> dict[str, str]:
    out: dict[str, str] = {}
    name = None
    while (line := stream.readline().rstrip(b"\r\n")) != b"":
        text = line.decode("utf-8", "replace")
        if text[0] in " \t" and name:
            out[name] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def parse_warc(data: bytes) -> Iterator[dict]:
    """Records of a WARC file, gzipped by record or plain, one at a time."""
    raw: io.BufferedIOBase = io.BytesIO(data)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if data[:2] == b"\x1f\x8b" else raw
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = _fields(stream)
        block = io.BytesIO(stream.read(int(fields.get("content-length", 0))))
        kind = fields.get("warc-type", "")
        record = {"record_id": fields.get("warc-record-id", "").strip("<>"), "kind": kind, "url": fields.get("warc-target-uri", "").strip("<>") or None,
                  "date": fields.get("warc-date"), "digest": fields.get("warc-payload-digest"), "status": None, "headers": None, "body": None}
        if kind in ("response", "revisit") and "application/http" in fields.get("content-type", ""):
            record["status"] = block.readline().rstrip(b"\r\n").decode("latin-1").partition(" ")[2]
            record["headers"] = _fields(block)
        record["body"] = block.read() if kind != "revisit" else None
        yield record


RECORD = "record_id string, kind string, url string, date string, digest string, status string, headers map<string,string>, body binary"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files at ``path``; a file is one task's work and must fit in it."""
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                records = parse_warc(content)
                while part := list(itertools.islice(records, 1000)):
                    yield pd.DataFrame(part)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, RECORD)
