"""WARC archives of web pages and their merged capture index (operator 3).

Writing: each page becomes a record; of pages with equal payloads the one with the smallest page_id is
stored as a response and the others as revisits of it. Records are the rows of Spark's text writer, whose
line separator is the blank lines that end a WARC record, so that archives go through Spark's commit
protocol to any file system (gzip files, at most RECORDS records each).

Reading: Spark's text reader streams an archive in pieces that end at blank lines, and records are put
together again by their Content-Length, so that a task holds one record at a time and not an archive.
Each archive gives a run of index lines, locally sorted by URL key, time and page; the runs are dealt out by
ranges of that key, and each range's runs are merged with a loser tree, which yields all captures in global
order; a capture's position in that order comes from the ranges' sizes.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlake.llm.common import checked, new_path, written

#: Records of an archive at most, and index lines of a range about.
RECORDS, RANGE_ROWS = 5_000, 200_000
END = "\r\n\r\n"
_FROM, _TO = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Captures are a second apart from this time on, by page_id, as the pages carry no time.
EPOCH = "2024-01-01 00:00:00"


def digest(payload: Column) -> Column:
    """The payload's SHA-1 in upper-case base32 (40 bits of it are 8 characters)."""
    hexa = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.translate(F.conv(F.substring(hexa, 1 + 10 * k, 10), 16, 32), _FROM, _TO), 8, "A") for k in range(4)]
    return F.concat(*parts)


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(name + ": "), F.regexp_replace(value.cast("string"), r"[\x00-\x1F\x7F]", " "), F.lit("\r\n")), F.lit(""))


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes a record for each row of pages (page_id, url, html) under path."""
    body = F.coalesce(F.col("html"), F.lit(""))
    slim = pages.select("page_id", "url", body.alias("body"), digest(body).alias("digest"))
    first = slim.select("page_id", "digest").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = checked(written(first.where("n > 1").select(F.col("digest").alias("_d"), "first"), "warc-shared"))
    rows = slim.join(shared, F.col("digest") == F.col("_d"), "left")
    revisit = F.coalesce(F.col("first") != F.col("page_id"), F.col("first").isNotNull() & F.col("page_id").isNull())
    n = F.octet_length("body")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n.cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("body")))
    at = F.date_format(F.to_timestamp(F.lit(EPOCH)) + F.make_dt_interval(secs=F.coalesce(F.pmod("page_id", F.lit(10**9)), F.lit(0)).cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        _header("WARC-Date", at),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _header("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")))),
        _header("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
    )
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


def records(pieces: Iterable[str]) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of every record of an archive, which comes in the pieces between its blank lines."""
    at, mark, held, need = 0, END.encode(), bytearray(), 0
    for piece in pieces:
        held += piece.encode()
        held += mark
        while len(held) >= need and held.startswith(b"WARC/"):  # what follows the last record is line ends
            k = held.find(mark)
            headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in held[:k].decode().split("\r\n")[1:])}
            begin = k + len(mark)
            need = begin + int(headers["content-length"]) + len(mark)
            if len(held) >= need:
                yield at, headers, bytes(held[begin : need - len(mark)])
                del held[:need]
                at, need = at + need, 0


def url_key(url: str | None) -> str:
    """The host's labels in reverse order, then the rest of the URL, in lower case."""
    m = re.match(r"[^:/?#]*://([^/?#]*)(.*)", url or "", re.S)
    if not m:
        return (url or "").lower()
    return f"{','.join(reversed(m[1].lower().split('.')))}){m[2].lower()}"


_RUN = "url_key string, captured_at string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, run string, n long"


def _number(text: str | None) -> int | None:
    got = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(got) if got else None


def _sort_key(row: dict) -> tuple:
    return row["url_key"], row["captured_at"], row["page_id"] is not None, row["page_id"] or 0, row["archive"], row["offset"]


def _line(archive: str, at: int, h: dict[str, str], block: bytes) -> dict:
    http, _, payload = block.partition(END.encode())
    row = {"url_key": url_key(h.get("warc-target-uri")), "captured_at": h["warc-date"], "page_id": _number(h["warc-record-id"]), "record_type": h["warc-type"], "refers_to": _number(h.get("warc-refers-to")), "archive": archive, "offset": at, "run": archive}
    if h["warc-type"] == "revisit":
        return row | {"payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]), "payload_digest": h["warc-payload-digest"].removeprefix("sha1:")}
    return row | {"payload_bytes": len(payload), "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode()}


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted run for each archive; an archive's pieces follow each other in their order."""
    fields = [x.split() for x in _RUN.split(", ")]
    schema = pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in fields])
    pieces = ((path.as_py(), value.as_py()) for b in batches for path, value in zip(b["path"], b["value"], strict=True))
    for path, own in groupby(pieces, key=lambda x: x[0]):
        archive = path.rpartition("/")[2]
        lines = sorted((_line(archive, *r) for r in records(x[1] for x in own)), key=_sort_key)
        yield pa.RecordBatch.from_pylist([r | {"n": k} for k, r in enumerate(lines)], schema=schema)


def merge(runs: list[Iterable[tuple]]) -> Iterator[tuple]:
    """The items of sorted runs in order, by a tree of losers: one comparison a level for each item."""
    heads = [iter(r) for r in runs]
    k = len(heads)
    if not k:
        return
    items = [next(h, None) for h in heads]
    first = lambda a, b: b if items[a] is None else a if items[b] is None or items[a] <= items[b] else b
    loser, won = [0] * k, [0] * (2 * k)
    for leaf in range(k):
        won[k + leaf] = leaf
    for node in range(k - 1, 0, -1):
        a, b = won[2 * node], won[2 * node + 1]
        won[node] = first(a, b)
        loser[node] = b if won[node] == a else a
    best = won[1] if k > 1 else 0
    while items[best] is not None:
        yield items[best]
        items[best] = next(heads[best], None)
        node, mine = (best + k) // 2, best
        while node:
            if first(loser[node], mine) == loser[node]:
                loser[node], mine = mine, loser[node]
            node //= 2
        best = mine


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range's part of every run, merged; runs come one after the other, and the range is bounded by RANGE_ROWS."""
    got = list(batches)
    table = pa.Table.from_batches(got) if got else None
    if table is None or not table.num_rows:
        return
    rows = table.to_pylist()
    runs = [list(own) for _, own in groupby(range(len(rows)), key=lambda i: rows[i]["run"])]
    order = [x[-1] for x in merge([((*_sort_key(rows[i]), i) for i in own) for own in runs])]
    out = table.take(pa.array(order)).drop_columns(["run", "n"]).append_column("place", pa.array(range(len(order)), pa.int64()))
    yield from out.to_batches(max_chunksize=10_000)


_INDEX = _RUN.removesuffix(", run string, n long")


def capture_index(spark: SparkSession, path: str) -> DataFrame:
    """The index lines of all archives under path, with their position in the global order of URL key, time and page."""
    files = spark.read.option("lineSep", END).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").text(path)
    runs = written(files.select(F.col("_metadata.file_path").alias("path"), "value").mapInArrow(_runs, _RUN), "warc-runs")
    n = runs.count()
    ranged = runs.repartitionByRange(max(1, math.ceil(n / RANGE_ROWS)), "url_key", "captured_at", "page_id", "archive", "offset").sortWithinPartitions("run", "n")
    merged = written(ranged.mapInArrow(_merged, f"{_INDEX}, place long").withColumn("range", F.spark_partition_id()), "warc-index")
    sizes = merged.groupBy(F.col("range").alias("_r")).agg(F.count("*").alias("n"))
    before = sizes.select("_r", (F.sum("n").over(Window.orderBy("_r")) - F.col("n")).alias("before"))  # a row a range
    return merged.join(F.broadcast(before), F.col("range") == F.col("_r")).withColumn("position", F.col("before") + F.col("place")).drop("range", "place", "_r", "before")


def archive(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, the place of every page's record and its position.

    Null html is an empty payload; a null url has no target line and an empty key; a null page_id counts
    as the largest when a response is chosen, sorts before others and is null again when read back; rows
    that share the smallest page_id of a payload are all responses; pages of any length are read back
    record by record; an empty table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    return capture_index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "archive", "offset", "position")
