"""WARC archives of pages, and their index: globally ordered capture histories."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import math
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creativeaudit.llm.common import stored
from creativeaudit.operators.sizing import small_side
from creativeaudit.session import fresh_path

#: What ends a record; the text sink writes it after each row.
END = "\r\n\r\n"
#: Records of one archive file, which bounds what a reading task holds.
PER_ARCHIVE = 10_000
#: Captures that one merging task holds.
PER_RANGE = 50_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HISTORY = ("url_key string, captured_at string, page_id long, record_type string, refers_to long, "
           "payload_bytes long, payload_digest string, archive string, offset long")


def base32_sha1(text: Column) -> Column:
    """SHA-1 in base 32: four times forty bits, whose base-32 digits then get the usual letters."""
    hexed = F.sha1(text.cast("binary"))
    digits = F.concat(*[F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)])
    return F.translate(F.upper(digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, captured_at: Column, page_id: str = "page_id", url: str = "url", html: str = "html",
            least_bytes: int = 0) -> DataFrame:
    """One record per page as text, without the end of record; equal payloads are stored once.

    Of equal payloads of at least ``least_bytes`` the one with the largest id
    is a response, the others revisit it. Digests are counted first, so that a
    payload of a third of all pages is one row per task in the shuffle.
    """
    base = pages.select(F.col(page_id).cast("long").alias("page_id"), F.regexp_replace(url, "[\r\n]", "").alias("url"),
                        F.coalesce(F.col(html), F.lit("")).alias("html"), F.date_format(captured_at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))
    base = base.select("*", base32_sha1(F.col("html")).alias("digest"), F.octet_length("html").alias("size"))
    groups = base.filter(F.col("size") >= least_bytes).groupBy("digest").agg(
        F.max("page_id").alias("best"), F.count(F.lit(1)).alias("n"))
    repeated = stored(groups.filter("n > 1").select("digest", "best"), "payloads")
    rows = base.join(small_side(repeated), "digest", "left")
    revisit = F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(key + ": "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "),
                    F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name("page_id")), F.coalesce(line("WARC-Date", F.col("at")), F.lit("")),
        F.coalesce(line("WARC-Target-URI", F.col("url")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", name("best")), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))).cast("string")))
    return rows.select(F.concat(head, F.lit("\r\n"), block).alias("value"))


def write_archives(made: DataFrame, path: str, per_archive: int = PER_ARCHIVE) -> None:
    """Gzipped WARC files. Spark's text sink writes them: any store it knows, whole files or none."""
    (made.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_archive).text(path))


def url_key(url: str | None) -> str:
    """Host labels from the top down, then path and query: captures of a site are neighbours."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    place = "" if port in (None, 80, 443) else f":{port}"
    return f"{','.join(reversed(host.split('.')))}{place}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def parsed(stream: io.BufferedIOBase):
    """(offset, headers, block) of each record; offsets are in the unpacked stream."""
    at = 0
    while True:
        first = stream.readline()
        if not first:
            return
        if first.strip() != b"WARC/1.1":
            raise ValueError(f"no record at {at}")
        headers, size = {}, len(first)
        while (line := stream.readline()) != b"\r\n":
            size += len(line)
            key, _, value = line.decode().partition(":")
            headers[key.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if stream.read(len(END)) != END.encode():
            raise ValueError(f"the record at {at} does not end where it should")
        yield at, headers, block
        at += size + 2 + len(block) + len(END)


def _number(urn: str | None) -> int | None:
    inner = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner.lstrip("-").isdigit() else None


def capture(archive: str, at: int, headers: dict, block: bytes) -> tuple:
    """A row of the index. The payload of a response must have the digest that its header names."""
    http, _, payload = block.partition(END.encode())
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] == "response":
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != size:
            raise ValueError(f"damaged payload in {archive} at {at}")
    return (url_key(headers.get("warc-target-uri")), headers.get("warc-date") or "", _number(headers["warc-record-id"]),
            headers["warc-type"], _number(headers.get("warc-refers-to")), size, digest, archive, at)


def _order(row: tuple) -> tuple:
    """URL key, time, id; rows that agree in all of them by where they stand."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_SCHEMA = pa.schema([(n, {"string": pa.string(), "long": pa.int64()}[t]) for n, t in
                     (x.split() for x in HISTORY.split(", "))])


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Reads all archives; the captures of each are one run, sorted by URL key, time and id."""
    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())) as stream:
                    rows = sorted((capture(name, *r) for r in parsed(stream)), key=_order)
                yield _batch(rows, _SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInArrow(read, HISTORY)


class LoserTree:
    """Merges sorted runs: inner nodes keep the loser of each match, so a new row plays one match per level."""

    def __init__(self, runs: list[list[tuple]], key) -> None:
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.at = [0] * self.k
        self.heads = [key(r[0]) if r else None for r in runs] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        """A run that is at its end loses to all others."""
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x <= y)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0:  # the first to come here waits for its opponent
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.heads[winner := self.losers[0]] is not None:
            run = self.runs[winner]
            yield run[self.at[winner]]
            self.at[winner] += 1
            self.heads[winner] = self.key(run[self.at[winner]]) if self.at[winner] < len(run) else None
            self._play(winner)


def merged_histories(runs: DataFrame, per_range: int = PER_RANGE) -> DataFrame:
    """All captures in the order of URL key, time and id, over all partitions.

    Each partition gets one range of keys out of every run and merges what the
    runs hold of it with a loser tree. A range ends between any two captures,
    so that one URL with very many captures spreads over partitions.
    """
    def merge(batches):
        whole = pa.Table.from_batches(batches, _SCHEMA)
        name = whole.column("archive").combine_chunks().dictionary_encode()
        rows = list(zip(*(whole.column(c).to_pylist() for c in _SCHEMA.names)))
        if not rows:
            return
        by = np.argsort(np.asarray(name.indices), kind="stable")
        # What a run holds of this range arrives in order. Where a file was read in parts, each is a run.
        parts: list[list[tuple]] = []
        for i in by:
            row = rows[i]
            if parts and parts[-1][-1][7] == row[7] and _order(parts[-1][-1]) <= _order(row):
                parts[-1].append(row)
            else:
                parts.append([row])
        out: list[tuple] = []
        for row in LoserTree(parts, _order):
            out.append(row)
            if len(out) == 10_000:
                yield _batch(out, _SCHEMA)
                out = []
        yield _batch(out, _SCHEMA)

    n = max(1, math.ceil(runs.count() / per_range))
    return runs.repartitionByRange(n, "url_key", "captured_at", "page_id", "archive", "offset").mapInArrow(merge, HISTORY)


def capture_histories(pages: DataFrame, captured_at: Column, page_id: str = "page_id", url: str = "url",
                      html: str = "html", least_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Writes pages to WARC archives, reads those back and returns the merged index.

    Every page gives a row. A null html is empty, a null URL has the empty key
    and comes first, a null time likewise. Pages that repeat an id share its
    record name; of equal payloads all rows with the largest id are responses,
    and payloads none of which has an id are all responses. No pages give no
    rows; further columns are ignored. Columns: see HISTORY.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_archives(records(pages, captured_at, page_id, url, html, least_bytes), path)
    return merged_histories(stored(read_runs(spark, path), "runs"))
