"""WARC archives of captured pages and an external merge of their index.

Writing. A page becomes one WARC/1.1 record: a `response` with its payload, or a `revisit` that refers
to the response with the same payload. Equal payloads of at least `least` bytes are found by digest and
length; the one with the largest page_id is the response. Every record is a gzip member of its own, so
an archive can be read from any record's offset. A task appends records to a file in the shared folder
and begins another one at FILE_BYTES; the files' names come from the task's attempt, and a table of the
files, written under Spark's commit protocol, says which of them count: those of attempts that were lost
are not in it. Folders are reached through pyarrow's file systems (local or mounted, hdfs, s3, gs).

Reading. Archives are read as streams, a record at a time, and parsed by Content-Length. Each file gives
a run of index lines sorted by URL key, timestamp and page, with the offset and length of its member.

Merging. More than FAN_IN runs are merged in rounds: runs are dealt into groups of about FAN_IN, each group becomes one
longer run, and so on, so that a loser tree never has many more sources than that and the number of passes
over the index is the logarithm of the files to the base FAN_IN. In each round, and in the last one, which
takes all runs, lines are range-partitioned by (group and) the same key, then file and offset, into ranges of about
RANGE_ROWS lines; in each range a loser tree merges the slices of the runs, comparing one head per run, so the
result is globally ordered over the partitions: the capture history of each URL. A task reads several files. No two lines have one key,
so one host or URL with a large share of all captures is spread over many ranges, and a task holds one
range of index lines, whatever the size of the corpus.

Defined cases: a null html is an empty payload; a null url is empty; a null page_id is written as `null`
and captured at the epoch of the series; rows that share the largest page_id of a group are all
responses; rows that share a page_id share their record id too; blanks and control characters in a url are
percent-encoded in headers; a payload of any length is one record, held once at a time; an empty table gives no archives;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import discard, new_path, written

FILE_BYTES, RANGE_ROWS = 64 << 20, 200_000
#: Runs that are merged at once, and files that a task reads at most where there are more files than tasks at a time.
FAN_IN, TASK_FILES = 128, 64
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, run string, first long, length long"
_KEY = ["url_key", "captured", "page_id", "run", "first"]
_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


def _appended(path: str):
    """Writes each batch's records as gzip members -> a row (file, records, bytes) for each file that is complete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _opened(path)
        files.create_dir(folder, recursive=True)
        name, count, size, out = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, 0, None

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"file": f"{path}/{file}", "records": count, "bytes": size}])

        part = 0
        for batch in batches:
            for record in batch.column(0):
                if out is None:
                    file = f"{name}-{part:04d}.warc.gz"
                    out = files.open_output_stream(f"{folder}/{file}", compression=None)
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = pack.compress(record.as_buffer()) + pack.compress(b"\r\n\r\n") + pack.flush()
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= FILE_BYTES:
                    yield closed()
                    part, count, size, out = part + 1, 0, 0, None
        if out is not None:
            yield closed()

    return run


def write_archives(pages: DataFrame, path: str, least: int = 1000) -> DataFrame:
    """pages (page_id, url, html) -> WARC files below path, and the table of them (file, records, bytes)."""
    page, html = F.col("page_id").cast("long"), F.coalesce("html", F.lit(""))
    rows = pages.select(page.alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("bytes", F.octet_length("html"))
    same = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("origin"), F.max("bytes").alias("size"), F.count("*").alias("n")).where("n > 1")
    same = same.select(F.col("digest").alias("key"), "size", "origin")
    rows = rows.join(same, (F.col("digest") == F.col("key")) & (F.col("bytes") == F.col("size")), "left")
    revisit = F.coalesce(F.col("page_id") != F.col("origin"), F.col("origin").isNotNull())
    url = F.regexp_replace(F.regexp_replace("url", "%(?=[01][0-9A-F]|20|7F)", "%25"), "([\\x00-\\x20\\x7F])", "%00$1")
    for code in (*range(0x21), 0x7F):
        url = F.replace(url, F.lit("%00" + chr(code)), F.lit(f"%{code:02X}"))
    when = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce(F.pmod("page_id", F.lit(31_536_000)), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    size = F.lit(len(HTTP)) + F.when(revisit, 0).otherwise(F.col("bytes"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _urn(F.col("page_id")), F.lit("\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Date: "), when,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nWARC-Payload-Length: "), F.col("bytes").cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _urn(F.col("origin")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n" + HTTP), F.when(revisit, "").otherwise(F.col("html")),
    )
    return written(rows.select(record.alias("record")).mapInArrow(_appended(path), "file string, records long, bytes long"), "archives")


def members(stream: BinaryIO, chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(first byte, length, content) of each gzip member of a stream."""
    at, ahead = 0, b""
    while ahead or (ahead := stream.read(chunk)):
        unpack, parts, used = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if not ahead and not (ahead := stream.read(chunk)):
                raise ValueError(f"the member at byte {at} has no end")
            parts.append(unpack.decompress(ahead))
            used += len(ahead) - len(unpack.unused_data)
            ahead = unpack.unused_data
        yield at, used, b"".join(parts)
        at += used


def record(raw: bytes, where: str = "") -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record."""
    stop = raw.find(b"\r\n\r\n")
    version, *lines = raw[: max(stop, 0)].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no record: {where}")
    head = dict(x.split(": ", 1) for x in lines)
    end = stop + 4 + int(head["Content-Length"])
    if raw[end:] != b"\r\n\r\n":
        raise ValueError(f"the record does not end where its length says: {where}")
    return head, raw[stop + 4 : end]


def read_record(file: str, first: int, length: int) -> tuple[dict[str, str], bytes]:
    """(headers, block) of the record at an index line's place, reading nothing else."""
    files, path = _opened(file)
    with files.open_input_file(path) as f:
        f.seek(first)
        return record(zlib.decompress(f.read(length), 31), f"{file} at byte {first}")


def url_key(url: str) -> str:
    """Host labels in reverse, then path and query, lower-cased; scheme, `www.` and fragment do not count."""
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
    except ValueError:
        return url.lower()
    host = re.sub(r"^www\d*\.", "", host)
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/").lower() + ("?" + parts.query.lower() if parts.query else "")


def _page(urn: str | None) -> int | None:
    return None if urn is None or urn == "<urn:page:null>" else int(urn[len("<urn:page:") : -1])


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file) -> each archive's index lines, sorted; payloads are checked against their digests."""
    for batch in batches:
        for file in batch.column(0).to_pylist():
            rows = []
            files, path = _opened(file)
            with files.open_input_stream(path, compression=None) as stream:
                for at, length, raw in members(stream):
                    head, block = record(raw, f"{file} at byte {at}")
                    digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["WARC-Payload-Length"])
                    if head["WARC-Type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, size):
                            raise ValueError(f"{file}: the payload at byte {at} is damaged")
                    refers = _page(head.get("WARC-Refers-To"))
                    rows.append((url_key(head.get("WARC-Target-URI", "")), head["WARC-Date"], _page(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], refers, file, at, length))
            rows.sort(key=_order)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)


class LoserTree:
    """Merges k sorted sources. Inner nodes keep the loser of their match; a new head replays one path."""

    def __init__(self, heads: list, beats: Callable) -> None:
        self.heads, self.beats, self.k = heads, beats, len(heads)
        self.losers = [0] * max(1, self.k)
        self.winner = self._build(1) if self.k > 1 else 0

    def _build(self, node: int) -> int:
        stack, won = [(node, False)], {}
        while stack:
            at, ready = stack.pop()
            if at >= self.k:
                won[at] = at - self.k
            elif not ready:
                stack += [(at, True), (2 * at, False), (2 * at + 1, False)]
            else:
                a, b = won.pop(2 * at), won.pop(2 * at + 1)
                won[at], self.losers[at] = (a, b) if self._first(a, b) else (b, a)
        return won[node]

    def _first(self, a: int, b: int) -> bool:
        """Whether source a's head goes before source b's; exhausted sources (None) go last, ties by source."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return self.beats(x, y) or (not self.beats(y, x) and a < b)

    def replace(self, head) -> None:
        """The winner's next head (None when it has no more)."""
        at, own = (self.winner + self.k) >> 1, self.winner
        self.heads[own] = head
        while at:
            if self._first(self.losers[at], own):
                self.losers[at], own = own, self.losers[at]
            at >>= 1
        self.winner = own


def merge_order(keys: Callable[[int], tuple], stretches: list[tuple[int, int]]) -> np.ndarray:
    """Row numbers of sorted stretches [begin, end), merged."""
    at = [a for a, _ in stretches]
    tree = LoserTree([keys(a) for a, _ in stretches], lambda x, y: x < y)
    out = np.empty(sum(b - a for a, b in stretches), np.int64)
    for n in range(len(out)):
        own = tree.winner
        out[n] = at[own]
        at[own] += 1
        tree.replace(keys(at[own]) if at[own] < stretches[own][1] else None)
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of the index: its rows come in slices of sorted runs, in any order; those of a group become one run."""
    found = list(batches)  # about RANGE_ROWS rows
    if not sum(map(len, found)):
        return
    rows = pa.Table.from_batches(found)
    keys = [(g, u, t, p is not None, p or 0, r, f) for g, u, t, p, r, f in zip(*(rows.column(c).to_pylist() for c in ("merged", "url_key", "captured", "page_id", "run", "first")), strict=True)]
    edges = [0, *(i for i in range(1, len(keys)) if keys[i] < keys[i - 1]), len(keys)]
    order = merge_order(keys.__getitem__, list(zip(edges, edges[1:], strict=False)))
    yield from rows.take(pa.array(order)).combine_chunks().to_batches(max_chunksize=10_000)


def merged_index(archives: DataFrame) -> DataFrame:
    """archives (file, records) -> their index in the order of URL key, timestamp and page, over all partitions."""
    files, lines = archives.agg(F.count("*"), F.sum("records")).first()
    tasks = min(max(1, files), max(4 * archives.sparkSession.sparkContext.defaultParallelism, -(-files // TASK_FILES)))
    runs = written(archives.select("file").repartition(tasks).mapInArrow(_runs, INDEX), "runs")
    ranges, groups = max(1, -(-(lines or 0) // RANGE_ROWS)), files
    part = F.xxhash64("run")
    while groups > FAN_IN:
        groups = -(-groups // FAN_IN)
        part = F.pmod(part, F.lit(groups))  # groups of groups: what one round has joined stays together
        longer = written(runs.withColumn("merged", part.cast("int")).repartitionByRange(ranges, "merged", *_KEY).mapInArrow(_merge, INDEX + ", merged int"), "runs")
        discard(runs)
        runs = longer.drop("merged")
        runs.veilwork_path = longer.veilwork_path
    return runs.withColumn("merged", F.lit(0)).repartitionByRange(ranges, *_KEY).mapInArrow(_merge, INDEX + ", merged int").drop("merged")


def archive_pages(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes pages as WARC archives into the shared folder and returns their merged index."""
    return merged_index(write_archives(pages, new_path(pages.sparkSession, "warc"), least))
