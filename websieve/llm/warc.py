"""WARC archives: deduplicating writer and salvage reader.

Writer: one gzip member per record. Of records with equal payloads of at least ``min_bytes``
bytes, the one with the smallest id is a response; the others are revisits that name it and
carry only HTTP headers. Digests are counted with partial sums before their shuffle, and rows
join the few that repeat by digest, where adaptive execution can split a hot one.

Reader: each record is checked (member checksum, version line, headers, length, block digest).
After a failed check it looks for the next offset where a valid member or version line starts,
goes on there, and logs the bytes in between as a quarantined gap. It streams a file through a
small window; only one record is in memory at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import attempt_name, left_join, make_folder, map_batches, new_folder, open_path, staged

MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
WINDOW = 1 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(kind: str, page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{page_id}>", f"WARC-Date: {date}", "WARC-Target-URI: " + "".join(url.splitlines()),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at data[at:]; ValueError if a check fails."""
    stop = data.find(b"\r\n\r\n", at)
    if not data.startswith(VERSION, at) or stop < 0:
        raise ValueError("no version line or header end")
    lines = data[at:stop].decode("utf-8", "strict").split("\r\n")
    pairs = [line.partition(":") for line in lines[1:]]
    if not all(p[1] for p in pairs):
        raise ValueError("a header line has no colon")
    headers = {k.strip().lower(): v.strip() for k, _, v in pairs}
    if not headers.get("content-length", "").isdecimal() or "warc-type" not in headers or "warc-record-id" not in headers:
        raise ValueError("a required header is missing")
    start, end = stop + 4, stop + 4 + int(headers["content-length"])
    block = data[start:end]
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("the block doesn't end where its length says")
    name, _, want = headers.get("warc-block-digest", "").partition(":")
    if name in ("sha1", "sha256", "md5") and hashlib.new(name, block).hexdigest() != want.lower():
        raise ValueError("the block fails its digest")
    return headers, block, end + 4


class Salvage:
    """Records and gaps of one archive, gzip members or plain, behind read(offset, n)."""

    def __init__(self, read, size: int):
        self.read, self.size, self.window = read, size, (0, b"")

    def chunk(self, at: int) -> bytes:
        """Up to WINDOW bytes at an offset; neighbouring calls share a read."""
        start, data = self.window
        if not (start <= at < start + len(data)):
            self.window = start, data = at, self.read(at, WINDOW)
        return data[at - start :]

    def member(self, at: int) -> tuple[bytes, int]:
        """The data of the gzip member at an offset, and its end."""
        d, out, pos = zlib.decompressobj(31), [], at
        while not d.eof:
            piece = self.chunk(pos)
            if not piece:
                raise ValueError("the member is cut off")
            try:
                out.append(d.decompress(piece))
            except zlib.error as e:
                raise ValueError(str(e)) from e
            pos += len(piece) - len(d.unused_data)
            if sum(map(len, out[:1])) >= len(VERSION) and not out[0].startswith(VERSION):
                raise ValueError("the member holds no record")
        return b"".join(out), pos

    def plain(self, at: int) -> tuple[bytes, int]:
        """The bytes of the plain record at an offset as far as its length header says."""
        head, pos = b"", at
        while (stop := head.find(b"\r\n\r\n")) < 0 and len(head) < WINDOW and (piece := self.chunk(pos)):
            head, pos = head + piece, pos + len(piece)
        lengths = [x.partition(b":")[2].strip() for x in head[: max(stop, 0)].split(b"\r\n") if x.lower().startswith(b"content-length:")]
        if not lengths or not lengths[0].isdigit() or at + stop + 8 + int(lengths[0]) > self.size:
            raise ValueError("no usable length")
        end = at + stop + 8 + int(lengths[0])
        return head[: end - at] if len(head) >= end - at else head + self.read(at + len(head), end - at - len(head)), end

    def candidates(self, at: int) -> Iterator[int]:
        """Offsets from at on where a member or version line may start."""
        while at < self.size:
            data = self.read(at, WINDOW)
            found = sorted(p for mark in (MAGIC, VERSION) for p in _all(data, mark))
            yield from (at + p for p in found)
            at += max(1, len(data) - len(VERSION) + 1) if at + len(data) < self.size else len(data) or 1

    def one(self, at: int) -> tuple[list[tuple[int, dict, bytes]], int]:
        start = self.chunk(at)[: len(VERSION)]
        if start.startswith(MAGIC):
            data, end = self.member(at)
        elif start == VERSION:
            data, end = self.plain(at)
        else:
            raise ValueError("neither a member nor a version line")
        found, pos = [], 0
        while pos < len(data):
            headers, block, pos = parse(data, pos)
            found.append((at, headers, block))
        if not found:
            raise ValueError("the member is empty")
        return found, end

    def run(self) -> Iterator[tuple]:
        """('record', offset, end, headers, block) or ('gap', offset, end, reason, None)."""
        at = 0
        while at < self.size:
            try:
                found, end = self.one(at)
            except (ValueError, UnicodeDecodeError) as e:
                reason, end, found = str(e), self.size, []
                for p in self.candidates(at + 1):
                    try:
                        found, after = self.one(p)
                    except (ValueError, UnicodeDecodeError):
                        continue
                    end = p
                    break
                yield "gap", at, end, reason, None
                if not found:
                    return
                at, end = end, after
            for offset, headers, block in found:
                yield "record", offset, end, headers, block
            at = end


def _all(data: bytes, mark: bytes) -> Iterator[int]:
    p = data.find(mark)
    while p >= 0:
        yield p
        p = data.find(mark, p + 1)


def originals(payloads: DataFrame) -> DataFrame:
    """digest, refers_to (the smallest id) of each digest that several rows (page_id, digest) have."""
    return payloads.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


def write_warc(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, min_bytes: int = 100, file_bytes: int = 256 << 20, date: str = "2024-01-01T00:00:00Z", level: int = 4
) -> DataFrame:
    """Write a record per row of pages; a manifest row (file, records, bytes) per archive.

    Nulls: a null payload is empty and so a response; a null id is a response and no target; a
    null url is written empty. Ties: each row has a record of its own, judged by its id and its
    payload; rows that repeat both become responses of the same name when the id is the
    smallest, revisits of it otherwise. An empty table writes no archive. Payloads of any
    length are written whole. Other columns are ignored.
    """
    make_folder(folder)
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("sha256", F.sha2("payload", 256)).withColumn("digest", F.when((F.octet_length("payload") >= min_bytes) & F.col("page_id").isNotNull(), F.col("sha256")))
    first = originals(staged(p.where("digest is not null").select("page_id", "digest"), "payload-digests"))
    p = left_join(p, first, "digest").select("page_id", "url", "payload", "sha256", F.when(F.col("page_id") != F.col("refers_to"), F.col("refers_to")).alias("ref"))

    def run(batches):
        out, done = None, []

        def close():
            out[0].close()
            done.append((out[1], out[2], out[3]))

        for batch in batches:
            for page_id, url, payload, digest, ref in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if out is None:
                    name = f"{folder}/{attempt_name('pages')}-{len(done):04d}.warc.gz"
                    fs, path = open_path(name)
                    out = [fs.open_output_stream(path, compression=None, buffer_size=1 << 20), name, 0, 0]
                raw = record("response" if ref is None else "revisit", page_id, url or "", payload, digest, ref, date)
                c = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = c.compress(raw) + c.flush()
                out[0].write(data)
                out[2], out[3] = out[2] + 1, out[3] + len(data)
                if out[3] >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], ["file", "records", "bytes"])

    return staged(map_batches(p, run, "file string, records long, bytes long"), "warc-manifest")


RECORDS = "file string, offset long, end long, gap string, headers map<string,string>, block binary"


def read_warc(files: DataFrame) -> DataFrame:
    """Every record and every quarantined gap of the archives in column ``file``.

    For a record ``gap`` is null; for a gap it is the reason of the first failed check, and
    headers and block are null.
    """
    n = max(1, min(files.count(), 100_000))

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                fs, path = open_path(name)
                with fs.open_input_file(path) as f:
                    for kind, at, end, what, block in Salvage(lambda o, k: f.read_at(k, o) if o < f.size() else b"", f.size()).run():
                        rows.append((name, at, end, what if kind == "gap" else None, None if kind == "gap" else list(what.items()), block))
                        held += len(block or b"")
                        if held > 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["file", "offset", "end", "gap", "headers", "block"])

    return map_batches(files.select("file").repartition(n), run, RECORDS)


def gaps(records: DataFrame) -> DataFrame:
    """The log of quarantined bytes."""
    return records.where("gap is not null").select("file", "offset", "end", F.col("gap").alias("reason"))


def page_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of pages' records.

    A response's size and digest are taken from the payload as read; a revisit's from the
    HTTP and WARC headers that its record carries.
    """
    r = records.where("gap is null")
    cut = F.locate("\r\n\r\n", F.decode("block", "ISO-8859-1"))
    number = lambda name: F.regexp_extract(F.col("headers")[name], r"urn:x-page:(-?\d+)", 1)
    r = r.withColumn("cut", cut).withColumn("payload", F.expr("substring(block, cut + 4)"))
    full = F.col("headers")["warc-type"] == "response"
    return r.select(
        F.expr("try_cast(regexp_extract(headers['warc-record-id'], 'urn:x-page:(-?[0-9]+)', 1) as bigint)").alias("page_id"),
        F.when(full, F.octet_length("payload").cast("long")).otherwise(F.regexp_extract(F.decode("block", "ISO-8859-1"), r"(?i)content-length: (\d+)", 1).cast("long")).alias("payload_bytes"),
        F.when(full, F.sha2("payload", 256)).otherwise(F.regexp_extract(F.col("headers")["warc-payload-digest"], "sha256:([0-9a-f]+)", 1)).alias("payload_digest"),
        F.col("headers")["warc-type"].alias("record_type"),
        F.when(~full, number("warc-refers-to").cast("long")).alias("refers_to"),
    )


def warc_round_trip(pages: DataFrame, *, folder: str | None = None, **kw) -> DataFrame:
    """Write pages as archives, salvage-read the archives and return what they hold."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    return page_records(read_warc(write_warc(pages, folder, **kw)))
