"""Packets: XML files of crawled resources, gzip or plain by content, whatever their name.

``<resources><startTime/> <resource><request/><response><header/><data/></response>
<exception/></resource>* <endTime/></resources>``, data in base64.
"""

from __future__ import annotations

import base64
import gzip
import io
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columnar import columnar

ROW = "file string, pos long, request string, header string, data binary, exception string, error string"
FILE = "path string, modificationTime timestamp, length long, content binary"
_SAFE = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"


def is_gzip(head: bytes) -> bool:
    return head[:2] == b"\x1f\x8b" and len(head) >= 10 and head[2] == 8


def resources_of(content: bytes, most: int | None = None) -> Iterator[tuple]:
    """(pos, request, header, data, exception, error); what is cut off or broken ends the packet
    with a row that holds only the error, and so does a packet's ``most`` resources, if given."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(content)) if is_gzip(content[:16]) else io.BytesIO(content)
    pos, parser = 0, ElementTree.XMLPullParser(events=("start", "end"))
    stack: list = []
    try:
        while chunk := stream.read(1 << 16):
            parser.feed(chunk)
            for what, e in parser.read_events():
                if what == "start":
                    stack.append(e)
                    continue
                stack.pop()
                if e.tag == "resource":
                    data = e.findtext("response/data")
                    yield pos, e.findtext("request"), e.findtext("response/header"), base64.b64decode(data) if data else None, e.findtext("exception"), None
                    pos += 1
                    if stack:
                        stack[-1].remove(e)
                    if most is not None and pos >= most:
                        raise ValueError(f"only the first {most} resources were read")
        parser.close()
    except (ElementTree.ParseError, EOFError, zlib.error, OSError, ValueError) as error:
        yield pos, None, None, None, None, f"{type(error).__name__}: {error}"


def read_packets(spark: SparkSession, path: str | list[str], *, glob: str | None = None, recursive: bool = True, keep_errors: bool = False, most: int | None = None) -> DataFrame:
    """Rows file, pos, request, header, data, exception of all packets below a path.

    Packets are parsed where Spark reads them. A packet's rows up to a defect are kept; with
    keep_errors a row tells what the defect was. ``most`` resources are read of a packet, all
    by default; a row of keep_errors tells where some are left out.
    """
    reader = _options(spark.read, glob, recursive)
    return parsed(reader.load(path), keep_errors, most)


def stream_packets(spark: SparkSession, path: str, *, glob: str | None = None, recursive: bool = True, keep_errors: bool = False, most: int | None = None, files_per_batch: int = 16) -> DataFrame:
    """The same rows of packets as they arrive below a path, some files at a time."""
    reader = _options(spark.readStream, glob, recursive).schema(FILE).option("maxFilesPerTrigger", files_per_batch)
    return parsed(reader.load(path), keep_errors, most)


def _options(reader, glob: str | None, recursive: bool):
    reader = reader.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.option("pathGlobFilter", glob) if glob else reader


def parsed(files: DataFrame, keep_errors: bool, most: int | None) -> DataFrame:
    """Packet rows of files (path, content)."""
    files = files.select("path", "content")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows, held = [], 0
                for row in resources_of(content.as_py(), most):
                    rows.append((name.as_py(), *row))
                    held += len(row[3] or b"")
                    if held > 8 << 20:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)

    def _rows(rows):
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["file", "pos", "request", "header", "data", "exception", "error"])

    found = files.mapInArrow(run, ROW)
    return found if keep_errors else found.where("error is null").drop("error")


def read_plain_packets(spark: SparkSession, path: str) -> DataFrame:
    """The same rows, by Spark's XML source; for files whose name tells how they are packed."""
    schema = "request string, response struct<header:string,data:string>, exception string"
    df = spark.read.format("xml").option("rowTag", "resource").schema(schema).load(path)
    return df.select(F.col("_metadata.file_path").alias("file"), "request", F.col("response.header").alias("header"), F.unbase64("response.data").alias("data"), "exception")


def write_packets(resources: DataFrame, path: str, *, per_packet: int = 100_000, mode: str = "error") -> None:
    """Gzip XML packets of at most per_packet resources with unique names."""
    text = lambda c: F.regexp_replace(c, _SAFE, "")
    rows = resources.select(text(F.col("request")).alias("request"), F.struct(text(F.col("header")).alias("header"), F.base64("data").alias("data")).alias("response"), text(F.col("exception")).alias("exception"))
    (
        rows.write.format("xml").option("rowTag", "resource").option("rootTag", "resources").option("compression", "gzip")
        .option("maxRecordsPerFile", per_packet).mode(mode).save(path)
    )


@columnar("binary")
def gunzip(data: pd.Series) -> pd.Series:
    """Unpacked bytes where they are gzip, else the bytes themselves."""
    return pd.Series([gzip.decompress(d) if d is not None and is_gzip(d[:16]) else d for d in data], dtype=object)


@columnar("binary")
def gzipped(data: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else gzip.compress(d, mtime=0) for d in data], dtype=object)
