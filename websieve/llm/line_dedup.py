"""Line dedup: explode normalised lines, hash, count distinct documents, drop, reassemble.

Only (line hash, document, position) rows of long lines are shuffled for counting. The hash is
128 bits wide, as lines of a large corpus collide in 64. A line that a third of all documents
hold is counted in two steps, first per (hash, document) and then per hash with partial sums.
The verdicts are a table of their own, so that joining them back is a sort-merge join between
two plain shuffles, whose hot side adaptive execution can split.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import keyed, left_join, map_batches, staged, text_bytes


def _code_points(line: bytes) -> int:
    return len(line) if line.isascii() else len(line.decode("utf-8", "replace"))


def line_keys(d: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, own (a hash of the text), pos, key of each line whose key has at least min_chars code points."""

    def run(batches):
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            ids, pos, counts, found = batch.column(0), [], [], []
            for text in text_bytes(batch.column(1)):
                n = 0
                if len(text) >= min_chars:
                    for i, line in enumerate(text.split(b"\n")):
                        if len(line) >= min_chars:
                            key = line.strip().lower()  # bytes: ASCII white space and A-Z only
                            if len(key) >= min_chars and (len(key) >= 4 * min_chars or _code_points(key) >= min_chars):
                                pos.append(i)
                                found.append(digest(key))
                                n += 1
                counts.append(n)
            rows = pa.array([k for k, n in enumerate(counts) for _ in range(n)], pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(rows), batch.column(2).take(rows), pa.array(pos, pa.int32()), pa.array(found, pa.binary())], ["doc_id", "own", "pos", "key"])

    return map_batches(d, run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, own long, pos int, key binary")


def doomed_lines(d: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """doc_id, own and the sorted positions that this text of the document loses."""
    keys = staged(line_keys(d, min_chars), "line-keys")
    common = staged(
        keys.groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
        .groupBy("key").agg(F.count("one").alias("docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("docs") >= min_docs).select("key", "keeper"),
        "common-lines",
    )
    lost = keys.join(common, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id", "own").agg(F.sort_array(F.collect_set("pos")).alias("lost"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, text (without the dropped lines), n_lines (before), n_dropped for each document.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at
    least min_chars code points in at least min_docs documents keep their lines only in the
    largest doc_id that holds them; there all repeats stay.

    Nulls: a null or empty text is one empty line. A row with a null id keeps all its lines and
    counts for no key. Ties: rows that repeat an id are one document for counting, but each row
    loses only its own doomed lines; rows are told apart by id and a hash of the text. An empty
    table gives an empty result. Texts of any length are read whole. Other columns are ignored.
    """
    d = keyed(docs, id_col, text_col).withColumn("own", F.xxhash64("text"))
    lost = doomed_lines(d.where(F.col("doc_id").isNotNull()), min_chars, min_docs)
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    left = F.expr("array_except(sequence(0, size(lines) - 1), lost)")
    return (
        left_join(d, lost, "doc_id", "own").withColumn("lines", lines)
        .select(
            "doc_id",
            F.when(F.col("lost").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")).alias("text"),
            F.size("lines").cast("long").alias("n_lines"),
            F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost")).cast("long").alias("n_dropped"),
        )
    )
