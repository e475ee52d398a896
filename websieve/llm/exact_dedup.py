"""Exact dedup with a heavy-hitter split, in DataFrame and SQL functions only.

1. One pass computes the digest of each normalised text; (id, digest) becomes a stage table,
   so texts are never shuffled.
2. A Misra-Gries style frequent-items sketch (``approx_top_k``) proposes at most ``winners``
   digests. An exact count over the stage table, combined before its shuffle, verifies them.
3. Verified winners, at most ``winners`` rows whatever the input, are broadcast, and their
   copies are decided map-side. The other digests are counted with partial sums before an
   ordinary shuffle; only groups of several rows are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import fresh_name, keyed, one_of_each, staged

SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    d = keyed(docs, id_col, text_col)
    return d.select("doc_id", F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, winners: int = 256, tracked: int = 8192) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs.

    Nulls: a null text is empty; a null id never becomes keep_id while its group has another
    id, and in a group of null ids every row has keep_id null and is kept. Ties: rows that
    repeat an id and its text share one verdict. An empty table gives an empty result. Texts
    of any length are hashed whole. Other columns are ignored.
    """
    d = staged(digests(docs, id_col, text_col), "digests")
    proposed = d.select(F.expr(f"approx_top_k(text_sha256, {winners}, {tracked})").alias("top")).select(F.explode("top.item").alias("text_sha256"))
    top = F.broadcast(staged(
        d.join(F.broadcast(proposed), "text_sha256").groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"),
        "winners",
    ))
    heavy = d.join(top, "text_sha256")
    rest = d.join(top, "text_sha256", "left_anti")
    groups = rest.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    rest = rest.join(groups, "text_sha256", "left").withColumns({"keep_id": F.coalesce("keep_id", "doc_id"), "group_size": F.coalesce("group_size", F.lit(1))})
    cols = ("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return heavy.select(*cols).unionByName(rest.select(*cols))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """docs with one row of each group of equal texts, the one with the smallest id.

    Nulls: a null text is empty; a null id is larger than any other. Ties: of rows that repeat
    an id and its text one stays; rows that repeat an id with other texts are judged apart. An
    empty table stays empty. Only digests and ids of groups are joined with the rows.
    """
    digest = fresh_name(docs, "text_sha256")
    groups = staged(exact_dedup(docs, id_col, text_col, **kw).where("group_size > 1"), "groups")
    rows = docs.withColumn(digest, F.sha2(normalised(F.col(text_col)).cast("binary"), 256))
    names = fresh_name(rows, "gone_digest"), fresh_name(rows, "gone_id")
    gone = groups.where("not kept").select("text_sha256", "doc_id").distinct().toDF(*names).hint("merge")  # grows with the input
    rows = rows.join(gone, (F.col(digest) == F.col(names[0])) & F.col(id_col).eqNullSafe(F.col(names[1])), "left_anti")
    again = groups.where("kept").groupBy("text_sha256").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("text_sha256")
    return one_of_each(rows, digest, again).select(*docs.columns)
