"""Best-fit packing of sequences into bins of several permitted lengths.

``pack`` plans by lengths alone; ``pack_texts`` also fills the bins with the texts' ids.

A bin of capacity c costs c plus a fixed overhead. Documents longer than the largest capacity
are cut into pieces of that size, so nothing is dropped. Pieces go, by a hash of id and piece (and row, where ids repeat), to groups of
bounded size; each group is packed on its own, longest piece first, into the open bin that it
leaves the least room in. Where no open bin has room, a bin is opened by a rule, and the rules
compete: one prefers the size with the least cost per token that the group's remaining tokens
can fill; the others prefer each permitted size in turn. Each plan's bins are then downsized
to the least capacity that holds their contents, and the cheapest plan is kept.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import keyed, map_batches, staged, text_bytes


def best_fit(lengths: list[int], capacities: list[int], overhead: int, prefer: int | None) -> tuple[int, list[tuple[int, int]], list[int]]:
    """(cost, (bin, offset) of each length, capacity of each bin) for lengths in falling order."""
    left, rooms, open_bins = sum(lengths), [], {}
    used: list[int] = []
    size: list[int] = []
    places = []
    for n in lengths:
        k = bisect_left(rooms, n)
        if k < len(rooms):
            room = rooms[k]
            own = open_bins[room]
            b = own.pop()
            if not own:
                del open_bins[room], rooms[k]
        else:
            fitting = [c for c in capacities if c >= n]
            if prefer is not None:
                c = prefer if prefer >= n else fitting[0]
            else:
                c = min(fitting, key=lambda c: ((c + overhead) / max(1, min(c, left)), c))
            b, room = len(used), c
            used.append(0)
            size.append(c)
        places.append((b, used[b]))
        used[b] += n
        left -= n
        room -= n
        if room not in open_bins:
            insort(rooms, room)
            open_bins[room] = []
        open_bins[room].append(b)
    final = [capacities[bisect_left(capacities, u)] for u in used]
    return sum(final) + overhead * len(final), places, final


def pack_group(lengths: list[int], capacities: list[int], overhead: int) -> tuple[list[tuple[int, int]], list[int]]:
    """The cheapest plan over all opening rules; of equal ones the first."""
    _, places, sizes = min((best_fit(lengths, capacities, overhead, p) for p in (None, *reversed(capacities))), key=lambda plan: plan[0])
    return places, sizes


def pieces_of(lengths: DataFrame, largest: int) -> DataFrame:
    """doc_id, piece, start, length: each document cut at multiples of the largest capacity."""
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("n") - 1, F.lit(0)) / largest)))
    d = lengths.select("doc_id", F.greatest(F.coalesce(F.col("n"), F.lit(0)).cast("long"), F.lit(0)).alias("n"))
    d = d.select("doc_id", "n", cut.alias("piece")).withColumn("start", F.col("piece") * largest)
    return d.select("doc_id", "piece", "start", F.least(F.col("n") - F.col("start"), F.lit(largest)).alias("length"))


def grouped(p: DataFrame, group_pieces: int) -> DataFrame:
    """The staged pieces with their group g, by a hash of id and piece, and of the row where ids repeat."""
    groups, key = F.lit(max(1, -(-p.count() // group_pieces))), F.xxhash64("doc_id", "piece")
    again = p.groupBy(F.col("doc_id").alias("id2"), F.col("piece").alias("piece2")).agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    if again.isEmpty():
        return p.withColumn("g", F.pmod(key, groups))
    # Rows that repeat an id are told apart by the staged file and their place in it, which a task that runs again finds too.
    own = p.select("*", F.xxhash64("_metadata.file_name", "_metadata.row_index").alias("row"))
    own = own.join(again, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("piece") == F.col("piece2")), "left")
    g = F.pmod(F.when(F.col("times").isNull(), key).otherwise(F.xxhash64("doc_id", "piece", "row")), groups)
    return own.select(*p.columns, g.alias("g"))


#: In this order pieces are packed.
ORDER = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]


def pack(docs: DataFrame, length: Column, id_col: str = "doc_id", *, capacities: tuple[int, ...] = (1024, 2048, 4096, 8192), overhead: int = 32, group_pieces: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, bin_id, capacity, bin_offset, bin_used for each piece.

    ``length`` is an expression over docs. [start, start + length) of the document lies at
    [bin_offset, bin_offset + length) of the bin.

    Nulls: a null or negative length counts as 0, and such a document is one piece of length 0.
    A null id is packed like any other. Ties: equal lengths go by id and piece; rows that
    repeat an id are packed separately. An empty table gives an empty result. Other columns
    are ignored.
    """
    capacities = tuple(sorted(set(capacities)))
    p = grouped(staged(pieces_of(docs.select(F.col(id_col).alias("doc_id"), length.alias("n")), capacities[-1]), "pieces"), group_pieces)
    kind = p.schema["doc_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by(ORDER)
        places, sizes = pack_group(t["length"].to_pylist(), list(capacities), overhead)
        used = [0] * len(sizes)
        for (b, _), n in zip(places, t["length"].to_pylist()):
            used[b] += n
        g = t["g"][0].as_py()
        return pa.table({
            "doc_id": t["doc_id"], "piece": t["piece"], "start": t["start"], "length": t["length"],
            "bin_id": pa.array([f"{g}-{b}" for b, _ in places], pa.string()), "capacity": pa.array([sizes[b] for b, _ in places], pa.int64()),
            "bin_offset": pa.array([o for _, o in places], pa.int64()), "bin_used": pa.array([used[b] for b, _ in places], pa.int64()),
        })

    return p.groupBy("g").applyInArrow(run, f"doc_id {kind}, piece long, start long, length long, bin_id string, capacity long, bin_offset long, bin_used long")


#: Ids of a byte vocabulary: 0 to 255 are bytes, then come the end mark and the padding.
END, PAD = 256, 257
BINS = "bin_id string, capacity long, bin_used long, ids binary, doc_id array<{0}>, piece array<long>, start array<long>, length array<long>, bin_offset array<long>"


def text_pieces(d: DataFrame, largest: int) -> DataFrame:
    """doc_id, piece, start, length, bytes: each text's bytes and end mark, cut at multiples of the largest capacity."""

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for k, text in enumerate(text_bytes(batch.column(1))):
                for piece, start in enumerate(range(0, len(text) + 1, largest)):
                    rows.append((k, piece, start, min(len(text) + 1 - start, largest), text[start : start + largest]))
                    held += len(rows[-1][-1])
                    if held > 4 << 20:
                        yield _pieces(batch, rows)
                        rows, held = [], 0
            if rows:
                yield _pieces(batch, rows)

    def _pieces(batch, rows):
        at, *cols = zip(*rows)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["doc_id", "piece", "start", "length", "bytes"])

    return map_batches(d, run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, piece long, start long, length long, bytes binary")


def pack_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacities: tuple[int, ...] = (1024, 2048, 4096, 8192), overhead: int = 32, group_pieces: int = 4096) -> DataFrame:
    """Packed sequences of whole texts: bin_id, capacity, bin_used, ids, and for each of a bin's pieces doc_id, piece, start, length, bin_offset.

    ids are 16-bit little-endian numbers of a byte vocabulary, as many as the capacity: each
    text's UTF-8 bytes and an end mark, then padding. A group's texts meet in one task, at most
    about group_pieces times the largest capacity.

    Nulls: a null text is empty, so it is the end mark alone; a null id is packed like any
    other. Ties: equal lengths go by id and piece; rows that repeat an id are packed
    separately. An empty table gives an empty result. Other columns are ignored.
    """
    capacities = tuple(sorted(set(capacities)))
    p = grouped(staged(text_pieces(keyed(docs, id_col, text_col), capacities[-1]), "pieces"), group_pieces)

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by(ORDER)
        places, sizes = pack_group(t["length"].to_pylist(), list(capacities), overhead)
        bins, group = [[] for _ in sizes], t["g"][0].as_py()
        ids, used = [np.full(n, PAD, "<u2") for n in sizes], [0] * len(sizes)
        for k, ((b, at), n, data) in enumerate(zip(places, t["length"].to_pylist(), t["bytes"].to_pylist())):
            ids[b][at : at + len(data)] = np.frombuffer(data, np.uint8)
            ids[b][at + len(data) : at + n] = END  # a text's last piece has room for one more than its bytes
            used[b] += n
            bins[b].append(k)
        rows = pa.array([k for own in bins for k in own])
        ends = pa.array(np.cumsum([0, *map(len, bins)]).astype(np.int32))
        offsets = pa.array([places[k][1] for own in bins for k in own], pa.int64())
        lists = [t[c].combine_chunks().take(rows) for c in ("doc_id", "piece", "start", "length")] + [offsets]
        return pa.table({
            "bin_id": pa.array([f"{group}-{b}" for b in range(len(sizes))], pa.string()), "capacity": pa.array(sizes, pa.int64()), "bin_used": pa.array(used, pa.int64()), "ids": pa.array([x.tobytes() for x in ids], pa.binary()),
            **{c: pa.ListArray.from_arrays(ends, v) for c, v in zip(("doc_id", "piece", "start", "length", "bin_offset"), lists)},
        })

    return p.groupBy("g").applyInArrow(run, BINS.format(p.schema["doc_id"].dataType.simpleString()))


def plan_of(bins: DataFrame) -> DataFrame:
    """A row for each piece, as ``pack`` gives it, with bin_sha256, the digest of its bin's ids."""
    zipped = F.arrays_zip("doc_id", "piece", "start", "length", "bin_offset")
    return bins.select("bin_id", "capacity", "bin_used", F.sha2("ids", 256).alias("bin_sha256"), F.inline(zipped))


def packed_sequences(tokens: DataFrame, plan: DataFrame, pad: int = 0) -> DataFrame:
    """bin_id, ids (padded to the capacity), ends (of the pieces) from tokens (doc_id, ids).

    A bin's pieces meet in one task, at most its capacity of tokens.
    """
    cut = plan.where("length > 0").join(tokens, "doc_id").select("bin_id", "capacity", "bin_offset", F.expr("slice(ids, int(start) + 1, int(length))").alias("ids"))
    own = cut.groupBy("bin_id", "capacity").agg(F.sort_array(F.collect_list(F.struct("bin_offset", "ids"))).alias("own"))
    ids = F.flatten("own.ids")
    return own.select(
        "bin_id",
        F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(F.col("capacity").cast("int") - F.size(ids), F.lit(0)))).alias("ids"),
        F.transform("own", lambda x: x["bin_offset"] + F.size(x["ids"])).alias("ends"),
    )
