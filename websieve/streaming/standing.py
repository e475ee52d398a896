"""Standing queries over packets as they arrive, and streaming dedup."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..operators.standing import Standing, Stats
from ..plans.compiler import Context

RESOURCE = "seq bigint, uri string, request map<string,string>, response map<string,string>, data binary"


def tail_packets(spark: SparkSession, path: str, *, schema: str = RESOURCE, files_per_batch: int = 16, format: str = "parquet") -> DataFrame:
    """New files of resource rows below a path, some files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").format(format).load(path)


class StandingStream:
    """Micro-batches of pages against workspace queries that are read anew for each batch.

    load gives the active workspaces' texts; sink takes (matches, batch id). A query whose
    measured mean cost a page exceeds the budget is left out, and cheaper queries run first.
    """

    def __init__(self, load: Callable[[], dict[str, str]], sink: Callable[[DataFrame, int], None], build: Callable[[DataFrame], DataFrame], settings: Settings = Settings(), ctx: Context | None = None):
        self.load, self.sink, self.build, self.settings, self.ctx = load, sink, build, settings, ctx or Context()
        self.stats: dict[str, Stats] = {}
        self.batches = 0

    def run_batch(self, resources: DataFrame, batch_id: int) -> None:
        standing = Standing(self.load(), self.ctx, self.stats)
        pages = self.build(resources).persist()
        try:
            n = pages.count()
            began = time.perf_counter()
            hits = standing.fan_out(pages, budget_ms=self.settings.query_budget_ms).persist()
            found = {r.workspace_id: r["count"] for r in hits.groupBy("workspace_id").count().collect()}
            ms = 1000 * (time.perf_counter() - began)
            ran = standing.ordered(self.settings.query_budget_ms)
            weights = {k: max(1.0, standing.compiled[k].max_cost) for k in ran}
            for k in ran:
                self.stats.setdefault(k, Stats()).add(n, found.get(k, 0), ms * weights[k] / sum(weights.values()))
            self.sink(hits, batch_id)
            hits.unpersist()
            self.batches += 1
        finally:
            pages.unpersist()

    def start(self, resources: DataFrame, checkpoint: str, *, available_now: bool = False) -> StreamingQuery:
        writer = resources.writeStream.foreachBatch(self.run_batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def recent_distinct(stream: DataFrame, key: str, time_col: str, within: str) -> DataFrame:
    """A stream's rows without those whose key came within a time before; the state is bounded
    by that time, where a batch would bound it by a count."""
    return stream.withWatermark(time_col, within).dropDuplicatesWithinWatermark([key])


def write_lines(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Rows as text lines, tab-separated."""
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in stream.columns)).alias("value")
    return stream.select(line).writeStream.format("text").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
