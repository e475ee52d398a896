"""Many standing queries over one scan of pages."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.compiler import Compiled, Context, compile_query
from .derive import with_needs


@dataclass
class Stats:
    """What running a workspace's query has cost and found so far."""

    evaluated: int = 0
    included: int = 0
    excluded: int = 0
    total_ms: float = 0.0
    max_ms: float = 0.0

    def add(self, evaluated: int, included: int, ms: float) -> None:
        self.evaluated, self.included, self.excluded = self.evaluated + evaluated, self.included + included, self.excluded + evaluated - included
        self.total_ms, self.max_ms = self.total_ms + ms, max(self.max_ms, ms)

    @property
    def average_ms(self) -> float:
        return self.total_ms / self.evaluated if self.evaluated else 0.0


@dataclass
class Standing:
    """A set of workspace queries, compiled together.

    ``fan_out`` gives a row per page and workspace whose query includes it. All queries without
    order-dependent stages share one scan, one text extraction and one pass: their results are
    an array that is exploded. The others run after it, each over its own filtered rows.
    """

    queries: dict[str, str]
    ctx: Context = field(default_factory=Context)
    stats: dict[str, Stats] = field(default_factory=dict)
    compiled: dict[str, Compiled] = field(init=False)

    def __post_init__(self) -> None:
        self.compiled = {k: compile_query(v, self.ctx) for k, v in self.queries.items() if v and v.strip()}

    def ordered(self, budget_ms: float | None = None) -> list[str]:
        """Workspaces cheapest first, without those whose measured mean exceeds the budget."""
        cost = lambda k: (self.stats[k].average_ms if k in self.stats else 0.0, self.compiled[k].max_cost)
        return [k for k in sorted(self.compiled, key=cost) if budget_ms is None or k not in self.stats or self.stats[k].average_ms < budget_ms]

    def fan_out(self, pages: DataFrame, *, budget_ms: float | None = None) -> DataFrame:
        """pages' columns, workspace_id, and tags the page didn't have yet as new_tags."""
        names = self.ordered(budget_ms)
        plain = [k for k in names if not self.compiled[k].stateful]
        leaves = [x for k in names for x in self.compiled[k].leaves]
        needs = set().union(*(self.compiled[k].needs for k in names)) if names else set()
        df = with_needs(pages, needs, leaves, self.ctx)
        own = [c for c in df.columns if not c.startswith("ml_") and (c in pages.columns or c == "lang")]
        struct = lambda k: F.when(self.compiled[k].condition(), F.struct(F.lit(k).alias("workspace_id"), self.compiled[k].tags().alias("new_tags")))
        hits = F.array_compact(F.array(*map(struct, plain))) if plain else F.array().cast("array<struct<workspace_id:string,new_tags:array<string>>>")
        out = df.withColumn("_hits", hits).where(F.size("_hits") > 0).select(*own, F.inline("_hits"))
        for k in (k for k in names if self.compiled[k].stateful):
            own_rows = self.compiled[k].apply(df, tag_col="new_tags").select(*own, F.lit(k).alias("workspace_id"), "new_tags")
            out = out.unionByName(own_rows)
        return out.withColumn("new_tags", F.array_except("new_tags", F.coalesce("tags", F.array().cast("array<string>"))))

    def counters(self, pages: DataFrame) -> DataFrame:
        """workspace_id, evaluated, included, excluded of all queries, in one pass."""
        names = [k for k in self.ordered() if not self.compiled[k].stateful]
        df = with_needs(pages, set().union(*(self.compiled[k].needs for k in names)), [x for k in names for x in self.compiled[k].leaves], self.ctx)
        sums = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(self.compiled[k].condition()).alias(f"q{i}") for i, k in enumerate(names)))
        rows = F.array(*(F.struct(F.lit(k).alias("workspace_id"), F.col("n").alias("evaluated"), F.col(f"q{i}").alias("included"), (F.col("n") - F.col(f"q{i}")).alias("excluded")) for i, k in enumerate(names)))
        return sums.select(F.inline(rows))
