"""From a query tree to DataFrame operations.

Stateless predicates become conjuncts in cost order, so that generated code tests cheap ones
first; scans of Parquet get what can be pushed down. Python only runs for derived columns that
a query needs. Order-dependent predicates are stages of their own, after every cheaper one, as
a page rejected earlier must not enter their memory.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..operators import filters as _filters  # noqa: F401  registers every predicate
from ..operators.filters import window_field, window_size
from . import registry
from .nodes import Either, Leaf, Node, PageQuery, leaves
from .parser import parse
from .registry import Match

EXCLUDE_WEIGHT, MAX_DEPTH = 1000, 10


@dataclass
class Context:
    """What queries may refer to besides the page's own columns."""

    workspaces: dict[str, str] = field(default_factory=dict)
    measured_cost: dict[str, float] = field(default_factory=dict)
    models: dict = field(default_factory=dict)
    geo: DataFrame | None = None
    seed: int = 0
    suppress_repeats: bool = False
    order_col: str = "seq"


@dataclass(frozen=True)
class SubQuery:
    """Another workspace's query in place of query(key)."""

    key: str
    query: PageQuery
    negated: bool
    parts: tuple


def inline(query: PageQuery, ctx: Context, depth: int = 0) -> list:
    """Filters with sub-queries in place; unknown keys vanish, too deep nesting is an error."""
    if depth > MAX_DEPTH:
        raise QueryError(f"queries are nested deeper than {MAX_DEPTH}")

    def place(node: Node):
        if isinstance(node, Either):
            left, right = place(node.left), place(node.right)
            return (left, right, node.negated) if left is not None and right is not None else left or right
        if node.name != "query":
            return node
        text = ctx.workspaces.get((node.key or "").strip())
        if text is None:
            return None
        own = parse(text)
        return SubQuery(node.key, own, node.negated, tuple(inline(own, ctx, depth + 1)))

    return [p for p in map(place, query.filters) if p is not None]


def all_leaves(part) -> list[Leaf]:
    if isinstance(part, Leaf):
        return [part]
    if isinstance(part, SubQuery):
        return [x for p in part.parts for x in all_leaves(p)] + list(part.query.taggers)
    return all_leaves(part[0]) + all_leaves(part[1])


def is_negated(part) -> bool:
    return part[2] if isinstance(part, tuple) else part.negated


def cost_of(part, ctx: Context) -> float:
    if isinstance(part, SubQuery):
        return ctx.measured_cost.get(part.key, sum(cost_of(p, ctx) for p in part.parts))
    if isinstance(part, tuple):
        return cost_of(part[0], ctx) + cost_of(part[1], ctx)
    return registry.find(part.name).cost


def weight(part, ctx: Context) -> float:
    return cost_of(part, ctx) * (EXCLUDE_WEIGHT if is_negated(part) else 1)


def no_tags() -> Column:
    return F.array().cast("array<string>")


def match(part, ctx: Context) -> Match:
    """Condition without the part's own sign, and tags."""
    if isinstance(part, Leaf):
        return registry.find(part.name).build(part, ctx)
    if isinstance(part, SubQuery):
        return Match(condition(part.parts, ctx), tags_of(part.query.taggers, ctx))
    left, right = match(part[0], ctx), match(part[1], ctx)
    tags = F.when(left.when, left.tags if left.tags is not None else no_tags()).otherwise(right.tags if right.tags is not None else no_tags())
    return Match(left.when | right.when, tags)


def condition(parts, ctx: Context) -> Column:
    """All parts hold, each by its sign; nothing holds without parts."""
    if not parts:
        return F.lit(False)
    ordered = sorted(parts, key=lambda p: weight(p, ctx))
    return reduce(lambda a, b: a & b, (~match(p, ctx).when if is_negated(p) else match(p, ctx).when for p in ordered))


def tags_of(taggers, ctx: Context) -> Column:
    """Tags of all taggers that match, in declaration order, each once."""
    found = []
    for t in taggers:
        m = match(t, ctx)
        if m.tags is not None:
            found.append(F.when(m.when, m.tags).otherwise(no_tags()))
    return F.array_distinct(F.array_compact(F.concat(*found))) if found else no_tags()


@dataclass
class Compiled:
    """A query ready to apply to page tables."""

    query: PageQuery
    ctx: Context

    @cached_property
    def parts(self) -> list:
        parts = sorted(inline(self.query, self.ctx), key=lambda p: weight(p, self.ctx))
        for p in parts:
            if not isinstance(p, Leaf) and any(registry.find(x.name).stateful for x in all_leaves(p)):
                raise QueryError("an order-dependent filter can't stand in an OR or a sub-query")
        return parts

    @cached_property
    def leaves(self) -> list[Leaf]:
        subs = [x for p in self.parts for x in all_leaves(p)]
        return subs + list(self.query.taggers)

    @property
    def inputs(self) -> frozenset[str]:
        return frozenset().union(*(registry.find(x.name).inputs for x in self.leaves))

    @property
    def needs(self) -> set[str]:
        return set().union(*(registry.find(x.name).needs for x in self.leaves))

    @property
    def max_cost(self) -> float:
        """Estimated cost of a page that every filter and tagger looks at."""
        return sum(weight(p, self.ctx) for p in self.parts) + sum(registry.find(t.name).cost for t in self.query.taggers)

    @property
    def stateful(self) -> bool:
        return any(self._keeps_state(p) for p in self.parts)

    def _keeps_state(self, part) -> bool:
        if not isinstance(part, Leaf):
            return False
        return registry.find(part.name).stateful or (self.ctx.suppress_repeats and not part.negated and part.name in ("", "regex"))

    def condition(self) -> Column:
        """The filters as one condition; only for queries without order-dependent stages."""
        if self.stateful:
            raise QueryError("this query depends on the order of pages and has no single condition")
        return condition(self.parts, self.ctx)

    def tags(self) -> Column:
        return tags_of(self.query.taggers, self.ctx)

    def apply(self, pages: DataFrame, *, tag_col: str = "query_tags") -> DataFrame:
        """Pages that the query includes, with their new tags in tag_col."""
        from ..operators.derive import with_needs
        from ..operators.windows import distinct_window, suppress_repeats

        df = with_needs(pages, self.needs, self.leaves, self.ctx)
        if not self.parts:
            return df.where(F.lit(False)).withColumn(tag_col, no_tags())
        plain: list = []
        for part in self.parts:
            if not self._keeps_state(part):
                plain.append(part)
                continue
            if plain:
                df, plain = df.where(condition(plain, self.ctx)), []
            if part.name == "distinct-window":
                df = distinct_window(df, window_field(part.key), window_size(part), self.ctx.order_col, exclude=part.negated)
            else:
                df = suppress_repeats(df.where(match(part, self.ctx).when), part, self.ctx.order_col)
        if plain:
            df = df.where(condition(plain, self.ctx))
        return df.withColumn(tag_col, self.tags())


def only_reducing(query: PageQuery) -> PageQuery:
    """The query without filters that let everything with a value pass; an OR stays for either side."""
    return replace(query, filters=tuple(f for f in query.filters if any(map(registry.reduces, leaves(f)))))


def compile_query(text: str | PageQuery, ctx: Context | None = None, *, reducing: bool = False) -> Compiled:
    """A query ready to apply; with ``reducing``, of its filters only those that reduce what passes."""
    query = text if isinstance(text, PageQuery) else parse(text)
    query = only_reducing(query) if reducing else query
    compiled = Compiled(query, ctx or Context())
    compiled.parts  # noqa: B018  raises what is wrong with the query now
    return compiled


def distill(results: DataFrame, text: str, ctx: Context | None = None) -> DataFrame:
    """Filter stored results; queries that need page text or bytes are refused."""
    compiled = compile_query(text, ctx)
    if compiled.inputs & {registry.TEXT, registry.STREAM}:
        raise QueryError("stored results have neither text nor bytes to look at")
    return compiled.apply(results).drop("query_tags")


__all__ = ["Compiled", "Context", "compile_query", "distill", "leaves"]
