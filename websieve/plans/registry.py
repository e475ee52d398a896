"""The predicates a query can name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column

from ..errors import QueryError
from .nodes import Leaf

RESULT, TEXT, STREAM = "result", "text", "stream"


@dataclass(frozen=True)
class Match:
    """What a predicate compiles to: a condition, and the tags a page gets if it holds."""

    when: Column
    tags: Column | None = None


@dataclass(frozen=True)
class Predicate:
    """A registered predicate.

    build(leaf, context) gives a Match. ``needs`` names derived columns that the planner adds
    only if a query uses them; ``stateful`` predicates look at rows in order. A predicate
    reduces what passes, unless its argument is blank and ``blank_reduces`` says otherwise.
    """

    name: str
    build: Callable[[Leaf, object], Match]
    cost: float
    inputs: frozenset[str]
    form: str
    about: str
    functional: bool = False
    needs: frozenset[str] = frozenset()
    stateful: bool = False
    blank_reduces: bool = True
    hidden: bool = False
    check: Callable[[Leaf], None] | None = field(default=None)


_BY_NAME: dict[str, Predicate] = {}


def page_filter(name: str, *, cost: float, inputs: tuple[str, ...], form: str, about: str, **more):
    """Decorator that registers a builder under a name; the name ends where ':' or '(' starts."""

    def register(build):
        _BY_NAME[name] = Predicate(name, build, cost, frozenset(inputs), form, about, needs=frozenset(more.pop("needs", ())), **more)
        return build

    return register


def find(name: str) -> Predicate:
    if name not in _BY_NAME:
        raise QueryError(f"no filter is called {name!r}")
    return _BY_NAME[name]


def reduces(leaf: Leaf) -> bool:
    return bool(leaf.arg.strip()) or find(leaf.name).blank_reduces


def listing(include_hidden: bool = False) -> list[Predicate]:
    return [p for _, p in sorted(_BY_NAME.items()) if include_hidden or not p.hidden]
