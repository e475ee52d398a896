"""Syntax tree of a page query."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Leaf:
    """One predicate. ``key`` holds what stands in parentheses after the name, if anything."""

    name: str
    arg: str
    key: str | None = None
    negated: bool = False

    @property
    def head(self) -> str:
        return self.name if self.key is None else f"{self.name}({self.key})"

    def text(self) -> str:
        """Query text; an argument with blanks is quoted."""
        if not self.name:
            body = f'"{self.arg}"' if any(c.isspace() for c in self.arg) or self.arg.lower() in ("and", "or") else self.arg
        else:
            body = f"{self.head}:{self.arg or ('*' if self.key is not None else '')}"
            body = f'"{body}"' if any(c.isspace() for c in body) else body
        return ("-" if self.negated else "") + body


@dataclass(frozen=True)
class Either:
    """left OR right; excludes only if both sides do."""

    left: Leaf | Either
    right: Leaf | Either

    @property
    def negated(self) -> bool:
        return self.left.negated and self.right.negated

    def text(self) -> str:
        return f"{self.left.text()} OR {self.right.text()}"


Node = Leaf | Either


@dataclass(frozen=True)
class PageQuery:
    """A conjunction of filters, and the taggers that label what passes."""

    filters: tuple[Node, ...] = ()
    taggers: tuple[Leaf, ...] = ()
    source: str = field(default="", compare=False)

    def text(self) -> str:
        """Canonical text: filters in order, then taggers; parses back to an equal query."""
        tags = []
        for t in self.taggers:
            body = f"{t.head}::{t.arg or '*'}"
            tags.append(f'"{body}"' if any(c.isspace() for c in body) else body)
        return " ".join([*(f.text() for f in self.filters), *tags])


def leaves(node: Node) -> list[Leaf]:
    return [node] if isinstance(node, Leaf) else leaves(node.left) + leaves(node.right)
