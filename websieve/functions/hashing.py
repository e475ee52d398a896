"""md5 values as lower-case hex, and ranges over them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidRequest

SPACE = 1 << 128


def md5_of(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def try_md5(text: str) -> str | None:
    """The value's normal form, or None if it isn't 32 hex digits."""
    t = text.strip().lower()
    return t if re.fullmatch(r"[0-9a-f]{32}", t) else None


@dataclass(frozen=True)
class HashRange:
    """[least, most], both inclusive. Hex text sorts like the numbers it stands for."""

    least: str = "0" * 32
    most: str = "f" * 32

    def contains(self, c: Column) -> Column:
        return F.lit(True) if self == HashRange() else F.lower(c).between(self.least, self.most)

    def __contains__(self, value: str) -> bool:
        return self.least <= value.lower() <= self.most

    @property
    def size(self) -> int:
        return int(self.most, 16) - int(self.least, 16) + 1

    def coverage(self) -> float:
        return self.size / SPACE

    def split(self, shares: list[float]) -> list[HashRange]:
        """Neighbouring ranges by shares, which have four digits and add up to 1."""
        parts = [round(s * 10_000) for s in shares]
        if not parts or min(parts) <= 0 or sum(parts) != 10_000:
            raise InvalidRequest("shares must be positive and add up to 1")
        start, edges = int(self.least, 16), [0]
        for p in parts:
            edges.append(edges[-1] + p)
        at = [start + self.size * e // 10_000 for e in edges]
        return [HashRange(f"{a:032x}", f"{b - 1:032x}") for a, b in zip(at, at[1:])]
