"""Small scalar, array and map functions over Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make_tag(c: Column) -> Column:
    return F.replace(F.trim(c), F.lit(" "), F.lit("_"))


def make_tags(c: Column) -> Column:
    return F.transform(c, make_tag)


def truncate(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))


def fragment(c: Column, at: Column, size: Column, margin: int) -> Column:
    """The characters around [at, at + size), at counting from 1."""
    start = F.greatest(at - margin, F.lit(1))
    return c.substr(start, at + size + margin - start)


def chop(c: Column, mark: str) -> Column:
    """What stands before the first mark."""
    return F.substring_index(c, mark, 1)


def reduce_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_input(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\w\-]", "")


def clean_for_xml(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", "")


def wildcard(c: Column, pattern: str) -> Column:
    """Whole-value match with * and ?."""
    body = "".join(".*" if p == "*" else "." if p == "?" else "\\Q" + p + "\\E" for p in pattern)
    return c.rlike(f"(?s)^{body}$")


def distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def constrain(c: Column, least=None, most=None) -> Column:
    c = c if least is None else F.greatest(c, F.lit(least))
    return c if most is None else F.least(c, F.lit(most))


def any_flag(c: Column, mask: int) -> Column:
    return c.bitwiseAND(F.lit(mask)) != 0


def pad_left(c: Column, n: int, value) -> Column:
    return F.concat(F.array_repeat(F.lit(value), F.greatest(F.lit(n) - F.size(c), F.lit(0))), c)


def pad_right(c: Column, n: int, value) -> Column:
    return F.concat(c, F.array_repeat(F.lit(value), F.greatest(F.lit(n) - F.size(c), F.lit(0))))


def safe_get(c: Column, key: str) -> Column:
    return F.try_element_at(c, F.lit(key))


def private_address(ip: Column) -> Column:
    """Missing, loopback, private, zero and broadcast addresses."""
    return ip.isNull() | ip.rlike(r"^(127|10|0|255)\.|^192\.168\.") | (ip == "255.255.255.255")


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    p = F.split(ip, r"\.")
    value = sum((F.try_element_at(p, F.lit(k + 1)).try_cast("bigint") * 256 ** (3 - k) for k in range(1, 4)), F.try_element_at(p, F.lit(1)).try_cast("bigint") * 256**3)
    return F.when(F.size(p) == 4, value)


def next_fetch_due(last: Column, days: int) -> Column:
    return F.date_add(last, days)


def words(text: Column) -> Column:
    """Runs of letters and marks, without symbols, digits and punctuation."""
    return F.filter(F.split(text, r"[^\p{L}\p{M}]+"), lambda w: w != "")


def tag_text(tags: Column) -> Column:
    return F.array_join(tags, " ")


def text_tags(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda t: t != "")
