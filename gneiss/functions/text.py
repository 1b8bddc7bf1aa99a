"""Text as column expressions. Patterns begin with (?U), so that white space and digits are those of Unicode."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def holds(c: Column, needle: str | None) -> Column:
    """Whether ``c`` holds ``needle`` apart from case; ``%`` and ``_`` in it match as in LIKE. No needle holds always, NULL never."""
    if not needle:
        return F.lit(True)
    return F.lower(c).like("%" + needle.lower().replace("\\", "\\\\") + "%")


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def first_match(c: Column, table: list[tuple[str, str]]) -> Column:
    """The value of the first key of ``table`` that ``c`` holds; NULL without one."""
    return F.coalesce(*[F.when(c.contains(k), F.lit(v)) for k, v in table], F.lit(None).cast("string"))


def folded(c: Column) -> Column:
    """Lower case with plain quotes and dashes, no soft hyphens, single spaces."""
    return F.lower(collapse(F.translate(c, "’‘“”—–­", "''\"\"--")))


def line_key(c: Column) -> Column:
    """A line's letters a to z in lower case with single spaces: the same for a head on every page."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)\d+", ""), "[^a-z]+", " "))


def is_page_number(c: Column) -> Column:
    return F.lower(strip(c)).rlike(r"(?U)^(?:page\s*)?\d{1,4}$")


def shortened(c: Column, width: int = 46) -> Column:
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 3), F.lit("..."))).otherwise(c)


def citation(source: Column, page: Column) -> Column:
    return F.concat(source, F.lit(" p."), page.cast("string"))


def labelled(c: Column, missing: str = "(unknown)") -> Column:
    """``missing`` for NULL and empty values, so that both are one group."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(missing))
