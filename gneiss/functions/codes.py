"""Designators: from a written token to its base in two scripts. Vocabularies are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gneiss.functions.text import strip

#: Prefixes in the order in which they are tried, and systems that have a name instead of a number.
PREFIXES = [
    ("歼轰", "JH"), ("运油", "YY"), ("空警", "KJ"), ("无侦", "WZ"), ("高新", "GX"), ("攻击", "GJ"), ("教练", "JL"), ("歼", "J"),
    ("轰", "H"), ("运", "Y"), ("直", "Z"), ("强", "Q"), ("教", "JL"), ("苏", "Su"), ("米", "Mi"), ("图", "Tu"),
]
NAMES = [("云影", "Cloud Shadow"), ("翔龙", "Soaring Dragon"), ("神雕", "Divine Eagle"), ("利剑", "Sharp Sword")]


def normalized(token: Column, prefixes: list[tuple[str, str]] = PREFIXES, names: list[tuple[str, str]] = NAMES) -> Column:
    """``struct<raw, cn_base, en_base>`` of a token; unknown tokens keep their text as ``cn_base`` and have no ``en_base``.

    A token is known if it begins with a name, or with Chinese letters that begin with a prefix, then a dash or none, then digits. NULL gives NULL fields.
    """
    raw = strip(token)
    letters = F.regexp_extract(raw, r"(?U)^([一-鿿]+)[-－–]?(\d+)", 1)
    digits = F.regexp_extract(raw, r"(?U)^([一-鿿]+)[-－–]?(\d+)", 2)
    known = [F.when(raw.startswith(n), F.struct(F.lit(n).alias("cn"), F.lit(e).alias("en"))) for n, e in names]
    known += [F.when((digits != "") & letters.startswith(p), F.struct(F.concat(F.lit(p + "-"), digits).alias("cn"), F.concat(F.lit(e + "-"), digits).alias("en"))) for p, e in prefixes]
    base = F.coalesce(*known)
    return F.struct(raw.alias("raw"), F.coalesce(base["cn"], raw).alias("cn_base"), base["en"].alias("en_base"))


def split_cell(cell: Column, prefixes=PREFIXES, names=NAMES) -> Column:
    """All different tokens of a cell, in order, normalized; variants after ``/`` stay with their token."""
    tokens = F.array_distinct(F.filter(F.transform(F.split(cell, "[、，,]|和"), strip), lambda t: t != ""))
    return F.transform(tokens, lambda t: normalized(t, prefixes, names))


def known_only(parts: Column) -> Column:
    return F.filter(parts, lambda p: p["en_base"].isNotNull())
