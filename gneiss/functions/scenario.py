"""Filters that a question in free text asks for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gneiss.functions.codes import normalized

#: Theaters of each place, and what words mean which role, in the order in which they are tried.
PLACES = {
    "taiwan": ["Eastern", "Southern"], "taiwan strait": ["Eastern", "Southern"], "senkaku": ["Eastern"], "east china sea": ["Eastern"],
    "south china sea": ["Southern"], "spratly": ["Southern"], "korea": ["Northern"], "india": ["Western"], "ladakh": ["Western"],
}
ROLE_HINTS = [("fighter", "fighter"), ("bomber", "bomber"), ("uav", "uav"), ("drone", "uav"), ("transport", "transport"), ("tanker", "transport")]


def resolved(query: Column, designator: Column | None = None, theater: Column | None = None, role: Column | None = None, places: dict[str, list[str]] = PLACES, hints: list[tuple[str, str]] = ROLE_HINTS) -> Column:
    """``struct<designator, theaters, role, matched_location>`` of a question.

    A designator in Chinese letters that is known comes first, then one in Latin letters, in upper case; of places the longest that the text holds. A given designator, theater or role wins, and
    with a given theater no place is looked for. Empty values count as not given.
    """
    none = F.lit(None).cast("string")
    given = lambda c: none if c is None else F.nullif(c, F.lit(""))
    low = F.lower(query)
    chinese = normalized(F.regexp_extract(query, r"([一-鿿]+[-－]?\d+[A-Za-z]?)", 1))["en_base"]
    latin = F.upper(F.nullif(F.regexp_extract(query, r"(?U)\b([A-Za-z]{1,3}-\d{1,3}[A-Za-z]?)\b", 1), F.lit("")))
    keys = sorted(places, key=len, reverse=True)
    place = F.coalesce(*[F.when(low.contains(k), F.lit(k)) for k in keys], none)
    place = F.when(given(theater).isNull(), place)
    empty = F.array().cast("array<string>")
    theaters = F.when(given(theater).isNotNull(), F.array(given(theater)))
    for k in keys:
        theaters = theaters.when(place == k, F.array(*map(F.lit, places[k])))
    hinted = F.coalesce(*[F.when(low.contains(h), F.lit(r)) for h, r in hints], none)
    return F.struct(F.coalesce(given(designator), chinese, latin).alias("designator"), theaters.otherwise(empty).alias("theaters"), F.coalesce(given(role), hinted).alias("role"), place.alias("matched_location"))


def retrieval_text(query: Column, designator: Column, location: Column) -> Column:
    """What is searched for: the parts that are not empty, joined by spaces."""
    return F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (query, designator, location)])
