"""Queries of units and of what they field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.text import all_of, any_of, holds, labelled
from gneiss.operators.catalog import commonest, limited


def _by_name(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("unit_name").asc_nulls_first(), F.col("unit_key").asc_nulls_first())


def any_form(designator: str) -> Column:
    """Whether a link's designator in any of its three forms holds the text."""
    return any_of(*[F.coalesce(holds(F.col(c), designator), F.lit(False)) for c in ("en_designator", "cn_designator", "raw_designator")])


def with_aircraft(units: DataFrame, links: DataFrame) -> DataFrame:
    """Units with ``aircraft``, the sorted array of their different raw designators."""
    lists = links.groupBy("unit_key").agg(F.sort_array(F.collect_set("raw_designator")).alias("aircraft"))
    return units.join(lists, "unit_key", "left").withColumn("aircraft", F.coalesce("aircraft", F.array().cast("array<string>")))


def search_units(units: DataFrame, service: str | None = None, theater: str | None = None, role: str | None = None, name: str | None = None, limit: int | None = 50) -> DataFrame:
    found = units.filter(all_of(holds(F.col("service"), service), holds(F.col("theater_command"), theater), holds(F.col("role"), role), holds(F.col("unit_name"), name)))
    return limited(_by_name(found), limit)


def unit(units: DataFrame, links: DataFrame, key: str) -> DataFrame:
    return with_aircraft(units.filter(F.col("unit_key") == key), links.filter(F.col("unit_key") == key))


def units_for_aircraft(units: DataFrame, links: DataFrame, designator: str, limit: int | None = 100) -> DataFrame:
    """Units with a link that holds the designator in any form, once each, ordered by name."""
    return limited(_by_name(units.join(links.filter(any_form(designator)), "unit_key", "left_semi")), limit)


def aircraft_inventory(units: DataFrame, links: DataFrame, service: str | None = None) -> DataFrame:
    """``(designator, units)``: how many units field each designator, by its Latin base, else its Chinese one; commonest first, then by name."""
    hub = units.filter(holds(F.col("service"), service)).select("unit_key")
    base = labelled(F.coalesce(F.nullif("en_designator", F.lit("")), "cn_designator"))
    return commonest(links.join(hub, "unit_key", "left_semi").groupBy(base.alias("designator")).agg(F.countDistinct("unit_key").alias("units")), "units")


def role_breakdown(units: DataFrame, service: str | None = None) -> DataFrame:
    """``(role, n)``, commonest first, then by name."""
    return commonest(units.filter(holds(F.col("service"), service)).groupBy(labelled(F.col("role")).alias("role")).agg(F.count("*").alias("n")))


def theater_breakdown(units: DataFrame) -> DataFrame:
    """``(theater, n)``, commonest first, then by name."""
    return commonest(units.groupBy(labelled(F.col("theater_command"), "(none)").alias("theater")).agg(F.count("*").alias("n")))
