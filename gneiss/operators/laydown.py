"""Which unit fields which catalogue asset: links joined with units and, by prefix, with titles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.codes import PREFIXES
from gneiss.functions.text import all_of, holds
from gneiss.operators.catalog import limited
from gneiss.operators.hub import any_form


def title_keys(title: Column) -> Column:
    """What a title, in lower case, may be named by: itself, and what stands before each space or ``(``."""
    t = F.lower(title)
    cut = F.filter(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: t.substr(i, F.lit(1)).isin(" ", "("))
    return F.array_distinct(F.concat(F.array(t), F.transform(cut, lambda i: t.substr(F.lit(1), i - 1))))


def prefix_key_join(left: DataFrame, key: str, titles: DataFrame, title: str) -> DataFrame:
    """``left`` with each title that equals ``key`` or begins with it followed by a space or ``(``, apart from case; NULL without one.

    The condition is an equality with one of the title's keys, so it runs as a hash or merge join and not as a comparison of all with all. NULL keys match nothing;
    repeated titles match repeatedly. A key that holds ``%`` or ``_`` is taken literally. Columns of both sides must have different names.
    """
    keys = titles.withColumn("_key", F.explode(title_keys(F.col(title))))
    return left.join(keys, F.lower(left[key]) == keys["_key"], "left").drop("_key")


def designator_filter(designator: str, prefixes: list[tuple[str, str]] = PREFIXES) -> Column:
    """A designator in Chinese letters means its Latin base, or forms that hold it; any other text means forms that hold it."""
    m = re.match(r"([一-鿿]+)[-－–]?(\d+)", designator.strip())
    if m:
        for p, e in prefixes:
            if m[1].startswith(p):
                en = f"{e}-{m[2]}"
                low = F.coalesce(F.lower("en_designator") == en.lower(), F.lit(False))
                return low | F.coalesce(holds(F.col("cn_designator"), en), F.lit(False)) | F.coalesce(holds(F.col("raw_designator"), en), F.lit(False))
    return any_form(designator)


COLUMNS = ["unit_key", "unit_name", "service", "branch", "role", "theater_command", "location_text", "airbase", "raw_designator", "en_designator", "weg_asset_title", "origin", "domain"]


def capability_laydown(units: DataFrame, links: DataFrame, assets: DataFrame, designator: str | None = None, theater: str | None = None, role: str | None = None, service: str | None = None, limit: int | None = 100) -> DataFrame:
    """Links with their unit and the assets that their designator names, in the columns of ``COLUMNS``.

    Filters apply before the catalogue is joined; a link without an asset stays, with NULL. Ordered by theater, unit and designator, NULL first, up to ``limit`` rows.
    """
    hub = units.filter(all_of(holds(F.col("theater_command"), theater), holds(F.col("role"), role), holds(F.col("service"), service)))
    spoke = links.filter(designator_filter(designator)) if designator else links
    j = spoke.select("unit_key", "raw_designator", "cn_designator", "en_designator").join(hub.select("unit_key", "unit_name", "service", "branch", "role", "theater_command", "location_text", "airbase"), "unit_key")
    titles = assets.select(
        F.col("asset_title").alias("weg_asset_title"),
        F.get_json_object("dynamic_payload", "$.Metadata.Origin").alias("origin"),
        F.get_json_object("dynamic_payload", "$.Metadata.Domain").alias("domain"),
    )
    out = prefix_key_join(j, "en_designator", titles, "weg_asset_title").select(*COLUMNS)
    if limit is None or limit < 0:
        return out
    order = [F.col(c).asc_nulls_first() for c in ("theater_command", "unit_name", "raw_designator", "unit_key", "weg_asset_title")]
    return limited(out.orderBy(*order), limit)


def linked_counts(laydown: DataFrame) -> DataFrame:
    """How many rows there are, and how many have an asset."""
    return laydown.agg(F.count("*").alias("rows"), F.count("weg_asset_title").alias("linked"))


def capability_view(laydown: DataFrame) -> DataFrame:
    """What an asset is, without where it stands: designator, kind (the title up to a bracket) and title, once each."""
    return laydown.filter("weg_asset_title is not null").select("en_designator", F.trim(F.substring_index("weg_asset_title", "(", 1)).alias("kind"), "weg_asset_title").distinct()


def laydown_view(laydown: DataFrame) -> DataFrame:
    """Who stands where with what: unit, designator, theater, airbase and place, once each."""
    return laydown.select("unit_name", F.col("en_designator").alias("designator"), "theater_command", "airbase", "location_text").distinct()


def laydown_specs(laydown: DataFrame, specs: DataFrame) -> DataFrame:
    """The specs of each different asset in ``laydown``. ``specs``: weg_asset_title, spec, value."""
    return laydown.filter("weg_asset_title is not null").select("weg_asset_title").distinct().join(specs, "weg_asset_title")
