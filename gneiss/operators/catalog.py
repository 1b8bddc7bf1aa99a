"""Queries of the document catalogue. Documents are JSON text, read as they are asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.text import all_of, holds, labelled



def origin() -> Column:
    return F.get_json_object("dynamic_payload", "$.Metadata.Origin")


def domain() -> Column:
    return F.get_json_object("dynamic_payload", "$.Metadata.Domain")


def limited(df: DataFrame, limit: int | None) -> DataFrame:
    """``limit`` rows; all of them where it is None or negative."""
    return df if limit is None or limit < 0 else df.limit(limit)


def commonest(counts: DataFrame, n: str = "n") -> DataFrame:
    """Counts from the highest down, equal ones by their label."""
    return counts.orderBy(F.desc(n), *[c for c in counts.columns if c != n])


def search_assets(assets: DataFrame, title: str | None = None, origin_like: str | None = None, domain_like: str | None = None, limit: int | None = 50) -> DataFrame:
    """Assets whose title, origin and domain hold the given texts, ordered by title. No text is no filter; an asset without the field holds nothing."""
    found = assets.select("asset_title", "source_url", origin().alias("origin"), domain().alias("domain"))
    found = found.filter(all_of(holds(F.col("asset_title"), title), holds(F.col("origin"), origin_like), holds(F.col("domain"), domain_like)))
    return limited(found.orderBy(F.col("asset_title").asc_nulls_first(), "source_url"), limit)


def count_origins(assets: DataFrame) -> DataFrame:
    """``(origin, n)``, commonest first, then by name; documents without one count as ``(unknown)``."""
    return commonest(assets.groupBy(labelled(origin()).alias("origin")).agg(F.count("*").alias("n")))


def category() -> Column:
    """The last token of the domain between commas that is not blank."""
    tokens = F.filter(F.transform(F.split(domain(), ","), lambda t: F.trim(t)), lambda t: t != "")
    return F.coalesce(F.try_element_at(tokens, F.lit(-1)), F.lit("(uncategorized)"))


def category_breakdown(assets: DataFrame, origin_like: str | None = None) -> DataFrame:
    """``(category, n)``, commonest first, then by name."""
    kept = assets.filter(holds(origin(), origin_like)) if origin_like else assets
    return commonest(kept.groupBy(category().alias("category")).agg(F.count("*").alias("n")))


def section_names(assets: DataFrame) -> DataFrame:
    """``(asset_title, position, section)`` of the top-level members of each document, in stored order."""
    return assets.select("asset_title", F.posexplode(F.json_object_keys("dynamic_payload")).alias("position", "section"))


def section(assets: DataFrame, name: str) -> DataFrame:
    """``(asset_title, section)``: the JSON text of one member; NULL where a document lacks it or is no object."""
    return assets.select("asset_title", F.from_json("dynamic_payload", "map<string,string>")[name].alias("section"))


def asset(assets: DataFrame, title: str) -> DataFrame:
    return assets.filter(F.col("asset_title") == title).withColumn("payload", F.from_json("dynamic_payload", "map<string,string>"))


def of_origin(assets: DataFrame, needle: str, limit: int | None = None) -> DataFrame:
    """Assets whose origin (also one of a list) or title holds ``needle``; the limit counts kept assets, in order of ``asset_seq``."""
    o = F.coalesce(F.array_join(F.from_json(origin(), "array<string>"), " "), origin(), F.lit(""))
    kept = assets.filter(F.lower(o).contains(needle.lower()) | F.lower("asset_title").contains(needle.lower()))
    return limited(kept.orderBy("asset_seq"), limit) if limit is not None else kept


def first_of_source(assets: DataFrame, n: int, needle: str) -> DataFrame:
    """``of_origin`` among the assets with an ``asset_seq`` of at most ``n``: the limit counts what was read, not what is kept."""
    return of_origin(assets.filter(F.col("asset_seq") <= n), needle)


def sample_asset(assets: DataFrame, prefix: str) -> DataFrame:
    """One asset: the first by title of those whose title begins with ``prefix``, else the first of all. No asset gives no row."""
    return assets.orderBy(F.coalesce(F.col("asset_title").startswith(prefix), F.lit(False)).desc(), F.col("asset_title").asc_nulls_last()).limit(1)


def shares(counts: DataFrame, n: str = "n") -> DataFrame:
    """``counts`` with each row's percentage of all."""
    total = counts.agg(F.sum(n).alias("_total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("percent", F.round(100 * F.col(n) / F.greatest(F.col("_total"), F.lit(1)), 4)).drop("_total")


#: Sections whose fields describe an asset, in the order in which they are merged, and fields that are left out.
SPEC_SECTIONS = ["System", "Automotive", "Dimensions", "Armament", "Main Missile Systems", "Missile Weapon Systems", "Bomb Weapon Systems"]
SPEC_SKIP = ["image sources", "manufacturer", "alternate designation(s)"]


def specs(assets: DataFrame) -> DataFrame:
    """``(asset_seq, spec, value)``: the first scalar of each field name in the sections of an asset, in their order.

    Scalars that stand directly in an array have no name and are left out; true, false and null read True, False and None. Names and values are
    stripped. The document is flattened by ``nested.json_nodes``; NULL, empty and invalid documents have no row.
    """
    from gneiss.operators.nested import json_nodes

    n = json_nodes(assets).filter("depth > 1 and key is not null and kind not in ('object', 'array')")
    n = n.filter(F.col("section").isin(SPEC_SECTIONS) & ~F.trim(F.lower("key")).isin(SPEC_SKIP))
    value = F.when(F.col("kind") == "null", "None").when(F.col("value") == "true", F.when(F.col("kind") == "boolean", "True").otherwise("true")).when((F.col("kind") == "boolean"), "False").otherwise(F.trim("value"))
    rank = F.array_position(F.array(*map(F.lit, SPEC_SECTIONS)), F.col("section"))
    first = F.min_by(value, F.struct(rank, F.col("order")))
    return n.groupBy("asset_seq", F.trim("key").alias("spec")).agg(first.alias("value"))
