"""References to records that do not exist.

Parent keys are brought to the form (stem, number), so that ``ZKX-7`` has the stem ``zkx-`` and the number 7 and a numeric id has an empty stem. Sorted
numbers of a stem are compressed into runs of consecutive keys. Each referenced key is matched as of its place to the run that
starts at or before it: a key beyond that run's end has no target. Times of the keys that exist are then compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.tables import cut_lineage

#: Runs of keys end at multiples of this.
_SPAN = 1 << 16


def designator_key(c: Column) -> Column:
    """A designator or title apart from case, outer spaces and the kind of dash."""
    return F.trim(F.translate(F.lower(c), "–－", "--"))


def prefix_keys(title: Column) -> Column:
    """All keys that mean the asset of a title: the whole title and what stands before each space or ``(``."""
    t = designator_key(title)
    at = F.filter(F.sequence(F.lit(1), F.length(t)), lambda i: t.substr(i, F.lit(1)).isin(" ", "("))
    return F.array_distinct(F.filter(F.concat(F.array(t), F.transform(at, lambda i: t.substr(F.lit(1), i - 1))), lambda k: k != ""))


def _split_key(key: Column) -> tuple[Column, Column]:
    """The stem and the number of a key, which together give it back: up to 18 last digits, the first of them not 0; -1 where a key ends otherwise."""
    digits = F.regexp_extract(key, "[1-9][0-9]{0,17}$", 0)
    number = F.when(digits != "", digits.cast("long")).otherwise(F.lit(-1).cast("long"))
    return F.substring(key, F.lit(1), F.length(key) - F.length(digits)), number


def key_runs(keys: DataFrame) -> DataFrame:
    """``keys`` with ``reach``: where the run of consecutive targets ends that starts at or before a key's place; NULL where none does.

    ``keys``: space, stem, number, target (boolean), once each. Runs end at multiples of 65,536, so no window holds more than so many keys. One sort both compresses the targets
    into runs and matches each key as of its place.
    """
    w = Window.partitionBy("space", "stem", "part").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    k = keys.withColumn("part", F.floor(F.col("number") / _SPAN).cast("long"))
    k = k.withColumn("island", F.when(F.col("target"), F.col("number") - F.sum(F.col("target").cast("long")).over(w)))
    last = F.max("number").over(Window.partitionBy("space", "stem", "part", "island"))
    k = k.withColumn("last", F.when(F.col("target"), last))
    return k.withColumn("reach", F.last("last", ignorenulls=True).over(w)).drop("part", "island", "last")


_KEY = ["space", "stem", "number"]


def _told(rows: DataFrame, by: list[str], order: str, inclusive: bool) -> DataFrame:
    """``rows`` with ``alive``, the sum of ``step`` before a row (and with it, if ``inclusive``), and ``found`` and ``first`` of the row without ``order``, which comes first."""
    w = Window.partitionBy(*by).orderBy(F.col(order).asc_nulls_first())
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("alive", F.coalesce(F.sum("step").over(upto if inclusive else before), F.lit(0)))
    return out.withColumn("found", F.first("found", True).over(upto)).withColumn("first", F.first("first", True).over(upto)).filter(F.col(order).isNotNull())


def orphan_references(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """References without a living target at the time they arrived.

    ``refs``: ref_table, ref_id, key, arrived. ``targets``: key, arrived, deleted (NULL: not deleted), and ref_table where they are targets of one table only. Keys are strings; a NULL or blank key is no
    reference. Result: distinct ``(ref_table, ref_id, reason, ref_month)``, where reason is ``missing`` (no such target at any time), ``deleted`` (targets
    had arrived, none was alive) or ``late`` (all targets arrived afterwards). A target lives from ``arrived`` (inclusive) to ``deleted`` (exclusive).

    A reference without a time has the reason ``missing`` where no target exists and no row otherwise; its month is NULL. Targets without a key or a time are ignored. Repeated rows on either
    side count once. Keys are matched once each and times of a key once each, however many references share them. How many targets live is summed in three steps: over the hours of a key, the
    seconds of an hour and the times of a second, so no group holds more than the hours there are, 3,600 seconds or a million times.
    """
    own = "ref_table" in targets.columns
    stem, number = _split_key(F.col("key"))
    space = (F.col("ref_table") if own else F.lit("")).alias("space")
    refs = cut_lineage(refs.filter(F.trim("key") != "").select("ref_table", "ref_id", F.col("arrived").alias("t"), space, stem.alias("stem"), number.alias("number")))
    life = cut_lineage(targets.filter((F.col("key") != "") & F.col("arrived").isNotNull()).select(space, stem.alias("stem"), number.alias("number"), "arrived", "deleted"))

    time = life.schema["arrived"].dataType
    both = life.select(*_KEY, F.col("arrived").alias("first"), F.lit(True).alias("target")).union(refs.select(*_KEY, F.lit(None).cast(time), F.lit(False)))
    keys = both.groupBy(*_KEY).agg(F.min("first").alias("first"), F.max("target").alias("target"), F.min("target").alias("only"))
    found = F.coalesce(F.col("number") <= F.col("reach"), F.lit(False))
    known = cut_lineage(key_runs(keys).filter("not only or not target").select(*_KEY, found.alias("found"), "first"))

    # +1 where a target arrives, -1 where it is deleted; a repeated target counts twice in both
    living = life.filter("deleted is null or deleted > arrived")
    step = lambda df, t, n, asked: df.select(*_KEY, F.col(t).alias("t"), F.lit(n).cast("long").alias("step"), F.lit(asked).alias("asked"))
    events = step(living, "arrived", 1, False).union(step(living.filter("deleted is not null"), "deleted", -1, False)).union(step(refs.filter("t is not null"), "t", 0, True))
    events = events.groupBy(*_KEY, "t").agg(F.sum("step").alias("step"), F.max("asked").alias("asked"))
    second = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast(time), F.col("t"))  # of times with a zone and without
    events = events.withColumn("second", second).withColumn("hour", F.floor(second / 3600))
    seconds = events.groupBy(*_KEY, "hour", "second").agg(F.sum("step").alias("step"), F.max("asked").alias("asked"))
    hours = seconds.groupBy(*_KEY, "hour").agg(F.sum("step").alias("step"))

    def with_opening(rows: DataFrame, opening: DataFrame, order: str, by: list[str]) -> DataFrame:
        kept = [c for c in rows.columns if c not in ("step", *by)]
        blank = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in kept]
        body = rows.select(*by, *kept, "step", F.lit(None).cast("boolean").alias("found"), F.lit(None).cast(time).alias("first"))
        return body.union(opening.select(*by, *blank, F.col("alive").alias("step"), "found", "first"))

    at_hour = _told(with_opening(hours, known.withColumn("alive", F.lit(0).cast("long")), "hour", _KEY), _KEY, "hour", False)
    at_second = _told(with_opening(seconds.drop("asked"), at_hour, "second", [*_KEY, "hour"]), [*_KEY, "hour"], "second", False)
    told = _told(with_opening(events, at_second, "t", [*_KEY, "hour", "second"]), [*_KEY, "hour", "second"], "t", True)
    reason = F.when(~F.col("found"), "missing").when(F.col("alive") > 0, None).when(F.col("first") <= F.col("t"), "deleted").otherwise("late")
    answers = told.filter("asked").select(*_KEY, "t", reason.alias("reason")).filter("reason is not null")
    result = lambda df, why: df.select("ref_table", "ref_id", why, F.date_format("t", "yyyy-MM").alias("ref_month"))
    timed = result(refs.join(answers, [*_KEY, "t"]), "reason")
    untimed = refs.filter("t is null").join(known.filter("not found"), _KEY, "left_semi")
    return timed.union(result(untimed, F.lit("missing").alias("reason"))).distinct()


def _asset_sides(links: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    name = F.lit("unit_aircraft").alias("ref_table")
    refs = links.select(name, F.col("link_id").cast("long").alias("ref_id"), designator_key(F.col("en_designator")).alias("key"), F.col("ingested_at").alias("arrived"))
    return refs, assets.select(name, F.explode(prefix_keys(F.col("asset_title"))).alias("key"), F.col("ingested_at").alias("arrived"), F.col("deleted_at").alias("deleted"))


def _page_sides(chunks: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    name = F.lit("rag_chunks").alias("ref_table")
    refs = chunks.select(name, F.col("chunk_id").cast("long").alias("ref_id"), F.col("parent_id").cast("string").alias("key"), F.col("ingested_at").alias("arrived"))
    return refs, pages.select(name, F.col("parent_id").cast("string").alias("key"), F.col("ingested_at").alias("arrived"), F.col("deleted_at").alias("deleted"))


def asset_references(links: DataFrame, assets: DataFrame) -> DataFrame:
    """``orphan_references`` of ``unit_aircraft.en_designator`` to the titles of the catalogue."""
    return orphan_references(*_asset_sides(links, assets))


def page_references(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """``orphan_references`` of ``rag_chunks.parent_id`` to pages."""
    return orphan_references(*_page_sides(chunks, pages))


def all_references(links: DataFrame, assets: DataFrame, chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """``orphan_references`` of both kinds in one plan; each table is read once."""
    (a, x), (b, y) = _asset_sides(links, assets), _page_sides(chunks, pages)
    return orphan_references(a.union(b), x.union(y))
