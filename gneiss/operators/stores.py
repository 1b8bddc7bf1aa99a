"""Keyed tables: rows are merged by key and the latest wins. Functions give DataFrames; how they are written is left to the table format of their user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.schemas import STORES


def _chosen(df: DataFrame, keys: list[str], order: list[str], last: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    # a NULL is the least to the last, and the greatest to the first; ties go by the other columns
    rank = F.struct(*[F.struct(F.col(o).isNotNull() if last else F.col(o).isNull(), o) for o in order], *rest)
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), rank)
    return df.groupBy(*keys).agg(pick.alias("_pick")).select(*[F.col(c) if c in keys else F.col(f"_pick.{c}").alias(c) for c in df.columns])


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``. It is an aggregate with partial results, so that a key with many rows is no single task."""
    return _chosen(df, keys, order, True)


def earliest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``."""
    return _chosen(df, keys, order, False)


def row_counts(**tables: DataFrame) -> DataFrame:
    """``(table_name, n)`` of each table."""
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """Every table of ``schemas.STORES`` without rows, to begin with."""
    return {name: spark.createDataFrame([], schema) for name, schema in STORES.items()}


def register(tables: dict[str, DataFrame], prefix: str = "") -> None:
    """Views of tables by their names; registering again replaces them."""
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)


def merged(current: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``current``, in which rows of ``rows`` replace those of the same key; of several with one key the last by ``order`` counts. NULL keys are keys."""
    new = latest(rows, keys, [order]).select(*current.columns)
    same = [current[k].eqNullSafe(new[k]) for k in keys]
    return current.join(new, same, "left_anti").unionByName(new)


def merged_units(units: DataFrame, links: DataFrame, records: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """``units`` and ``links`` after ``records``: units with their ``aircraft`` (array of raw, cn_base, en_base). The last record of a key replaces unit and links together.

    Of links of one unit with the same raw token the first counts.
    """
    new = latest(records.filter("unit_key is not null"), ["unit_key"], [order])
    each = new.select("unit_key", F.posexplode("aircraft").alias("pos", "a")).select("unit_key", "pos", F.col("a.raw").alias("raw_designator"), F.col("a.cn_base").alias("cn_designator"), F.col("a.en_base").alias("en_designator"))
    each = earliest(each, ["unit_key", "raw_designator"], ["pos"]).select(*links.columns)
    return (
        units.join(new.select("unit_key"), "unit_key", "left_anti").select(*units.columns).unionByName(new.select(*units.columns)),
        links.join(new.select("unit_key"), "unit_key", "left_anti").select(*links.columns).unionByName(each),
    )


def page_faults(parents: DataFrame, chunks: DataFrame, dimension: int) -> DataFrame:
    """``(chunk_id, fault)`` of passages without a page among ``parents`` or with a vector of another size than ``dimension``."""
    known = parents.select("parent_id", F.lit(True).alias("known")).distinct()
    fault = F.when(F.col("known").isNull(), "no page").when(F.coalesce(F.size("embedding"), F.lit(-1)) != dimension, f"not {dimension} numbers")
    return chunks.join(known, "parent_id", "left").select("chunk_id", fault.alias("fault")).filter("fault is not null")


def replaced_pages(current: DataFrame, new: DataFrame) -> DataFrame:
    """``current`` with the rows of ``new`` in place of all rows of the same sources; used for pages and for passages alike."""
    return current.join(new.select("source").distinct(), "source", "left_anti").select(*current.columns).unionByName(new.select(*current.columns))


def dimension(meta: DataFrame) -> DataFrame:
    """One row: the ``dimension`` that a meta table (key, value) names, -1 without any."""
    return meta.filter("key = 'dimension'").agg(F.coalesce(F.max(F.col("value").try_cast("int")), F.lit(-1)).alias("dimension"))
