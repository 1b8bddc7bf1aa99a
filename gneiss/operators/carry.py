"""State carried from row to row of an ordered group, in two levels, so that one group of any length is many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry(rows: DataFrame, by: str, order: str, size: int, last: dict[str, Column] | None = None, total: dict[str, Column] | None = None, before: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with a column for each name: of ``last`` the last value that is not NULL, of ``total`` the sum, both up to and with the row; of ``before`` the value of the row before.

    Rows of one ``by`` are taken in ranges of ``size`` of the whole number ``order``. What each range leaves behind is an aggregate; a window over the ranges gives every range what it begins
    with, and a window over a range does the rest. Rows whose ``by`` or ``order`` is NULL have no row; the order of rows with the same place is not defined.
    """
    last, total, before = last or {}, total or {}, before or {}
    r = rows.filter(F.col(by).isNotNull() & F.col(order).isNotNull()).withColumn("_range", F.floor(F.col(order) / size))
    r = r.withColumns({f"_{n}": v for n, v in (last | total | before).items()})
    left = [F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), F.col(order))).alias(f"_{n}") for n in last]
    left += [F.sum(f"_{n}").alias(f"_{n}") for n in total] + [F.max_by(f"_{n}", order).alias(f"_{n}") for n in before]
    ranges = Window.partitionBy(by).orderBy("_range")
    sofar = ranges.rowsBetween(Window.unboundedPreceding, -1)
    opening = [F.last(f"_{n}", True).over(sofar).alias(f"_0{n}") for n in last] + [F.coalesce(F.sum(f"_{n}").over(sofar), F.lit(0)).alias(f"_0{n}") for n in total]
    opening += [F.lag(f"_{n}").over(ranges).alias(f"_0{n}") for n in before]
    begun = r.groupBy(by, "_range").agg(*left).select(by, "_range", *opening)
    w = Window.partitionBy(by, "_range").orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    new = {n: F.coalesce(F.last(f"_{n}", True).over(upto), f"_0{n}") for n in last} | {n: F.coalesce(F.sum(f"_{n}").over(upto), F.lit(0)) + F.col(f"_0{n}") for n in total}
    new |= {n: F.coalesce(F.lag(f"_{n}").over(w), f"_0{n}") for n in before}
    names = [*last, *total, *before]
    return r.join(begun, [by, "_range"]).withColumns(new).drop("_range", *[f"_{n}" for n in names], *[f"_0{n}" for n in names])
