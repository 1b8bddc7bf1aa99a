"""How well retrieved pages answer cases with known pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.text import folded


def expected_pages(cases: DataFrame) -> DataFrame:
    """``(id, source, page, quote)``, a row for each expected page of a case."""
    return cases.select("id", F.explode("expected").alias("e")).select("id", "e.source", "e.page", "e.quote")


def case_metrics(retrieved: DataFrame, cases: DataFrame, k: int = 4, tolerance: int = 1) -> DataFrame:
    """Hit, source hit, best rank, reciprocal rank, precision, recall and nDCG of each case.

    ``retrieved``: id, rank from 1, source, page. A page is right if an expected one of the same source is at most ``tolerance`` pages away; best rank and hits look at all retrieved pages, the
    others at the first ``k``. Precision divides by ``k``; recall counts expected pages found; nDCG may exceed 1 where several pages stand for one. Cases without expected pages have zeros.
    """
    gold = expected_pages(cases).select("id", F.col("source").alias("g_source"), F.col("page").alias("g_page"))
    labels = gold.groupBy("id").agg(F.count("*").alias("labels"))
    r = retrieved.select("id", "rank", "source", "page").distinct()
    j = r.join(gold, "id").withColumn("right", (F.col("source") == F.col("g_source")) & (F.abs(F.col("page") - F.col("g_page")) <= tolerance))
    per_rank = j.groupBy("id", "rank").agg(F.max(F.col("right").cast("int")).alias("rel"), F.max((F.col("source") == F.col("g_source")).cast("int")).alias("same_source"))
    by_rank = per_rank.groupBy("id").agg(
        F.max("same_source").alias("source_hit"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("best_rank"),
        F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)).alias("right_in_k"),
        F.sum(F.when((F.col("rank") <= k) & (F.col("rel") == 1), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    found = j.filter(F.col("right") & (F.col("rank") <= k)).select("id", "g_source", "g_page").distinct().groupBy("id").agg(F.count("*").alias("found"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("labels")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    base = cases.select("id", "verified").join(labels, "id", "left").join(by_rank, "id", "left").join(found, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    labels = zero("labels")
    return base.select(
        "id",
        "verified",
        labels.alias("labels"),
        F.col("best_rank").isNotNull().alias("hit"),
        (zero("source_hit") == 1).alias("source_hit"),
        "best_rank",
        F.coalesce(1 / F.col("best_rank"), F.lit(0.0)).alias("reciprocal_rank"),
        zero("right_in_k").alias("right_in_k"),
        zero("found").alias("found"),
        (zero("right_in_k") / k).alias("precision"),
        F.when(labels > 0, zero("found") / labels).otherwise(F.lit(0.0)).alias("recall"),
        F.when((labels > 0) & (zero("dcg") > 0), F.col("dcg") / ideal).otherwise(F.lit(0.0)).alias("ndcg"),
    )


def summary(metrics: DataFrame, k: int = 4) -> DataFrame:
    """One row: cases, hit rate, mean reciprocal rank, means of the rest, and precision and recall over all labels."""
    n = F.greatest(F.count("*"), F.lit(1))
    return metrics.agg(
        F.count("*").alias("cases"),
        (F.sum(F.col("hit").cast("int")) / n).alias("hit_rate"),
        (F.sum(F.col("source_hit").cast("int")) / n).alias("source_hit_rate"),
        F.avg("reciprocal_rank").alias("mrr"),
        F.avg("precision").alias("mean_precision"),
        F.avg("recall").alias("mean_recall"),
        F.avg("ndcg").alias("mean_ndcg"),
        (F.sum("right_in_k") / (n * k)).alias("micro_precision"),
        (F.sum("found") / F.greatest(F.sum("labels"), F.lit(1))).alias("micro_recall"),
        F.sum("labels").alias("labels"),
        F.count(F.when(~F.col("verified"), 1)).alias("unverified"),
    )


def to_inspect(metrics: DataFrame) -> DataFrame:
    """``(id, reason)`` of cases to look at: ``missed`` without a right page, ``unverified`` where nobody has confirmed the labels."""
    reasons = F.array_compact(F.array(F.when(~F.col("hit"), F.lit("missed")), F.when(~F.coalesce("verified", F.lit(False)), F.lit("unverified"))))
    return metrics.select("id", F.explode(reasons).alias("reason"))


def right_pages(retrieved: DataFrame, cases: DataFrame, tolerance: int = 1) -> DataFrame:
    """The rows of ``retrieved`` (id, rank, source, page) that are at most ``tolerance`` pages from an expected page of the same case and source, once each."""
    gold = expected_pages(cases).select(F.col("id").alias("g_id"), F.col("source").alias("g_source"), F.col("page").alias("g_page")).distinct()
    near = (F.col("id") == F.col("g_id")) & (F.col("source") == F.col("g_source")) & (F.abs(F.col("page") - F.col("g_page")) <= tolerance)
    return retrieved.select("id", "rank", "source", "page").distinct().join(gold, near, "left_semi")


def quote_validation(cases: DataFrame, parents: DataFrame) -> DataFrame:
    """``(id, source, page, valid)``: whether each quote stands on its page, quotes and white space folded. NULL and empty quotes have no row."""
    gold = expected_pages(cases).filter("quote <> ''").distinct()
    pages = parents.select("source", "page", F.col("text").alias("body"))
    j = gold.join(pages, ["source", "page"], "left")
    ok = F.coalesce(folded(F.col("body")).contains(folded(F.col("quote"))), F.lit(False))
    return j.groupBy("id", "source", "page", "quote").agg(F.max(ok).alias("valid")).drop("quote")


def missing_sources(cases: DataFrame, parents: DataFrame) -> DataFrame:
    """Expected sources that no page has."""
    return expected_pages(cases).select("source").distinct().join(parents.select("source").distinct(), "source", "left_anti")
