"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.llm import leaks, mix, scans, spans, split
from gneiss.tables import table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "rag_parents").select(F.lit("rag_parents").alias("table_name"), F.col("parent_id").alias("record_id"), "text")
    return pages.union(table(spark, d, "rag_chunks").select(F.lit("rag_chunks"), "chunk_id", "text"))


def p1_found(spark, d):
    return split.oversized_paragraphs(_texts(spark, d))


def p1_pieces(spark, d):
    return split.split_records(_texts(spark, d)).select("table_name", "record_id", "piece_no", "start", "stop", "cut", "text").distinct()


def p1_whole(spark, d):
    """Of each record above the limit: whether its pieces keep to limit and overlap and follow one another, and the text that they make together."""
    p = split.split_records(_texts(spark, d).distinct())
    w = Window.partitionBy("table_name", "record_id").orderBy("piece_no")
    step = F.coalesce(F.col("start") == F.lag("stop").over(w) - 150, F.col("start") == 0)
    p = p.select("table_name", "record_id", "piece_no", (F.length("text") <= 1500).alias("short"), step.alias("step"), F.when(F.col("piece_no") == 1, F.col("text")).otherwise(F.substr("text", F.lit(151))).alias("rest"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "rest"))), lambda x: x["rest"]), "")  # the pieces of one record
    return p.groupBy("table_name", "record_id").agg(F.min("short").alias("within_limit"), F.min("step").alias("overlapping"), F.md5(whole).alias("digest"))


def _scanned(spark, d):
    pages = table(spark, d, "rag_parents").select(F.lit("rag_parents").alias("table_name"), F.col("parent_id").alias("record_id"), "source", "page", "text")
    notes = table(spark, d, "weg_assets").select(F.lit("weg_assets"), "asset_seq", F.lit("notes"), F.lit(None).cast("int"), "notes")
    return pages.union(notes)


def p3_found(spark, d):
    return scans.noise_kinds(_scanned(spark, d))


def p3_texts(spark, d):
    return scans.repaired_texts(_scanned(spark, d))


def p6_found(spark, d):
    return leaks.leaked_documents(table(spark, d, "documents"), table(spark, d, "gold_cases"))


def p6_leaks(spark, d):
    return leaks.leaked_passages(table(spark, d, "documents"), table(spark, d, "gold_cases"))


def p6_runs(spark, d):
    """The longest run of words that a document has in common with a passage: the exact part of ``p6_leaks``."""
    return p6_leaks(spark, d).filter("common_words > 0").select("doc_id", "id", "passage", "common_words")


def p6_cases(spark, d):
    """How many documents each leaked case stands in."""
    return p6_found(spark, d).groupBy("id").agg(F.count("*").alias("documents"))


def _counts(spark, d):
    return mix.token_counts(table(spark, d, "documents"))


def p7_found(spark, d):
    return mix.source_rates(_counts(spark, d), table(spark, d, "mix_targets")).filter("short").select("source")


def p7_mix(spark, d):
    """The copies of documents that make the mix, with their text."""
    rates = mix.source_rates(_counts(spark, d), table(spark, d, "mix_targets"))
    return mix.mixed_documents(table(spark, d, "documents"), rates)


def p7_bounds(spark, d):
    """Of each source: whether no document is used too often, and whether its tokens in the mix lie between those of the whole copies below and above its rate."""
    s = p7_shares(spark, d).join(table(spark, d, "mix_targets").select("source", "max_repeats").distinct(), "source")
    between = F.col("mix_tokens").between(F.floor("rate") * F.col("tokens"), F.ceil("rate") * F.col("tokens"))
    return s.select("source", (F.col("most") <= F.col("max_repeats")).alias("within_repeats"), between.alias("between"), "short")


def p7_shares(spark, d):
    return mix.reached_shares(_counts(spark, d), table(spark, d, "mix_targets"))


def p8_found(spark, d):
    return spans.shared_pairs(table(spark, d, "documents"))


def p8_spans(spark, d):
    return spans.shared_spans(table(spark, d, "documents"))


def p8_share(spark, d):
    return spans.shared_share(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_whole, p3_found, p3_texts, p6_found, p6_leaks, p6_runs, p6_cases, p7_found, p7_mix, p7_shares, p7_bounds, p8_found, p8_spans, p8_share)}
