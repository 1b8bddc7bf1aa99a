"""Repeated lines of files, and windows of words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.text import collapse, is_page_number, line_key, strip


def page_lines(pages: DataFrame) -> DataFrame:
    """``(source, page_id, line_no, line)`` of the lines that are not blank, stripped. ``pages``: source, page_id, text."""
    lines = pages.select("source", "page_id", F.posexplode(F.split("text", r"\r\n|[\n\r\f\x0b\x1c-\x1e\x85  ]")).alias("line_no", "line"))
    return lines.withColumn("line", strip(F.col("line"))).filter("line <> ''")


def boilerplate_keys(pages: DataFrame, repeat_frac: float = 0.5, min_pages: int = 5, min_key_len: int = 8) -> DataFrame:
    """``(source, line_key, pages)`` of lines that ``repeat_frac`` of a file's pages have, and at least ``min_pages``; files of fewer pages have none."""
    size = pages.select("source", "page_id").distinct().groupBy("source").agg(F.count("*").alias("n"))
    keys = page_lines(pages).select("source", "page_id", line_key(F.col("line")).alias("line_key")).filter(F.length("line_key") >= min_key_len).distinct()
    seen = keys.groupBy("source", "line_key").agg(F.count("*").alias("pages"))
    need = F.greatest(F.lit(min_pages), F.floor(F.col("n") * repeat_frac))
    return seen.join(size, "source").filter((F.col("n") >= min_pages) & (F.col("pages") >= need)).select("source", "line_key", "pages")


def stripped_pages(pages: DataFrame, **options) -> DataFrame:
    """``(source, page_id, text)``: every page without repeated lines and bare page numbers, as one line. A page without other lines has empty text."""
    boiler = boilerplate_keys(pages, **options).select("source", "line_key")
    lines = page_lines(pages).filter(~is_page_number(F.col("line"))).withColumn("line_key", line_key(F.col("line"))).join(boiler, ["source", "line_key"], "left_anti")
    text = lines.groupBy("source", "page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ").alias("text"))
    every = pages.select("source", "page_id").distinct()
    return every.join(text, ["source", "page_id"], "left").select("source", "page_id", collapse(F.coalesce("text", F.lit(""))).alias("text"))


def word_windows(pages: DataFrame, keys: list[str], size: int = 150, overlap: int = 30, least: int = 20) -> DataFrame:
    """``keys``, ``child_no`` from 0, ``words`` and ``text`` of windows of ``size`` words that share ``overlap``; windows of fewer than ``least`` words are left out."""
    step = max(1, size - overlap)
    p = pages.withColumn("_w", F.filter(F.split(F.col("text"), r"(?U)\s+"), lambda w: w != ""))
    last = F.greatest(F.lit(0), F.ceil((F.size("_w") - size) / step).cast("int"))
    p = p.filter(F.size("_w") > 0).select(*keys, "_w", F.explode(F.sequence(F.lit(0), last)).alias("child_no"))
    piece = F.slice("_w", F.col("child_no") * step + 1, F.lit(size))
    return p.select(*keys, "child_no", F.size(piece).alias("words"), F.array_join(piece, " ").alias("text")).filter(F.col("words") >= least)
