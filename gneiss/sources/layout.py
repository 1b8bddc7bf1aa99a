"""Catalogue assets from lines with their type size: titles, sections, sub-sections and fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.text import strip
from gneiss.operators.carry import carry

#: Least sizes in points, lines that are no content, and names with a column of their own.
SIZES = [(14.0, "title"), (11.0, "section"), (9.0, "subsection")]
NOISE = r"^For Training Use Only$|^Exported \(UTC\) @"
#: Line numbers of sixteen pages of ``files.lines_of_spans``.
PAGES = 16 * 10**9
NOTES, METADATA, URL, TEXT = "Notes", "Metadata", "WEG Location", "_text"


def line_kind(size: Column) -> Column:
    kind = None
    for least, name in SIZES:
        kind = F.when(size >= least, name) if kind is None else kind.when(size >= least, name)
    return kind.otherwise("body")


def key_value(text: Column) -> Column:
    """``struct<k, v>`` of a line ``label: value``, split at the first colon with a space; NULL if either is empty."""
    parts = F.split(text, ": ", 2)
    k, v = strip(F.get(parts, F.lit(0))), strip(F.get(parts, F.lit(1)))
    return F.when((F.size(parts) == 2) & (k != "") & (v != ""), F.struct(k.alias("k"), v.alias("v")))


def parse_layout(lines: DataFrame, size: int = PAGES) -> DataFrame:
    """``(doc, asset_seq, asset_title, source_url, notes, dynamic_payload)`` of each asset of a document.

    ``lines``: doc, line_no, text, size, font. A title line begins an asset unless the line before is one too, which it then continues; lines before the first title are dropped. A label that
    comes again in one container makes an array; sections keep the order in which they first appear. Notes are a column, as is the first ``WEG Location``. State is carried in
    ranges of ``size`` line numbers, so one document of any length is many tasks.
    """
    page_number = F.col("text").rlike(r"^\d{1,5}$") & F.coalesce(F.col("font").contains("Helvetica"), F.lit(False))
    x = lines.filter(~F.col("text").rlike(NOISE) & ~page_number).withColumn("kind", line_kind(F.col("size")))
    x = carry(x, "doc", "line_no", size, before={"kind_before": F.col("kind")})
    begins = (F.col("kind") == "title") & (F.coalesce("kind_before", F.lit("")) != "title")
    none, text = F.struct(F.lit(None).cast("string").alias("v")), F.struct(F.col("text").alias("v"))
    named = F.when(F.col("kind") == "section", text).when(begins, none)
    sub = F.when(F.col("kind") == "subsection", text).when(begins | (F.col("kind") == "section"), none)
    x = carry(x, "doc", "line_no", size, last={"named": named, "sub": sub}, total={"asset_seq": begins.cast("int")}).filter("asset_seq > 0")
    x = x.withColumn("sub", F.col("sub.v")).withColumn("section", F.coalesce("named.v", F.when(F.col("sub").isNotNull(), "General")))

    def ordered(value: Column, when: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("line_no", value.alias("t"))))), lambda s: s["t"])

    titles = x.filter("kind = 'title'").groupBy("doc", "asset_seq").agg(F.array_join(ordered(F.col("text"), F.lit(True)), " ").alias("asset_title"))

    body = x.filter("kind = 'body'").withColumn("kv", F.when(F.coalesce(F.col("section") != NOTES, F.lit(True)), key_value(F.col("text"))))
    body = body.withColumn("label", F.coalesce("kv.k", F.lit(TEXT))).withColumn("value", F.coalesce("kv.v", "text"))
    grain = ["doc", "asset_seq", "section", "sub"]
    fields = body.groupBy(*grain, "label").agg(F.min("line_no").alias("at"), ordered(F.col("value"), F.lit(True)).alias("values"))
    special = fields.filter(F.col("section").isNull() & (F.col("label") == URL)).select("doc", "asset_seq", F.get("values", F.lit(0)).alias("source_url"))
    notes = fields.filter((F.col("section") == NOTES) & F.col("sub").isNull() & (F.col("label") == TEXT)).select("doc", "asset_seq", F.array_join("values", " ").alias("notes"))
    fields = fields.filter(~F.coalesce(F.col("section") == NOTES, F.lit(False)) & ~(F.col("section").isNull() & (F.col("label") == URL)))

    def quoted(c: Column) -> Column:
        return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")

    shown = F.when(F.col("label") == TEXT, quoted(F.array_join("values", " "))).when(F.size("values") > 1, F.to_json("values")).otherwise(quoted(F.get("values", F.lit(0))))
    member = F.concat(quoted(F.col("label")), F.lit(": "), shown)
    items = fields.select(*grain, "at", member.alias("member"))

    def joined(rows: DataFrame, by: list[str]) -> DataFrame:
        inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "member"))), lambda m: m["member"]), ", ")
        return rows.groupBy(*by).agg(F.min("at").alias("at"), F.concat(F.lit("{"), F.coalesce(inner, F.lit("")), F.lit("}")).alias("object"))

    # containers without fields exist too
    heads = x.filter("kind in ('section', 'subsection')").filter(F.coalesce(F.col("section") != NOTES, F.lit(True)))
    subs = joined(items.filter("sub is not null").unionByName(heads.filter("sub is not null").groupBy(*grain).agg(F.min("line_no").alias("at")).withColumn("member", F.lit(None).cast("string"))), grain)
    subs = subs.select("doc", "asset_seq", "section", "at", F.concat(quoted(F.col("sub")), F.lit(": "), F.col("object")).alias("member"))
    direct = items.filter("sub is null").select("doc", "asset_seq", "section", "at", "member")
    empty = heads.groupBy("doc", "asset_seq", "section").agg(F.min("line_no").alias("at")).withColumn("member", F.lit(None).cast("string"))
    sections = joined(direct.unionByName(subs).unionByName(empty), ["doc", "asset_seq", "section"])
    sections = sections.select("doc", "asset_seq", "at", F.concat(quoted(F.coalesce("section", F.lit(METADATA))), F.lit(": "), F.col("object")).alias("member"))
    payload = joined(sections, ["doc", "asset_seq"]).select("doc", "asset_seq", F.col("object").alias("dynamic_payload"))
    out = titles.join(special, ["doc", "asset_seq"], "left").join(notes, ["doc", "asset_seq"], "left").join(payload, ["doc", "asset_seq"], "left")
    return out.select("doc", "asset_seq", strip(F.col("asset_title")).alias("asset_title"), "source_url", "notes", F.coalesce("dynamic_payload", F.lit("{}")).alias("dynamic_payload"))
