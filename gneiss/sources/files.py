"""Files as ordered lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.tables import ship

LAYOUT = "doc string, page int, block int, line int, span int, text string, size double, font string"
GOLD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("query_text", T.StringType()),
        T.StructField("verified", T.BooleanType()),
        T.StructField("note", T.StringType()),
        T.StructField("expected", T.ArrayType(T.StructType([T.StructField("source", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("quote", T.StringType())]))),
    ]
)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(doc, line_no, text, source_url)`` of text files, lines in their order; ``source_url`` is what follows ``Source URL:`` in the file, else ''."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc"), "value")
    return lines_of(files)


def lines_of(docs: DataFrame) -> DataFrame:
    """``text_lines`` of a table ``(doc, value)``."""
    url = F.coalesce(F.regexp_extract("value", r"(?m)^Source URL:\s*(\S+)", 1), F.lit(""))
    return docs.select("doc", url.alias("source_url"), F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("line_no", "text")).select("doc", F.col("line_no").cast("long"), "text", "source_url")


def listed_files(spark: SparkSession, path: str, pattern: str = "*.pdf", skip: list[str] | None = None) -> DataFrame:
    """``(path, name, length)`` of files by name, without those to skip."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    return f.filter(~F.col("name").isin(*skip)) if skip else f


def gold_cases(spark: SparkSession, path: str) -> DataFrame:
    """Retrieval cases from JSON lines; a case without an id has no row."""
    return spark.read.schema(GOLD).json(path).filter("id is not null")


def _yaml_cases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import json

    import yaml

    for batch in batches:
        for text in batch.column(0).to_pylist():
            cases = [c for c in yaml.safe_load(text) or [] if isinstance(c, dict)]
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(c, default=str) for c in cases], pa.string())], ["case"])


def gold_yaml(spark: SparkSession, path: str) -> DataFrame:
    """Retrieval cases from YAML files, each a list of cases with the fields of ``GOLD``; ``query`` stands for ``query_text``. A case without an id has no row, and other fields are left out.

    A file is read by one task, so cases of many files are read side by side. Needs PyYAML on the executors.
    """
    ship(spark)
    cases = spark.read.text(path, wholetext=True).mapInArrow(_yaml_cases, "case string")
    fields = T.StructType([*GOLD.fields, T.StructField("query", T.StringType())])
    c = cases.select(F.from_json("case", fields).alias("c")).select("c.*")
    return c.withColumn("query_text", F.coalesce("query_text", "query")).select(*GOLD.names).filter("id is not null")


def lines_of_spans(spans: DataFrame) -> DataFrame:
    """Lines of a page's text spans (``LAYOUT``): visible spans joined by spaces, with the size and font of the largest."""
    s = spans.filter(F.regexp_replace("text", r"(?U)\s+", "") != "")
    order = F.array_sort(F.collect_list(F.struct("span", "text")))
    lines = s.groupBy("doc", "page", "block", "line").agg(F.array_join(F.transform(order, lambda x: x["text"]), " ").alias("text"), F.max_by(F.struct("size", "font"), F.struct("size", -F.col("span"))).alias("top"))
    from gneiss.functions.text import collapse

    return lines.select("doc", "page", (F.col("page").cast("long") * 1000000000 + F.col("block").cast("long") * 100000 + F.col("line")).alias("line_no"), collapse(F.col("text")).alias("text"), F.round("top.size", 1).alias("size"), F.col("top.font").alias("font"))
