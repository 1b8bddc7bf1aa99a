"""Mixing sources to target weights, in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.tables import cut_lineage

#: Fixed values of the public byte-level vocabulary: its file and the pattern that splits text before merging.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict = {}


def _counter(vocabulary, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if pattern not in _ENCODERS:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.value.splitlines() if line)}
            _ENCODERS[pattern] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        encode = _ENCODERS[pattern].encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``(doc_id, source, tokens)`` of every document; NULL and empty texts have 0 tokens. Whole texts are counted.

    The vocabulary file (under 2 MB) is read where the driver runs and sent to the tasks, so that executors need no copy.
    """
    if os.path.getsize(vocabulary) > 16 << 20:
        raise ValueError("the vocabulary file is larger than 16 MB")
    with open(vocabulary, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    return docs.select(F.col("doc_id").cast("long"), "source", "text").mapInArrow(_counter(data, pattern), "doc_id long, source string, tokens long")


def source_rates(counts: DataFrame, targets: DataFrame, size: float = 0.5) -> DataFrame:
    """For every source of ``targets``: its tokens, the tokens it should give, and how often each of its documents is used.

    ``counts`` comes from ``token_counts``; ``targets``: source, target_share, max_repeats. The mix has ``size`` times the tokens of all documents. ``rate`` is
    ``min(max_repeats, wanted / tokens)``; ``short`` marks a source that cannot reach its share, also one without any token. Documents of other or of NULL sources
    count towards the size but are in no mix. A source named more than once in ``targets`` counts with its largest share; a NULL
    share or max_repeats is 0.
    """
    per = cut_lineage(counts.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents")))  # texts are tokenized once
    want = targets.filter("source is not null").groupBy("source").agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats"))
    total = per.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))  # one row
    j = want.join(per, "source", "left").crossJoin(total)
    tokens = F.coalesce("tokens", F.lit(0)).cast("long")
    wanted = F.col("target_share") * F.lit(size) * F.col("all_tokens")
    # written, so that Spark knows whether it is small enough to go to all tasks; else large sources are split as skew
    return cut_lineage(j.select(
        "source",
        "target_share",
        "max_repeats",
        F.coalesce("documents", F.lit(0)).cast("long").alias("documents"),
        tokens.alias("tokens"),
        wanted.alias("wanted"),
        F.when(tokens == 0, F.lit(0.0)).otherwise(F.least(F.col("max_repeats").cast("double"), wanted / tokens)).alias("rate"),
        (tokens * F.col("max_repeats") < wanted).alias("short"),
    ))


def _copies(seed: int):
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")


def mixed_documents(docs: DataFrame, rates: DataFrame, seed: int = 7) -> DataFrame:
    """The mix: ``(doc_id, source, copy, text)``, a row for each copy of each document, ``copy`` from 1.

    ``docs``: doc_id, source, text; ``rates``: source and rate, as of ``source_rates``. A document is used ``floor(rate)`` times, and once more with a probability equal to the rest, decided
    by a hash of ``seed`` and its id: the same input gives the same mix whatever the partitioning. NULL and empty texts, documents of other sources and those used 0 times have no row.
    """
    d = docs.select("doc_id", "source", "text").filter("text <> ''").join(rates.select("source", "rate"), "source")
    d = d.withColumn("copies", _copies(seed)).filter("copies > 0")
    return d.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"), "text")


def reached_shares(counts: DataFrame, targets: DataFrame, size: float = 0.5, seed: int = 7) -> DataFrame:
    """What each source gives to the mix: documents, copies, the most of one document, tokens, its share of the mix and the difference from its target. ``counts`` comes from ``token_counts``."""
    counts = cut_lineage(counts)
    mixed = counts.filter("tokens > 0").join(source_rates(counts, targets, size).select("source", "rate"), "source").withColumn("copies", _copies(seed)).filter("copies > 0")
    got = mixed.groupBy("source").agg(F.count("*").alias("used"), F.sum("copies").alias("copies"), F.max("copies").alias("most"), F.sum(F.col("copies") * F.col("tokens")).alias("mix_tokens"))
    j = source_rates(counts, targets, size).join(got, "source", "left").fillna(0, ["used", "copies", "most", "mix_tokens"])
    total = got.agg(F.sum("mix_tokens").alias("mix_size"))
    share = F.when(F.col("mix_size") > 0, F.col("mix_tokens") / F.col("mix_size")).otherwise(F.lit(0.0))
    return j.crossJoin(total).select("source", "documents", "used", "copies", "most", "tokens", "mix_tokens", "rate", "short", F.round("target_share", 6).alias("target_share"), F.round(share, 6).alias("share"), F.round(share - F.col("target_share"), 6).alias("difference"))
