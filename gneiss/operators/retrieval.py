"""Vectors and exact search of passages and their pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.text import citation
from gneiss.operators.stores import latest

Embedder = Callable[[DataFrame, str], DataFrame]  # adds the column ``embedding`` for a column of text
EMBEDDERS: dict[str, Embedder] = {}


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalized(v: Column) -> Column:
    """A vector of length 1; one of zeros stays."""
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def dot(a: Column, b: Column) -> Column:
    """The dot product; NULL where the sizes differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def hash_embedding(df: DataFrame, text: str, keys: list[str], dimension: int = 64) -> DataFrame:
    """``keys`` and ``embedding``: words in lower case counted in ``sha1 mod dimension`` buckets, then normalized.

    ``dimension`` is a power of two. Rows without words have a vector of zeros.
    """
    if dimension & (dimension - 1):
        raise ValueError("dimension must be a power of two")
    words = df.select(*keys, F.explode(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")).alias("w"))
    bucket = F.pmod(F.conv(F.right(F.sha1("w"), F.lit(8)), 16, 10).cast("long"), F.lit(dimension)).cast("int")
    counts = words.groupBy(*keys, bucket.alias("b")).agg(F.count("*").alias("n"))
    maps = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))  # at most ``dimension`` entries
    vector = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("double"))
    return df.select(*keys).join(maps, keys, "left").withColumn("m", F.coalesce("m", F.expr("cast(map() as map<int,bigint>)"))).select(*keys, l2_normalized(vector).alias("embedding"))


EMBEDDERS["hash"] = lambda df, text: hash_embedding(df, text, [c for c in df.columns if c != text])


def top_chunks(chunks: DataFrame, query: list[float], pool: int, sources: list[str] | None = None) -> DataFrame:
    """The ``pool`` passages nearest to the query by dot product, ties by id. Vectors of another size or NULL are none; no sources mean all."""
    kept = chunks.filter(F.col("source").isin(*sources)) if sources else chunks
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = kept.select("chunk_id", "parent_id", dot(F.col("embedding"), q).alias("score")).filter("score is not null").distinct()
    return scored.orderBy(F.desc("score"), "chunk_id").limit(pool)


def search(chunks: DataFrame, parents: DataFrame, query: list[float], child_pool: int = 15, max_parents: int = 4, sources: list[str] | None = None) -> DataFrame:
    """``(parent_id, source, page, text, score)`` of the pages of the nearest passages, best first.

    Pages are taken from the pool of passages only, so there may be fewer than ``max_parents``; a passage without a page takes a place and has no row.
    """
    pool = top_chunks(chunks, query, max(child_pool, max_parents), sources)
    best = pool.groupBy("parent_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "parent_id").limit(max_parents)
    pages = parents.select("parent_id", "source", "page", "text").distinct()
    return F.broadcast(best).join(pages, "parent_id").select("parent_id", "source", "page", "text", "score").orderBy(F.desc("score"), "parent_id")  # max_parents rows


def snippets(found: DataFrame) -> DataFrame:
    """``(citation, text, score)`` of the pages that ``search`` found, the score to four places. A page without source or number has no citation."""
    return found.select(citation(F.col("source"), F.col("page")).alias("citation"), "text", F.round("score", 4).alias("score"))


def with_pages(chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """``(chunk_id, source, page, page_id)``: the page that each passage is from by source and number; NULL where none has arrived.

    Of pages ingested again the last counts. Passages without source or number have no page; repeated rows count once.
    """
    pages = latest(parents.select("source", "page", "parent_id", "ingested_at"), ["source", "page"], ["ingested_at", "parent_id"])
    return chunks.select("chunk_id", "source", "page").distinct().join(pages.select("source", "page", F.col("parent_id").alias("page_id")), ["source", "page"], "left").select("chunk_id", "source", "page", "page_id")


def vector_sizes(chunks: DataFrame) -> DataFrame:
    """``(dimension, passages)``: how many passages have a vector of each size, -1 for none."""
    return chunks.select("chunk_id", "embedding").distinct().groupBy(F.coalesce(F.size("embedding"), F.lit(-1)).alias("dimension")).agg(F.count("*").alias("passages"))


def batch_search(queries: DataFrame, chunks: DataFrame, pool: int, blocks: int = 8) -> DataFrame:
    """``(query_id, chunk_id, score, rank)``: the ``pool`` nearest passages of every row of ``queries`` (query_id, vector), ties by the passage's id.

    Queries are a stated set held against all passages. Both sides are packed, passages a few thousand a row and queries into ``blocks`` rows, and a row of one is multiplied with a row of the
    other; of each product only the best ``pool`` of a query are kept. Passages are read once. More queries take more ``blocks``, so that one row stays small. NULL vectors and those of another
    size than the query's match nothing; repeated rows count once.
    """
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa
    from pyspark.sql import Window

    kind = queries.schema["query_id"].dataType.simpleString()
    packed = queries.filter("vector is not null").groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("query_id", F.col("vector").cast("array<double>").alias("vector"))).alias("queries"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column(1).offsets.to_numpy())
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for n in np.unique(size).tolist():
                rows = pa.array(np.flatnonzero(size == n))
                v = batch.column(1).take(rows).flatten()
                flat = np.nan_to_num(v.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n), nan=np.nan)
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([ids[rows.to_numpy()].astype("<i8").tobytes()]), pa.array([flat.tobytes()])], ["size", "ids", "vectors"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, ids, data, qs in zip(*(batch.column(i).to_pylist() for i in range(4))):
                qs = [q for q in qs if len(q["vector"]) == n]
                if not qs or not n:
                    continue
                chunk, v = np.frombuffer(ids, "<i8"), np.frombuffer(data).reshape(-1, n)
                out = []
                for q in qs:
                    score = v @ np.array(q["vector"], dtype=np.float64)
                    usable = np.flatnonzero(~np.isnan(score))
                    top = usable[np.lexsort((chunk[usable], -score[usable]))[:pool]]
                    out += [(q["query_id"], int(chunk[i]), float(score[i])) for i in top]
                yield pa.RecordBatch.from_pylist([dict(zip(("query_id", "chunk_id", "score"), r)) for r in out], schema=schema)

    schema = pa.schema([("query_id", pa.int64() if kind == "bigint" else pa.string()), ("chunk_id", pa.int64()), ("score", pa.float64())])
    rows = chunks.select(F.col("chunk_id").cast("long"), "embedding").filter("embedding is not null").mapInArrow(pack, "size int, ids binary, vectors binary")
    each = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(packed, "block").select("size", "ids", "vectors", "queries")
    scored = each.mapInArrow(multiply, f"query_id {kind}, chunk_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return scored.distinct().withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= pool)


def search_or_reason(chunks: DataFrame, parents: DataFrame, query: list[float] | None, **options) -> tuple[DataFrame, str | None]:
    """``search`` and why it is empty: no query, no passages with vectors of the query's size, or nothing found; None where there are rows."""
    none = parents.select("parent_id", "source", "page", "text", F.lit(0.0).alias("score")).limit(0)
    if not query or not any(query):
        return none, "the query is empty"
    if chunks.filter(F.size("embedding") == len(query)).isEmpty():
        return none, f"there are no passages with vectors of {len(query)} numbers"
    found = search(chunks, parents, query, **options)
    return (none, "no page was found") if found.isEmpty() else (found, None)


def embedder(name: str, dimension: int) -> Embedder:
    """The embedder of a name, whose vectors are checked: one of another size than ``dimension`` ends the query that computes it."""
    if name not in EMBEDDERS:
        raise ValueError(f"no embedder {name}; there are {', '.join(sorted(EMBEDDERS))}")
    make = EMBEDDERS[name]

    def checked(df: DataFrame, text: str) -> DataFrame:
        size = F.size("embedding")
        fault = F.raise_error(F.concat(F.lit(f"a vector of {name} has not {dimension} numbers but "), size.cast("string")))
        return make(df, text).withColumn("embedding", F.when(size == dimension, F.col("embedding")).otherwise(fault))

    return checked
