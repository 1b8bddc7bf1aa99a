"""Schemas of the stores."""

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


ASSETS = _strings("asset_title", "source_url", "notes", "dynamic_payload")
UNITS = _strings("unit_key", "unit_name", "service", "branch", "role", "theater_command", "location_text", "province", "airbase", "tactical_code", "remarks", "source_url")
LINKS = _strings("unit_key", "raw_designator", "cn_designator", "en_designator")
PARENTS = T.StructType([T.StructField("parent_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType())])
CHUNKS = T.StructType(
    [T.StructField("chunk_id", T.LongType()), T.StructField("parent_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]
)
META = _strings("key", "value")
STORES = {"weg_assets": ASSETS, "units": UNITS, "unit_aircraft": LINKS, "rag_parents": PARENTS, "rag_chunks": CHUNKS, "rag_meta": META}
