"""Queries of the core operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pyspark.sql import Window

from gneiss.functions import codes, scenario, text
from gneiss.operators.carry import carry
from gneiss.operators import catalog, chunking, hub, laydown, metrics, nested, references, retrieval, stores, units
from gneiss.sources import articles, files, layout
from gneiss.tables import table

#: Prefixes of the designators in these tables, and places that their texts speak of.
PREFIXES = [("渊锋镝", "ZKX"), ("炽珀鹳", "TZP"), ("晖砾铎", "FBN"), ("溟澍", "DBK")]
PLACES = {"field manual": ["Eastmarch", "Westfold"], "manual": ["Westfold"], "outpost": ["Eastmarch"], "coastal outpost": ["Northmarch"]}
HINTS = [("tanker", "transport"), ("trainer", "training"), ("drone", "uav"), ("airframe", "fighter")]
QUERY = [0.5, -0.25, 0.125, 1.0, -1.0, 0.75, 0.0, 0.3]


def p2_found(spark, d):
    return references.all_references(*[table(spark, d, n) for n in ("unit_aircraft", "weg_assets", "rag_chunks", "rag_parents")])


def p2_by_month(spark, d):
    return p2_found(spark, d).groupBy("ref_table", "ref_month", "reason").agg(F.count("*").alias("refs"))


def p4_found(spark, d):
    return nested.flat_objects(table(spark, d, "weg_assets"))


def p4_assets(spark, d):
    return nested.flat_assets(table(spark, d, "weg_assets"))


def p4_sections(spark, d):
    return nested.flat_sections(table(spark, d, "weg_assets"))


def p4_fields(spark, d):
    return nested.flat_fields(table(spark, d, "weg_assets"))


def p5_found(spark, d):
    return units.given_values(table(spark, d, "weg_assets"))


def p5_values(spark, d):
    return units.common_units(table(spark, d, "weg_assets"))


def p5_masked(spark, d):
    """How well units that are known are told without them."""
    return units.masked_accuracy(table(spark, d, "weg_assets"))


def p5_inferred(spark, d):
    """How many bare numbers were given which unit, and how many of them doubtfully."""
    v = units.common_units(table(spark, d, "weg_assets")).filter("unit_source = 'inferred'")
    return v.groupBy("quantity", "unit").agg(F.count("*").alias("readings"), F.count(F.when(F.col("uncertain"), 1)).alias("doubtful"))



def _assets(spark, d):
    """The last row of each title."""
    return stores.latest(table(spark, d, "weg_assets").filter("asset_title is not null"), ["asset_title"], ["ingested_at", "asset_seq"])


def _units(spark, d):
    return stores.latest(table(spark, d, "units").filter("unit_key is not null"), ["unit_key"], ["ingested_at"])


def _links(spark, d):
    return stores.earliest(table(spark, d, "unit_aircraft"), ["unit_key", "raw_designator"], ["ingested_at", "link_id"])


def _pages(spark, d):
    return table(spark, d, "rag_parents").select("source", F.col("parent_id").alias("page_id"), "text").distinct()


def _chunks(spark, d):
    return table(spark, d, "rag_chunks").select("chunk_id", "parent_id", "source", "embedding").distinct()


def laydown_prefix_join(spark, d):
    return laydown.capability_laydown(_units(spark, d), _links(spark, d), _assets(spark, d), limit=None)


def laydown_filtered(spark, d):
    return laydown.capability_laydown(_units(spark, d), _links(spark, d), _assets(spark, d), designator="TZP-2", service="guard", theater="march", limit=100)


def laydown_chinese(spark, d):
    j = _links(spark, d).filter(laydown.designator_filter("溟澍-27", PREFIXES))
    return j.select("unit_key", "raw_designator", "en_designator")


def laydown_linked(spark, d):
    return laydown.linked_counts(laydown_prefix_join(spark, d))


def capability_view(spark, d):
    return laydown.capability_view(laydown_prefix_join(spark, d))


def laydown_view(spark, d):
    return laydown.laydown_view(laydown_prefix_join(spark, d))


def laydown_specs(spark, d):
    titles = _assets(spark, d).select("asset_seq", F.col("asset_title").alias("weg_asset_title"), "dynamic_payload")
    specs = catalog.specs(titles).join(titles.select("asset_seq", "weg_asset_title"), "asset_seq").drop("asset_seq")
    return laydown.laydown_specs(laydown_prefix_join(spark, d), specs)


def flatten_first_wins(spark, d):
    return catalog.specs(table(spark, d, "weg_assets"))


def catalog_search(spark, d):
    return catalog.search_assets(_assets(spark, d), title="trainer", origin_like="velmora", domain_like="air", limit=50)


def catalog_point(spark, d):
    found = catalog.asset(_assets(spark, d), "DBK-272 Ostrelian Survey Drone")
    return found.select("asset_title", "asset_seq", F.size(F.map_keys("payload")).alias("sections"))


def origin_filter(spark, d):
    return catalog.of_origin(table(spark, d, "weg_assets"), "velmora").select("asset_seq", "asset_title")


def origin_filter_limit(spark, d):
    return catalog.of_origin(table(spark, d, "weg_assets"), "tarsk", 25).select("asset_seq", "asset_title")


def origin_filter_source(spark, d):
    return catalog.first_of_source(table(spark, d, "weg_assets"), 200, "velmora").select("asset_seq", "asset_title")


def catalog_sample(spark, d):
    return catalog.sample_asset(_assets(spark, d), "TZP-2").select("asset_title", "asset_seq")


def json_path_counts(spark, d):
    return catalog.count_origins(_assets(spark, d))


def category_breakdown(spark, d):
    return catalog.category_breakdown(_assets(spark, d))


def category_of_origin(spark, d):
    return catalog.category_breakdown(_assets(spark, d), "velmora")


def share_of_total(spark, d):
    return catalog.shares(catalog.category_breakdown(_assets(spark, d)))


def json_sections(spark, d):
    return catalog.section_names(_assets(spark, d))


def json_section_fetch(spark, d):
    return catalog.section(_assets(spark, d), "Metadata").filter("section is not null")


def search_units(spark, d):
    return hub.search_units(_units(spark, d), service="sky", role="transport", limit=50).select("unit_key", "unit_name", "service", "role")


def unit_point(spark, d):
    u = hub.unit(_units(spark, d), _links(spark, d), "Squadron 131 Calorvik")
    return u.select("unit_key", "role", F.array_join("aircraft", ";").alias("aircraft"))


def hub_with_children(spark, d):
    return hub.with_aircraft(_units(spark, d), _links(spark, d)).select("unit_key", "unit_name", F.array_join("aircraft", ";").alias("aircraft"))


def units_for_item_semi(spark, d):
    return hub.units_for_aircraft(_units(spark, d), _links(spark, d), "dbk-2", None).select("unit_key", "unit_name", "theater_command")


def inventory_distinct(spark, d):
    return hub.aircraft_inventory(_units(spark, d), _links(spark, d))


def inventory_of_service(spark, d):
    return hub.aircraft_inventory(_units(spark, d), _links(spark, d), "coast")


def role_breakdown(spark, d):
    return hub.role_breakdown(_units(spark, d))


def theater_breakdown(spark, d):
    return hub.theater_breakdown(_units(spark, d))


def row_counts(spark, d):
    return stores.row_counts(**{n: table(spark, d, n) for n in ("weg_assets", "units", "unit_aircraft", "rag_parents", "rag_chunks")})


def upsert_latest(spark, d):
    return _assets(spark, d).select("asset_title", "asset_seq", "ingested_at")


def upsert_events(spark, d):
    return stores.latest(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


def insert_or_ignore(spark, d):
    return _links(spark, d).select("unit_key", "raw_designator", "link_id")


def cascade_links(spark, d):
    """Links of units that exist."""
    return _links(spark, d).join(_units(spark, d).select("unit_key"), "unit_key", "left_semi").select("unit_key", "raw_designator")


def vector_topk(spark, d):
    return retrieval.top_chunks(_chunks(spark, d), QUERY, 15).select("chunk_id", "parent_id", F.round("score", 6).alias("score"))


def vector_topk_parent(spark, d):
    found = retrieval.search(_chunks(spark, d), table(spark, d, "rag_parents"), QUERY)
    return found.select("parent_id", text.citation(F.col("source"), F.col("page")).alias("citation"), F.round("score", 4).alias("score"))


def vector_topk_sources(spark, d):
    found = retrieval.top_chunks(_chunks(spark, d), QUERY, 15, ["composite_field_manual.pdf"])
    return found.select("chunk_id", F.round("score", 6).alias("score"))


def context_snippets(spark, d):
    s = retrieval.snippets(retrieval.search(_chunks(spark, d), table(spark, d, "rag_parents"), QUERY))
    return s.select("citation", F.md5("text").alias("digest"), "score")


def passage_pages(spark, d):
    return retrieval.with_pages(table(spark, d, "rag_chunks"), table(spark, d, "rag_parents"))


def vector_sizes(spark, d):
    return retrieval.vector_sizes(table(spark, d, "rag_chunks"))


def vector_batch(spark, d):
    """The ten nearest vectors of each of those whose id is divisible by 20, among all."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    q = v.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.batch_search(q, v, 10).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def l2_normalize(spark, d):
    n = _chunks(spark, d).filter("embedding is not null").select("chunk_id", retrieval.l2_normalized(F.col("embedding")).alias("v"))
    return n.select("chunk_id", F.size("v").alias("size"), F.round(retrieval.norm(F.col("v")), 6).alias("norm"), F.round(F.try_element_at("v", F.lit(1)), 6).alias("first"))


def hash_embed(spark, d):
    e = retrieval.hash_embedding(table(spark, d, "gold_cases"), "query_text", ["id"], 64)
    return e.select("id", F.posexplode("embedding").alias("bucket", "weight")).filter("weight <> 0").select("id", "bucket", F.round("weight", 6).alias("weight"))


def _retrieved(spark, d):
    """The ten pages nearest to each case's query and quotes, by hash embeddings."""
    pages = table(spark, d, "rag_parents").select("parent_id", "source", "page", "text").filter("parent_id is not null").distinct()
    vectors = retrieval.hash_embedding(pages, "text", ["parent_id"], 64).withColumnRenamed("parent_id", "chunk_id")
    said = table(spark, d, "gold_cases").select("id", F.concat_ws(" ", "query_text", F.array_join(F.transform("expected", lambda e: e["quote"]), " ")).alias("said"))
    asked = retrieval.hash_embedding(said, "said", ["id"], 64).select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    found = retrieval.batch_search(asked, vectors, 10)
    return found.join(pages, found["chunk_id"] == pages["parent_id"]).select(F.col("query_id").alias("id"), "rank", "source", "page")


def ir_metrics(spark, d):
    m = metrics.case_metrics(_retrieved(spark, d), table(spark, d, "gold_cases"))
    return m.select("id", "labels", "hit", "source_hit", "best_rank", *[F.round(c, 6).alias(c) for c in ("reciprocal_rank", "precision", "recall", "ndcg")])


def ir_summary(spark, d):
    m = metrics.summary(metrics.case_metrics(_retrieved(spark, d), table(spark, d, "gold_cases"), 10, 3), 10)
    return m.select("cases", "labels", "unverified", *[F.round(c, 6).alias(c) for c in ("hit_rate", "source_hit_rate", "mrr", "mean_precision", "mean_recall", "mean_ndcg", "micro_precision", "micro_recall")])


def ir_to_inspect(spark, d):
    return metrics.to_inspect(metrics.case_metrics(_retrieved(spark, d), table(spark, d, "gold_cases")))


def ir_right_pages(spark, d):
    return metrics.right_pages(_retrieved(spark, d), table(spark, d, "gold_cases"))


def _retrieved_all(spark, d):
    """A plain retrieval: pages of all sources that a case expects, from the last page on."""
    cases = metrics.expected_pages(table(spark, d, "gold_cases")).select("id", "source").distinct()
    pages = table(spark, d, "rag_parents").select("source", "page").distinct()
    w = Window.partitionBy("id").orderBy(F.desc("page"), "source")
    return cases.join(pages, "source").withColumn("rank", F.row_number().over(w)).filter("rank <= 10").select("id", "rank", "source", "page")


def ir_all_metrics(spark, d):
    """As ``ir_metrics``, where a case's pages are retrieved from all the sources that it expects."""
    m = metrics.case_metrics(_retrieved_all(spark, d), table(spark, d, "gold_cases"))
    return m.select("id", "labels", "hit", "source_hit", "best_rank", *[F.round(c, 6).alias(c) for c in ("reciprocal_rank", "precision", "recall", "ndcg")])


def ir_all_summary(spark, d):
    m = metrics.summary(metrics.case_metrics(_retrieved_all(spark, d), table(spark, d, "gold_cases"), 10, 3), 10)
    return m.select("cases", "labels", "unverified", *[F.round(c, 6).alias(c) for c in ("hit_rate", "source_hit_rate", "mrr", "mean_precision", "mean_recall", "mean_ndcg", "micro_precision", "micro_recall")])


def ir_all_to_inspect(spark, d):
    return metrics.to_inspect(metrics.case_metrics(_retrieved_all(spark, d), table(spark, d, "gold_cases")))


def ir_all_right_pages(spark, d):
    return metrics.right_pages(_retrieved_all(spark, d), table(spark, d, "gold_cases"))


def quote_validation(spark, d):
    return metrics.quote_validation(table(spark, d, "gold_cases"), table(spark, d, "rag_parents"))


def anti_missing_refs(spark, d):
    return metrics.missing_sources(table(spark, d, "gold_cases"), table(spark, d, "rag_parents"))


def boilerplate_keys(spark, d):
    return chunking.boilerplate_keys(_pages(spark, d), repeat_frac=0.05, min_pages=2)


def strip_boilerplate(spark, d):
    return chunking.stripped_pages(_pages(spark, d), repeat_frac=0.05, min_pages=2)


def chunk_windows(spark, d):
    w = chunking.word_windows(_pages(spark, d), ["page_id"])
    return w.select("page_id", "child_no", "words", F.md5("text").alias("digest")).distinct()


def code_normalize(spark, d):
    c = table(spark, d, "unit_aircraft").select("raw_designator").distinct().filter("raw_designator is not null")
    p = codes.normalized(F.col("raw_designator"), PREFIXES, [])
    return c.select("raw_designator", p["cn_base"].alias("cn_base"), p["en_base"].alias("en_base"))


def cell_split(spark, d):
    """Each unit's links written as one cell, and split again."""
    cells = hub.with_aircraft(_units(spark, d), _links(spark, d)).select("unit_key", F.array_join("aircraft", "、").alias("cell"))
    parts = codes.known_only(codes.split_cell(F.col("cell"), PREFIXES, []))
    return cells.select("unit_key", F.size(parts).alias("known"), F.array_join(F.transform(parts, lambda p: p["en_base"]), ";").alias("bases"))


def scenario_resolve(spark, d):
    r = scenario.resolved(F.col("text"), places=PLACES, hints=HINTS)
    x = table(spark, d, "documents").select("doc_id", r.alias("r"))
    return x.select("doc_id", "r.designator", F.array_join("r.theaters", "+").alias("theaters"), "r.role", "r.matched_location")


def retrieval_text(spark, d):
    c = table(spark, d, "documents").select("doc_id", scenario.retrieval_text(F.col("source"), F.col("subject_code"), F.col("lang")).alias("q"))
    return c


def _lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def kv_lines(spark, d):
    """Label and value of every line of a document that has both; lines count from 0."""
    x = _lines(spark, d).select("doc_id", "line_no", layout.key_value(F.col("line")).alias("kv"))
    return x.filter("kv is not null").select("doc_id", "line_no", F.col("kv.k").alias("label"), F.col("kv.v").alias("value"))


def kv_parse(spark, d):
    """How often each label stands in each document, over all lines."""
    return kv_lines(spark, d).groupBy("doc_id", "label").agg(F.count("*").alias("lines"), F.min("value").alias("least"), F.max("value").alias("most"))


def line_classify(spark, d):
    """Lines told apart by a size that stands for their type: long lines are body, short ones headings."""
    size = F.when(F.length("line") < 40, 14.0).when(F.length("line") < 80, 11.0).when(F.length("line") < 160, 9.0).otherwise(8.0)
    return _lines(spark, d).groupBy(layout.line_kind(size).alias("kind")).agg(F.count("*").alias("lines"))


def carry_state(spark, d):
    """For every line of a document the last line so far that begins a sentence with "In" or "For", cleared by blank lines."""
    opens = F.col("line").rlike("^(In|For) ")
    state = F.when(opens | (F.col("line") == ""), F.struct(F.when(opens, F.col("line_no")).alias("v")))
    return carry(_lines(spark, d), "doc_id", "line_no", 4096, last={"state": state}).select("doc_id", "line_no", F.col("state.v").alias("carried"))


def segment_runs(spark, d):
    """Runs of short and of long lines in each document."""
    x = carry(_lines(spark, d).withColumn("short", F.length("line") < 80), "doc_id", "line_no", 4096, before={"was": F.col("short")})
    x = carry(x, "doc_id", "line_no", 4096, total={"run": F.coalesce((F.col("short") != F.col("was")).cast("int"), F.lit(1))})
    return x.groupBy("doc_id", "run").agg(F.count("*").alias("lines"), F.min("line_no").alias("first"))


def layout_titles(spark, d):
    """Documents read as pages of a catalogue: the first line is a title, lines after blank ones are sections."""
    x = _lines(spark, d).select(F.col("doc_id").cast("string").alias("doc"), F.col("line_no").cast("long"), F.col("line").alias("text"), F.when(F.col("line_no") == 0, 14.0).when(F.length("line") < 300, 11.0).otherwise(8.0).alias("size"), F.lit("Serif").alias("font"))
    return layout.parse_layout(x.filter("text <> ''")).select("doc", "asset_seq", "asset_title")


def airbase_extract(spark, d):
    """The facility in the name of a place, at its end or before another part."""
    digits = F.translate(F.regexp_replace("unit_key", "[^0-9]", ""), "0123456789", "零一二三四五六七八九")
    p = F.concat(F.lit("江右省"), digits, F.when(F.col("airbase").isNull(), "镇").otherwise("机场"), F.when(F.col("tactical_code").isNull(), "").otherwise("三营"))
    return _units(spark, d).select("unit_key", articles.airbase_of(p).alias("airbase"))


#: How the units of these tables are called in articles.
SERVICE_NAMES = [("Skyguard", "空军"), ("Coastwing", "海军"), ("Home Reserve", "院校训练部队")]
ROLE_NAMES = [("fighter", "歼击机"), ("bomber", "轰炸机"), ("transport", "运输机"), ("academy", "学院")]
THEATER_NAMES = [("Northreach", "北部战区"), ("Eastmarch", "东部战区"), ("Southmere", "南部战区"), ("Westfold", "西部战区"), ("Midland", "中部战区")]


def _named(c: str, names, other: str | None = None):
    return F.coalesce(*[F.when(F.col(c) == a, F.lit(b)) for a, b in names], F.lit(other))


def _article_lines(spark, d):
    """Every unit as a part of a Markdown article: headings, its table, and a table of another kind. A third of the units have a heading of their service, others a theater."""
    u = hub.with_aircraft(_units(spark, d), _links(spark, d)).withColumn("h", F.md5("unit_key"))
    digits = F.translate(F.regexp_replace("unit_key", "[^0-9]", ""), "0123456789", "零一二三四五六七八九")
    part = lambda c, t: F.when(F.col(c).isNotNull(), t).otherwise("")
    place = F.concat(part("province", F.lit("江右省")), part("location_text", F.lit("望北市")), part("airbase", F.concat(digits, F.lit("机场"))))
    blank = lambda c: F.coalesce(c, F.lit(""))
    row = F.concat(F.lit("| ["), blank("unit_name"), F.lit("](http://x.example/u) | "), place, F.lit(" | "), F.array_join("aircraft", "、"), F.lit(" | "), blank("tactical_code"), F.lit(" | "), blank("remarks"), F.lit(" |"))
    lines = F.array(
        F.when(F.substring("h", 11, 1) < "6", F.concat(F.lit("## "), _named("service", SERVICE_NAMES, "其他"))),
        F.concat(F.lit("### "), F.coalesce("branch", F.lit("某")), F.lit("部队[注 1]")),
        F.concat(F.lit("#### "), _named("role", ROLE_NAMES, "其他")),
        F.concat(F.lit("##### "), _named("theater_command", THEATER_NAMES)),
        F.lit("| 航空兵部队 | 装备 |"), F.lit("| --- | :-: |"), row, F.lit(""), F.lit("| 名称 | 装备 |"), F.lit("| 甲 | 溟澍-1 |"),
    )
    first = F.conv(F.substring("h", 3, 8), 16, 10).cast("long") * 16
    return u.select(F.substring("h", 1, 2).alias("doc"), first.alias("first"), "source_url", F.posexplode(lines).alias("i", "text")).filter("text is not null").select("doc", (F.col("first") + F.col("i")).alias("line_no"), "text", "source_url")


def article_units(spark, d):
    """Units read from articles, by ``parse_articles``."""
    a = articles.parse_articles(_article_lines(spark, d), keep_empty=True, prefixes=PREFIXES, names=[])
    return a.withColumn("aircraft", F.array_join(F.transform("aircraft", lambda p: p["en_base"]), ";"))


def article_units_fielding(spark, d):
    """As ``article_units``, only units with aircraft."""
    return articles.parse_articles(_article_lines(spark, d), prefixes=PREFIXES, names=[]).select("doc", "line_no", "unit_key")


def _layout_lines(spark, d):
    """Every asset as lines of a catalogue with their type size: a title on two lines, fields, notes, noise, and a section for each member of its document."""
    a = table(spark, d, "weg_assets").filter(text.strip(F.col("asset_title")) != "").withColumn("names", F.array_distinct(F.coalesce(F.json_object_keys("dynamic_payload"), F.array().cast("array<string>"))))
    line = lambda t, size, font="Serif": F.struct(t.alias("text"), F.lit(size).alias("size"), F.lit(font).alias("font"))
    title = text.collapse(F.col("asset_title"))
    head = F.array(
        line(F.substring_index(title, " ", 1), 14.0), line(F.nullif(F.regexp_replace(title, "^[^ ]* ?", ""), F.lit("")), 15.5), line(F.concat(F.lit("WEG Location: "), "source_url"), 8.0),
        line(F.concat(F.lit("Tier: "), F.col("asset_seq").cast("string")), 8.0), line(F.lit("Notes"), 11.0), line(F.nullif(text.collapse(F.col("notes")), F.lit("")), 8.0),
        line(F.lit("For Training Use Only"), 12.0), line(F.lit("Exported (UTC) @ 1"), 8.0), line(F.lit("17"), 14.0, "Helvetica-Bold"),
    )
    kept = F.filter("names", lambda k: ~k.isin("Metadata", "Notes") & (text.collapse(k) != ""))
    body = F.flatten(F.transform(kept, lambda k: F.array(line(text.collapse(k), 11.0), line(F.lit("Crew: 2"), 8.9), line(F.lit("free"), 8.0), line(F.concat(F.lit("Crew: of "), text.collapse(k)), 8.0), line(F.lit("text"), 8.0), line(F.lit("Part"), 9.0), line(F.lit("Kind: x"), 8.0))))
    x = a.select(F.substring(F.md5(F.col("asset_seq").cast("string")), 1, 2).alias("doc"), "asset_seq", F.posexplode(F.concat(head, body)).alias("i", "l"))
    return x.filter("l.text is not null").select("doc", (F.col("asset_seq") * 100000 + F.col("i")).alias("line_no"), "l.text", "l.size", "l.font")


def layout_assets(spark, d):
    """Catalogue assets read from lines with their type size, by ``parse_layout``."""
    return layout.parse_layout(_layout_lines(spark, d), size=100000 * 4096)


def layout_spans(spark, d):
    """Lines put together again from their words, read as spans with a type size and font."""
    words = _lines(spark, d).select(F.col("doc_id").cast("string").alias("doc"), F.lit(1).alias("page"), F.lit(0).alias("block"), F.col("line_no").alias("line"), F.posexplode(F.split("line", " ")).alias("span", "text"))
    spans = words.withColumn("size", 8.0 + F.length("text") % 7).withColumn("font", F.concat(F.lit("F"), (F.length("text") % 3).cast("string")))
    return files.lines_of_spans(spans).select("doc", "line_no", F.md5("text").alias("digest"), "size", "font")


def unit_key_synthesis(spark, d):
    u = table(spark, d, "units").distinct()
    return u.select("unit_key", articles.unit_key(F.col("unit_name"), F.col("role"), F.col("location_text")).alias("made")).distinct()


def quote_fold(spark, d):
    g = metrics.expected_pages(table(spark, d, "gold_cases")).filter("quote is not null")
    return g.select("id", F.md5(text.folded(F.col("quote"))).alias("folded"), text.shortened(F.col("source"), 20).alias("source")).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_by_month, p4_found, p4_assets, p4_sections, p4_fields, p5_found, p5_values, p5_inferred, p5_masked,
        laydown_prefix_join, laydown_filtered, laydown_chinese, laydown_linked, capability_view, laydown_view, laydown_specs, flatten_first_wins,
        catalog_search, catalog_point, origin_filter, origin_filter_limit, origin_filter_source, catalog_sample, json_path_counts, category_breakdown, category_of_origin, share_of_total, json_sections, json_section_fetch,
        search_units, unit_point, hub_with_children, units_for_item_semi, inventory_distinct, inventory_of_service, role_breakdown, theater_breakdown,
        row_counts, upsert_latest, upsert_events, insert_or_ignore, cascade_links,
        vector_topk, vector_topk_parent, vector_topk_sources, context_snippets, passage_pages, vector_sizes, vector_batch, l2_normalize, hash_embed,
        ir_metrics, ir_summary, ir_to_inspect, ir_right_pages, ir_all_metrics, ir_all_summary, ir_all_to_inspect, ir_all_right_pages, quote_validation, anti_missing_refs, boilerplate_keys, strip_boilerplate, chunk_windows,
        code_normalize, cell_split, scenario_resolve, retrieval_text, kv_parse, kv_lines, line_classify, carry_state, segment_runs, layout_titles, article_units, article_units_fielding, layout_assets, layout_spans, airbase_extract, unit_key_synthesis, quote_fold,
    )
}
