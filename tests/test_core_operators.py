"""The catalogue, units, laydown, retrieval, parsing and store operators on small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gneiss.functions import codes, scenario, text
from gneiss.operators import catalog, chunking, hub, laydown, metrics, retrieval, stores
from gneiss.operators.carry import carry
from gneiss.sources import articles, files, layout
from gneiss.streaming import upserts

ASSETS = "asset_seq long, asset_title string, source_url string, notes string, dynamic_payload string"


@pytest.fixture(scope="module")
def assets(spark):
    p = '{"Metadata": {"Origin": "Aland", "Domain": "Air, Trainers, "}, "System": {"Crew": "2", "Image Sources": "x"}, "Automotive": {"Crew": "9", "Top": {"A.b": 1, "L": ["x", {"Deep": true}]}, "N": null}}'
    rows = [(1, "AB-1 (PIN) Trainer", "u", None, p), (2, "ab-10 Tanker", None, "n", '{"Metadata": {"Origin": ["Bland", "Aland"]}}'), (3, "Two Words Jet", "", "", '{"Metadata": {"Origin": ""}}'), (4, None, None, None, None), (5, "AB-1X", None, None, "{bad")]
    return spark.createDataFrame(rows, ASSETS)


@pytest.fixture(scope="module")
def units(spark):
    rows = [("u1", "Wing 1", "Sky", "fighter", "East"), ("u2", "Wing 2", "Sky", None, None), ("u3", None, "Sea", "", "West"), (None, "x", None, None, None)]
    u = spark.createDataFrame(rows, "unit_key string, unit_name string, service string, role string, theater_command string")
    return u.withColumns({c: F.lit(None).cast("string") for c in ("branch", "location_text", "airbase")})


@pytest.fixture(scope="module")
def links(spark):
    rows = [("u1", "歼-1A", "歼-1", "AB-1"), ("u1", "歼-1B", "歼-1", "AB-1"), ("u2", "AB-10", None, "ab-10"), ("u3", "zz", "zz", None), ("u9", "q", None, "Two Words"), ("u3", "w", "", "two words")]
    return spark.createDataFrame(rows, "unit_key string, raw_designator string, cn_designator string, en_designator string")


def test_catalogue(assets):
    assert [r[0] for r in catalog.search_assets(assets, title="ab-1", limit=2).collect()] == ["AB-1 (PIN) Trainer", "AB-1X"]
    assert catalog.search_assets(assets, limit=-1).count() == 5 and catalog.search_assets(assets, origin_like="aland").count() == 2
    assert catalog.search_assets(assets, title="a%1").count() == 3
    assert {tuple(r) for r in catalog.count_origins(assets).collect()} == {("Aland", 1), ('["Bland","Aland"]', 1), ("(unknown)", 3)}
    assert {tuple(r) for r in catalog.category_breakdown(assets).collect()} == {("Trainers", 1), ("(uncategorized)", 4)}
    assert [r[2] for r in catalog.section_names(assets).filter("asset_title like 'AB-1 %'").orderBy("position").collect()] == ["Metadata", "System", "Automotive"]
    assert {r[0] for r in catalog.of_origin(assets, "ALAND").select("asset_seq").collect()} == {1, 2}
    assert catalog.asset(assets, "nothing").count() == 0
    assert [r[0] for r in catalog.first_of_source(assets, 1, "ALAND").select("asset_seq").collect()] == [1]
    assert catalog.sample_asset(assets, "AB-1X").first()["asset_title"] == "AB-1X"
    assert catalog.sample_asset(assets, "none").first()["asset_title"] == min(r[0] for r in assets.select("asset_title").collect() if r[0] is not None)
    assert catalog.sample_asset(assets.limit(0), "AB").count() == 0
    total = catalog.shares(catalog.count_origins(assets)).agg(F.sum("percent")).first()[0]
    assert total == pytest.approx(100)
    assert catalog.count_origins(assets.limit(0)).count() == catalog.category_breakdown(assets.limit(0)).count() == 0


def test_specs_keep_the_first_and_drop_bare_items(assets):
    got = {r["spec"]: r["value"] for r in catalog.specs(assets).filter("asset_seq = 1").collect()}
    assert got == {"Crew": "2", "A.b": "1", "Deep": "True", "N": "None"}


def test_units(units, links):
    assert {tuple(r) for r in hub.role_breakdown(units).collect()} == {("fighter", 1), ("(unknown)", 3)}
    assert {tuple(r) for r in hub.theater_breakdown(units).collect()} == {("East", 1), ("West", 1), ("(none)", 2)}
    assert {tuple(r) for r in hub.aircraft_inventory(units, links).collect()} == {("AB-1", 1), ("ab-10", 1), ("zz", 1), ("two words", 1)}
    assert [r["unit_key"] for r in hub.units_for_aircraft(units, links, "ab-1").collect()] == ["u1", "u2"]
    assert hub.unit(units, links, "u1").first()["aircraft"] == ["歼-1A", "歼-1B"]
    assert {r["unit_key"]: len(r["aircraft"]) for r in hub.with_aircraft(units, links.limit(0)).collect()}["u1"] == 0


def test_prefix_join_equals_the_comparison_of_all(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("aAb (") for _ in range(r.randint(0, 6)))
    left = spark.createDataFrame([(i, r.choice([None, word(), word().strip()])) for i in range(150)], "i int, k string")
    right = spark.createDataFrame([(j, r.choice([None, word(), word() + " x"])) for j in range(150)], "j int, t string")
    got = laydown.prefix_key_join(left, "k", right, "t")
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    k, t = [x["k"] for x in left.orderBy("i").collect()], [x["t"] for x in right.orderBy("j").collect()]
    hit = lambda a, b: a is not None and b is not None and (b.lower() == a.lower() or b.lower().startswith((a.lower() + " ", a.lower() + "(")))
    want = {(i, j) for i in range(150) for j in range(150) if hit(k[i], t[j])}
    want |= {(i, None) for i in range(150) if not any(hit(k[i], b) for b in t)}
    found = [(x["i"], x["j"]) for x in got.collect()]
    assert set(found) == want and len(found) == len(want)


def test_laydown(units, links, assets):
    rows = laydown.capability_laydown(units, links, assets).collect()
    assert [(r["unit_key"], r["raw_designator"], r["weg_asset_title"]) for r in rows] == [("u2", "AB-10", "ab-10 Tanker"), ("u1", "歼-1A", "AB-1 (PIN) Trainer"), ("u1", "歼-1B", "AB-1 (PIN) Trainer"), ("u3", "w", "Two Words Jet"), ("u3", "zz", None)]
    assert laydown.capability_laydown(units, links, assets, designator="ab-1", service="sky", limit=2).count() == 2
    assert tuple(laydown.linked_counts(laydown.capability_laydown(units, links, assets, limit=None)).first()) == (5, 4)
    assert {r["kind"] for r in laydown.capability_view(laydown.capability_laydown(units, links, assets)).collect()} == {"AB-1", "ab-10 Tanker", "Two Words Jet"}
    shown = laydown.laydown_view(laydown.capability_laydown(units, links, assets))
    assert shown.columns == ["unit_name", "designator", "theater_command", "airbase", "location_text"] and shown.count() == shown.distinct().count()
    # equal by its Latin base, and any Latin raw form that holds it
    assert links.filter(laydown.designator_filter("歼-1", [("歼", "AB")])).count() == 3
    assert laydown.capability_laydown(units.limit(0), links, assets).count() == 0


def test_codes(spark):
    tokens = [("歼轰-7A",), (" 歼-20 ",), ("运油20",), ("云影X",), ("第34运输机师",), ("J-20",), (None,), ("",)]
    got = [tuple(r[0]) for r in spark.createDataFrame(tokens, "t string").select(codes.normalized(F.col("t"))).collect()]
    assert got[:6] == [("歼轰-7A", "歼轰-7", "JH-7"), ("歼-20", "歼-20", "J-20"), ("运油20", "运油-20", "YY-20"), ("云影X", "云影", "Cloud Shadow"), ("第34运输机师", "第34运输机师", None), ("J-20", "J-20", None)]
    assert got[6] == (None, None, None) and got[7] == ("", "", None)
    cell = spark.createDataFrame([("歼-10A/B、歼-20，歼-20和师,",)], "c string").select(codes.split_cell(F.col("c")).alias("x"))
    assert [p["raw"] for p in cell.first()["x"]] == ["歼-10A/B", "歼-20", "师"]
    assert cell.select(F.size(codes.known_only(F.col("x")))).first()[0] == 2


def test_scenario(spark):
    rows = [("How would a J-20a act in the Taiwan Strait as fighter?",), ("歼-16 near Korea",), ("评J-20 drone",), (None,), ("",)]
    df = spark.createDataFrame(rows, "q string")
    got = [r[0] for r in df.select(scenario.resolved(F.col("q"))).collect()]
    assert (got[0]["designator"], got[0]["theaters"], got[0]["role"], got[0]["matched_location"]) == ("J-20A", ["Eastern", "Southern"], "fighter", "taiwan strait")
    assert got[1]["designator"] == "J-16" and got[1]["theaters"] == ["Northern"]
    assert got[2]["designator"] is None and got[2]["role"] == "uav" and got[4]["theaters"] == []
    given = df.select(scenario.resolved(F.col("q"), theater=F.lit("West"), designator=F.lit("X-1"))).first()[0]
    assert given["theaters"] == ["West"] and given["matched_location"] is None and given["designator"] == "X-1"


def test_text(spark):
    c = F.col("c")
    one = lambda v, e: spark.createDataFrame([(v,)], "c string").select(e).first()[0]
    assert one("　 a \xa0b ", text.collapse(c)) == "a b"
    assert one("Head 44 of — X", text.line_key(c)) == "head of x" and one(" Page 12 ", text.is_page_number(c)) and not one("12345", text.is_page_number(c))
    assert one("“A”\u00ad – b", text.folded(c)) == '"a" - b'
    assert one("50% off_", text.holds(c, "0% o")) and one("x", text.holds(c, "")) and one("a\\b", text.holds(c, "\\"))


def test_retrieval(spark):
    chunks = spark.createDataFrame([(1, 10, "s", [1.0, 0.0]), (2, 10, "s", [0.9, 0.1]), (3, 11, "t", [0.9, 0.1]), (4, 99, "t", [0.8, 0.0]), (5, 12, "t", None), (6, 12, "t", [1.0]), (7, None, "t", [0.0, 1.0])], "chunk_id long, parent_id long, source string, embedding array<float>")
    pages = spark.createDataFrame([(10, "s", 1, "a"), (11, "t", 2, "b"), (10, "s", 1, "a")], "parent_id long, source string, page int, text string")
    assert [r["chunk_id"] for r in retrieval.top_chunks(chunks, [1.0, 0.0], 3).collect()] == [1, 2, 3]
    assert [r["parent_id"] for r in retrieval.search(chunks, pages, [1.0, 0.0], 4, 3).collect()] == [10, 11]
    assert [r["chunk_id"] for r in retrieval.top_chunks(chunks, [1.0, 0.0], 9, ["t"]).collect()] == [3, 4, 7]
    assert retrieval.search(chunks.limit(0), pages, [1.0, 0.0]).count() == 0
    short = retrieval.snippets(retrieval.search(chunks, pages, [1.0, 0.0], 4, 3)).collect()
    assert [tuple(r) for r in short] == [("s p.1", "a", 1.0), ("t p.2", "b", 0.9)]
    sizes = {r["dimension"]: r["passages"] for r in retrieval.vector_sizes(chunks.union(chunks)).collect()}
    assert sizes == {2: 5, -1: 1, 1: 1}
    again = spark.createDataFrame([(10, "s", 1, 1), (20, "s", 1, 2), (20, "s", 1, 2), (30, "s", None, 1), (40, None, 1, 1)], "parent_id long, source string, page int, ingested_at int")
    cut = spark.createDataFrame([(1, "s", 1), (1, "s", 1), (2, "s", 7), (3, "s", None), (4, None, 1)], "chunk_id long, source string, page int")
    assert {(r["chunk_id"], r["page_id"]) for r in retrieval.with_pages(cut, again).collect()} == {(1, 20), (2, None), (3, None), (4, None)}
    assert retrieval.with_pages(cut, again.limit(0)).filter("page_id is not null").count() == 0
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, vector array<double>")
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in retrieval.batch_search(q, chunks, 2, blocks=3).collect()}
    assert got == {(1, 1): 1, (1, 2): 2, (2, 1): 7, (2, 2): 2}
    v = retrieval.hash_embedding(spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id int, t string"), "t", ["id"], 32)
    size = {r["id"]: math.sqrt(sum(x * x for x in r["embedding"])) for r in v.collect()}
    assert size[1] == pytest.approx(1) and size[2] == size[3] == 0
    with pytest.raises(ValueError):
        retrieval.hash_embedding(v, "t", ["id"], 33)


def test_metrics(spark):
    cases = spark.createDataFrame([("a", "q", True, None, [("s", 5, "x  Y"), ("s", 9, None)]), ("b", "q", False, None, [("z", 1, "gone")]), ("c", "q", True, None, [])], files.GOLD)
    hits = spark.createDataFrame([("a", 1, "t", 5), ("a", 2, "s", 6), ("a", 3, "s", 4), ("a", 5, "s", 9), ("b", 1, "s", 1)], "id string, rank int, source string, page int")
    m = {r["id"]: r for r in metrics.case_metrics(hits, cases).collect()}
    a = m["a"]
    assert (a["best_rank"], a["precision"], a["recall"], a["hit"]) == (2, 0.5, 0.5, True)
    assert a["ndcg"] == pytest.approx((1 / math.log2(3) + 1 / 2) / (1 + 1 / math.log2(3)))
    assert not m["b"]["hit"] and not m["b"]["source_hit"] and m["c"]["labels"] == 0 and m["c"]["ndcg"] == 0
    s = metrics.summary(metrics.case_metrics(hits, cases)).first()
    assert (s["cases"], s["labels"], s["unverified"]) == (3, 3, 1) and s["mrr"] == pytest.approx(1 / 6)
    assert s["micro_recall"] == pytest.approx(1 / 3)
    look = {(r["id"], r["reason"]) for r in metrics.to_inspect(metrics.case_metrics(hits, cases)).collect()}
    assert look == {("b", "missed"), ("b", "unverified"), ("c", "missed")}
    assert {(r["id"], r["rank"]) for r in metrics.right_pages(hits.union(hits), cases).collect()} == {("a", 2), ("a", 3), ("a", 5)}
    assert metrics.right_pages(hits.limit(0), cases).count() == 0
    pages = spark.createDataFrame([("s", 5, "has X y."), ("s", 9, None)], "source string, page int, text string")
    assert {(r["id"], r["valid"]) for r in metrics.quote_validation(cases, pages).collect()} == {("a", True), ("b", False)}
    assert [r[0] for r in metrics.missing_sources(cases, pages).collect()] == ["z"]


def test_windows_equal_a_loop(spark):
    r = random.Random(3)
    rows = [(i, " ".join(f"w{j}" for j in range(r.choice([0, 1, 19, 20, 150, 151, 270, 271, r.randint(0, 700)])))) for i in range(60)] + [(99, None), (98, "  ")]
    df = spark.createDataFrame(rows, "k int, text string")
    for size, overlap in ((150, 30), (7, 6), (5, 9)):
        want = set()
        for k, t in rows:
            w = (t or "").split()
            for no, start in enumerate(range(0, len(w), max(1, size - overlap))):
                if len(w[start : start + size]) >= 5:
                    want.add((k, no, " ".join(w[start : start + size])))
                if start + size >= len(w):
                    break
        assert {(x["k"], x["child_no"], x["text"]) for x in chunking.word_windows(df, ["k"], size, overlap, 5).collect()} == want


def test_boilerplate(spark):
    pages = [("f", i, f"Running Head Of File {i}\nbody number {'abcdefgh'[i]} is unique\n\n{i}\nPage {i}") for i in range(8)] + [("g", 1, "Running Head Of File 1\nx"), ("g", 2, None)]
    df = spark.createDataFrame(pages, "source string, page_id int, text string")
    assert [(r["source"], r["line_key"], r["pages"]) for r in chunking.boilerplate_keys(df).collect()] == [("f", "running head of file", 8)]
    got = {(r["source"], r["page_id"]): r["text"] for r in chunking.stripped_pages(df).collect()}
    assert got["f", 2] == "body number c is unique" and got["g", 1] == "Running Head Of File 1 x" and got["g", 2] == ""


ARTICLE = """Source URL: https://x.example/a
## 空军
### 歼击机部队
##### 东部战区
| 航空兵部队 | 机型 | 驻地 | 代号 | 备注 |
|---|:---:|---|---|---|
| [甲旅](http://l) | 歼-20、歼-10A/B | 浙江省某市湾里机场 | 93A12 | 旧称[註 1] |
| 乙旅 | | 某县 | | |
| 丙旅 | 南部战区 | 轰-6 | 广东省 | 某区 |
| | 运-20 | 某镇 | | |
text
| 其他 | 机型 |
|---|---|
| 丁 | 歼-7 |
### 学院
| 航空兵部隊 | 机型 |
| 戊 | 教练-9 |
"""


def test_articles(spark):
    lines = files.lines_of(spark.createDataFrame([("d", ARTICLE), ("e", ""), ("f", None)], "doc string, value string"))
    got = {r["unit_key"]: r for r in articles.parse_articles(lines).collect()}
    assert set(got) == {"甲旅", "丙旅", "fighter|某镇", "戊"}
    a, c, e = got["甲旅"], got["丙旅"], got["戊"]
    assert (a["service"], a["role"], a["theater_command"], a["province"], a["airbase"], a["tactical_code"], a["remarks"]) == ("PLAAF", "fighter", "Eastern", "浙江省", "湾里机场", "93A12", "旧称")
    assert [x["en_base"] for x in a["aircraft"]] == ["J-20", "J-10"] and a["source_url"] == "https://x.example/a"
    assert (c["theater_command"], c["location_text"], c["remarks"]) == ("Southern", "广东省", "南部战区; 某区")
    assert (e["role"], e["theater_command"], e["branch"]) == ("academy", None, "学院")
    assert articles.parse_articles(lines, keep_empty=True).count() == 5


def test_layout(spark):
    rows = [
        ("before", 8.0, "S"), ("AB-1 Long", 15.0, "S"), ("Title", 15.0, "S"), ("Origin: Here", 8.0, "S"), ("WEG Location: http://x: y", 8.0, "S"), ("Notes", 12.0, "S"), ("Text: stays", 8.0, "S"),
        ("For Training Use Only", 8.0, "S"), ("7", 8.0, "Helvetica"), ("more", 8.0, "S"), ("System", 12.0, "S"), ("Crew: 2", 8.0, "S"), ("Crew: 3", 8.0, "S"), ("loose", 8.0, "S"), ("words", 8.0, "S"), ("Sub", 10.0, "S"), ('A "q": 1', 8.0, "S"),
        ("Empty", 12.0, "S"), ("BB-2", 14.0, "S"), ("Part", 9.5, "S"), ("K: v", 8.0, "S"),
    ]
    df = spark.createDataFrame([("d", i, *r) for i, r in enumerate(rows)], "doc string, line_no long, text string, size double, font string")
    import json

    a, b = layout.parse_layout(df).orderBy("asset_seq").collect()
    assert (a["asset_title"], a["source_url"], a["notes"]) == ("AB-1 Long Title", "http://x: y", "Text: stays more")
    assert json.loads(a["dynamic_payload"]) == {"Metadata": {"Origin": "Here"}, "System": {"Crew": ["2", "3"], "_text": "loose words", "Sub": {'A "q"': "1"}}, "Empty": {}}
    assert list(json.loads(a["dynamic_payload"])) == ["Metadata", "System", "Empty"]
    assert b["asset_title"] == "BB-2" and json.loads(b["dynamic_payload"]) == {"General": {"Part": {"K": "v"}}}
    spans = spark.createDataFrame([("d", 1, 0, 0, 0, "a ", 9.04, "F"), ("d", 1, 0, 0, 1, "  ", 20.0, "G"), ("d", 1, 0, 0, 2, "b  c", 12.0, "H")], files.LAYOUT)
    line = files.lines_of_spans(spans).first()
    assert (line["text"], line["size"], line["font"]) == ("a b c", 12.0, "H")


def test_merged_tables(spark):
    t = stores.empty_tables(spark)
    assert t["units"].count() == 0 and stores.dimension(t["rag_meta"]).first()[0] == -1
    new = spark.createDataFrame([("a", "u1", None, "{}", 1), ("a", "u2", None, "{}", 2), ("b", None, None, None, 1), (None, "n", None, None, 1)], "asset_title string, source_url string, notes string, dynamic_payload string, seq int")
    once = stores.merged(t["weg_assets"], new, ["asset_title"], "seq")
    for m in (once, stores.merged(once, new, ["asset_title"], "seq")):
        assert {(r["asset_title"], r["source_url"]) for r in m.collect()} == {("a", "u2"), ("b", None), (None, "n")}
    air = "unit_key string, unit_name string, seq int, aircraft array<struct<raw:string,cn_base:string,en_base:string>>"
    base = {c: F.lit(None).cast("string") for c in ("service", "branch", "role", "theater_command", "location_text", "province", "airbase", "tactical_code", "remarks", "source_url")}
    units, links = stores.merged_units(t["units"], t["unit_aircraft"], spark.createDataFrame([("k", "n", 1, [("x", "x", "X"), ("y", "y", None), ("x", "z", "Z")])], air).withColumns(base), "seq")
    assert links.count() == 2
    units, links = stores.merged_units(units, links, spark.createDataFrame([("k", "m", 2, [("y", "y", None)]), ("j", "j", 1, [])], air).withColumns(base), "seq")
    assert links.count() == 1 and units.count() == 2
    parents = spark.createDataFrame([(1, "f", 1, "t")], "parent_id long, source string, page int, text string")
    chunks = spark.createDataFrame([(1, 1, "f", 1, "t", [1.0, 2.0])], "chunk_id long, parent_id long, source string, page int, text string, embedding array<float>")
    held = stores.replaced_pages(stores.replaced_pages(t["rag_chunks"], chunks), chunks)
    assert held.count() == 1 and stores.page_faults(parents, chunks, 2).count() == 0
    assert [r["fault"] for r in stores.page_faults(parents, chunks.withColumn("parent_id", F.lit(7)), 2).collect()] == ["no page"]
    assert [r["fault"] for r in stores.page_faults(parents, chunks, 3).collect()] == ["not 3 numbers"]
    stores.register({"units": units}, "v_")
    assert spark.table("v_units").count() == 2


def test_a_log_of_changes(spark, tmp_path):
    schema = "asset_title string, source_url string, ingested_at int"
    for n, url in enumerate(("u1", "u2")):
        spark.createDataFrame([("a", url, n), (None, "x", n), (f"b{n}", url, n)], schema).write.mode("append").parquet(f"{tmp_path}/in")
        upserts.log_changes(upserts.asset_stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/log", f"{tmp_path}/state").awaitTermination()
    got = {(r[0], r[1]) for r in upserts.current(spark, f"{tmp_path}/log").collect()}
    assert got == {("a", "u2"), ("b0", "u1"), ("b1", "u2")}


def test_breakdowns_come_commonest_first(spark):
    units = spark.createDataFrame([(f"k{i}", r, t) for i, (r, t) in enumerate([("a", "x"), ("b", "y"), ("b", "x"), (None, None), ("c", "y"), ("", "x")])], "unit_key string, role string, theater_command string")
    assert [tuple(r) for r in hub.role_breakdown(units).collect()] == [("(unknown)", 2), ("b", 2), ("a", 1), ("c", 1)]
    assert [tuple(r) for r in hub.theater_breakdown(units).collect()] == [("x", 3), ("y", 2), ("(none)", 1)]
    docs = ['{"Metadata": {"Origin": "B", "Domain": "q"}}', '{"Metadata": {"Origin": "B", "Domain": "p, q"}}', '{"Metadata": {"Origin": "A", "Domain": "p"}}', "{}"]
    assets = spark.createDataFrame([(d,) for d in docs], "dynamic_payload string")
    assert [tuple(r) for r in catalog.count_origins(assets).collect()] == [("B", 2), ("(unknown)", 1), ("A", 1)]
    assert [tuple(r) for r in catalog.category_breakdown(assets).collect()] == [("q", 2), ("(uncategorized)", 1), ("p", 1)]
    links = spark.createDataFrame([("k0", "X"), ("k1", "Y"), ("k2", "Y"), ("k2", "Y")], "unit_key string, en_designator string").withColumn("cn_designator", F.lit(None).cast("string"))
    assert [tuple(r) for r in hub.aircraft_inventory(units.withColumn("service", F.lit("s")), links).collect()] == [("Y", 2), ("X", 1)]


def test_carry_equals_one_window(spark):
    r = random.Random(3)
    rows = [(f"d{r.randrange(3)}", i, r.choice([None, None, "a", "b"]), r.randrange(3)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc string, n long, v string, k int").repartition(5)
    got = carry(df, "doc", "n", 16, last={"state": F.when(F.col("v").isNotNull(), F.struct(F.nullif("v", F.lit("b")).alias("s")))}, total={"sum": F.col("k")}, before={"prev": F.col("k")})
    seen = {}
    for d, n, v, k in sorted(rows, key=lambda x: x[1]):
        state, total, prev = seen.get(d, (None, 0, None))
        seen[d] = (None if v == "b" else v) if v else state, total + k, k
        seen[(d, n)] = ((None if v == "b" else v) if v else state, total + k, prev)
    for x in got.collect():
        assert (x["state"]["s"] if x["state"] else None, x["sum"], x["prev"]) == seen[(x["doc"], x["n"])]
    assert got.count() == 400


def test_search_gates_and_checked_vectors(spark):
    chunks = spark.createDataFrame([(1, 1, "f", [1.0, 0.0])], "chunk_id long, parent_id long, source string, embedding array<float>")
    parents = spark.createDataFrame([(1, "f", 1, "t")], "parent_id long, source string, page int, text string")
    assert retrieval.search_or_reason(chunks, parents, [1.0, 0.0])[0].count() == 1
    for query, why in (([], "empty"), ([0.0, 0.0], "empty"), ([1.0], "no passages"), ([1.0, 1.0], "no page")):
        found, reason = retrieval.search_or_reason(chunks if why != "no page" else chunks.withColumn("parent_id", F.lit(5)), parents, query)
        assert found.count() == 0 and why in reason
    docs = spark.createDataFrame([(1, "a b")], "id int, text string")
    assert len(retrieval.embedder("hash", 64)(docs, "text").first()["embedding"]) == 64
    with pytest.raises(Exception, match="has not 32 numbers"):
        retrieval.embedder("hash", 32)(docs, "text").collect()
    with pytest.raises(ValueError):
        retrieval.embedder("none", 8)


def test_latest_orders_nulls_and_ties(spark):
    df = spark.createDataFrame([("k", None, 1), ("k", 5, 2), ("k", 5, 3), (None, None, 4), ("k", 5, 3)], "k string, o int, v int")
    assert {tuple(r) for r in stores.latest(df, ["k"], ["o"]).collect()} == {("k", 5, 3), (None, None, 4)}
    assert {tuple(r) for r in stores.earliest(df, ["k"], ["o"]).collect()} == {("k", 5, 2), (None, None, 4)}
    assert stores.latest(df.limit(0), ["k"], ["o"]).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("Source URL: http://u x\none\n\ntwo", encoding="utf-8")
    got = files.text_lines(spark, str(tmp_path / "a.md")).orderBy("line_no").collect()
    assert [r["text"] for r in got] == ["Source URL: http://u x", "one", "", "two"] and got[0]["source_url"] == "http://u"
    (tmp_path / "b.pdf").write_bytes(b"1")
    (tmp_path / "c.pdf").write_bytes(b"2")
    assert [r["name"] for r in files.listed_files(spark, str(tmp_path), skip=["c.pdf"]).collect()] == ["b.pdf"]
    (tmp_path / "g.json").write_text('{"id": "a", "verified": true, "expected": [{"source": "s", "page": 1}]}\n{"verified": true}\n')
    assert files.gold_cases(spark, str(tmp_path / "g.json")).count() == 1
