"""Orphan references, nested documents and units of quantities, held against plain versions of themselves."""

import json
import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gneiss.operators import nested, references, units
from gneiss.operators.units import number, readings

T0 = datetime(2024, 1, 1)


def hours(n):
    return None if n is None else T0 + timedelta(hours=n)


def orphans(refs, targets):
    out = set()
    for table, i, key, at in refs:
        if key is None or not key.strip():
            continue
        mine = [(a, z) for k, a, z in targets if k == key and a is not None]
        if not mine:
            out.add((table, i, "missing", at and at.strftime("%Y-%m")))
        elif at is not None and not any(a <= at and (z is None or at < z) for a, z in mine):
            out.add((table, i, "deleted" if any(a <= at for a, z in mine) else "late", at.strftime("%Y-%m")))
    return out


REFS, TARGETS = "ref_table string, ref_id long, key string, arrived timestamp", "key string, arrived timestamp, deleted timestamp"


@pytest.mark.parametrize("seed", range(3))
def test_orphans_equal_a_plain_search(spark, seed):
    r = random.Random(seed)
    keys = [str(k) for k in (*range(1, 40), 65535, 65536, 70000)] + ["ab-7", "ab-07", "ab", "b 12x", "99999999999999999999"]
    targets = [(r.choice(keys), hours(r.choice([None, *range(0, 2000, 7)])), hours(r.choice([None, *range(0, 2500, 11)]))) for _ in range(120)]
    targets += [("7", hours(i), hours(i + 1)) for i in range(0, 300, 2)] + targets[:5]
    refs = [("t", i, r.choice([*keys, None, "", "  ", "555"]), hours(r.choice([None, *range(0, 2200, 3)]))) for i in range(400)]
    refs += [("t", 1000 + i, "7", hours(i)) for i in range(0, 310)] + refs[:9]
    got = references.orphan_references(spark.createDataFrame(refs, REFS).withColumn("stem", F.lit("clash")).withColumn("number", F.lit(1)), spark.createDataFrame(targets, TARGETS).withColumn("stem", F.lit(3)))
    assert {tuple(x) for x in got.collect()} == orphans(refs, targets)


def test_json_is_told_as_by_json(spark):
    r = random.Random(6)
    docs = [" ", '"\\u12g4"', '"\\\\"', "01", "-", "[1 2]", "[}", '{"a":1,}', '{"a" "b"}', "[:]", '{"a":"b":1}', "[]]", "NaN", "\ufeff[]", '{"a":{},"b":[{}]}', '"a\nb"']
    for _ in range(1500):
        t = json.dumps(document(r), ensure_ascii=r.random() < 0.5)
        for _ in range(r.choice([0, 1, 2])):
            k = r.randrange(len(t) + 1)
            t = t[:k] + r.choice(['"', "{", "}", "[", "]", ",", ":", "\\", "1", "-", ".", "e", " ", "null", "\x01", "\\u12"]) + t[k + r.choice([0, 1]) :]
        docs.append(t)

    def told(t):
        def never(_):
            raise ValueError

        try:
            return True, json.loads(t, parse_constant=never)
        except ValueError:
            return False, None

    for t, got in zip(docs, nested.Tokens(docs).valid().tolist()):
        ok, value = told(t)
        assert ok == got, t
        assert not ok or nested.loads(t, lambda x: int(x) if x.lstrip("-").isdigit() else float(x)) == value, t


def test_depth_and_size_of_numbers_have_no_limit(spark):
    deep = "[" * 100_000 + '{"x": 1}' + "]" * 100_000
    long = '{"a": [{"n": ' + "7" * 5000 + "}]}"
    speed = '{"System": ' + '{"a": ' * 30_000 + '{"Speed (km/h)": 5, "Range (km)": 123456789012345678}' + "}" * 30_000 + "}"
    df = spark.createDataFrame([(1, deep), (2, long), (3, speed), (4, "[" * 50_000)], "asset_seq long, dynamic_payload string")
    got = {(x["asset_seq"], len(x["object_path"])) for x in nested.flat_objects(df).collect()}
    assert got == {(1, 100_000 * 6 - 3), (2, len("a > [0]"))}
    assert {tuple(x) for x in units.given_values(df).collect()} == {(3, "speed", 5), (3, "range", 123456789012345678)}


def test_orphans_of_empty_tables(spark):
    none, some = spark.createDataFrame([], REFS), spark.createDataFrame([("t", 1, "7", T0)], REFS)
    targets = spark.createDataFrame([], TARGETS)
    assert references.orphan_references(none, targets).count() == 0
    assert [tuple(x) for x in references.orphan_references(some, targets).collect()] == [("t", 1, "missing", "2024-01")]


def test_runs_of_keys(spark):
    keys = [("", k, True) for k in (1, 2, 3, 5, 6, 9, 65535, 65536)] + [("a", 2, True), ("", 4, False), ("", 0, False), ("", 65537, False), ("", 70000, False), ("b", 1, False)]
    df = spark.createDataFrame(keys, "stem string, number long, target boolean").withColumn("space", F.lit("s"))
    reach = {(r["stem"], r["number"]): r["reach"] for r in references.key_runs(df).collect()}
    assert reach == {("", 1): 3, ("", 2): 3, ("", 3): 3, ("", 4): 3, ("", 5): 6, ("", 6): 6, ("", 9): 9, ("", 65535): 65535, ("", 65536): 65536, ("", 65537): 65536, ("", 70000): 65536, ("", 0): None, ("a", 2): 2, ("b", 1): None}


def test_long_ids_and_one_hour_of_one_key(spark):
    big = ["1234567890123456789", "9223372036854775807", "12345678901234567890123", "a000", "a0001", "1000000000000000000"]
    refs = [("t", i, k, T0) for i, k in enumerate(big)] + [("t", 100 + i, k + "7", T0) for i, k in enumerate(big)]
    targets = [(k, T0, None) for k in big]
    got = references.orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(targets, TARGETS))
    assert {r[1] for r in got.collect()} == {100 + i for i in range(len(big))}
    n = 200_000
    many = spark.range(n).select(F.lit("t").alias("ref_table"), F.col("id").alias("ref_id"), F.lit("k1").alias("key"), F.timestamp_micros(1704067200000000 + F.col("id") * 7).alias("arrived"))
    mid = datetime(2024, 1, 1) + timedelta(microseconds=700_000)
    got = references.orphan_references(many, spark.createDataFrame([("k1", mid, mid + timedelta(microseconds=70_000))], TARGETS))
    assert {(r["reason"], r["count"]) for r in got.groupBy("reason").count().collect()} == {("late", 100_000), ("deleted", n - 110_000)}


def test_titles_are_named_by_prefix_case_and_dash(spark):
    links = spark.createDataFrame([(1, "abc–7", T0), (2, "ABC-7X", T0), (3, " two words ", T0), (4, None, T0), (5, "two", T0), (6, "wor", T0)], "link_id long, en_designator string, ingested_at timestamp")
    assets = spark.createDataFrame([("ABC-7(old) x", T0, None), ("Two Words Plus", T0, None), (None, T0, None), ("", T0, None)], "asset_title string, ingested_at timestamp, deleted_at timestamp")
    assert {(r[1], r[2]) for r in references.asset_references(links, assets).collect()} == {(2, "missing"), (6, "missing")}


def objects(v, path="", near="", element=False):
    if isinstance(v, dict):
        if element:
            yield path, near
        for k, x in v.items():
            yield from objects(x, f"{path} > {k}" if path else k, path if element else near)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from objects(x, f"{path} > [{i}]" if path else f"[{i}]", path if element else near, isinstance(x, dict))


def document(r, depth=0):
    kind = r.random()
    if depth > 5 or kind < 0.4:
        return r.choice([None, True, False, 1, -2.5e3, "", "a{b}[c],:", 'q"uo\\te\\', "日本 é", "\n\t"])
    if kind < 0.7:
        return {r.choice(["a", "b.c", 'k"x', "é", "ö\\", "", "d e", "f"]) + str(i): document(r, depth + 1) for i in range(r.randint(0, 4))}
    return [document(r, depth + 1) for _ in range(r.randint(0, 4))]


def test_nested_objects_equal_a_recursive_walk(spark):
    r = random.Random(5)
    docs = [json.dumps(document(r), ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1])) for _ in range(300)]
    bad = [None, "", " ", "{", '{"a": [{"b": 1}', '{"a": 1} x', "[1,]", '{"a": NaN}', "{'a': 1}", "[" * 3000]
    rows = [(i, d) for i, d in enumerate(docs + bad)]
    want = {(i, p, n) for i, d in enumerate(docs) for p, n in objects(json.loads(d))}
    df = spark.createDataFrame(rows + rows[:20], "asset_seq long, dynamic_payload string").withColumn("path", F.lit(1))
    assert {tuple(x) for x in nested.flat_objects(df).collect()} == want
    fields = {(x["asset_seq"], x["path"]): x["value"] for x in nested.flat_fields(df).collect()}

    def scalars(v, path=""):
        if isinstance(v, (dict, list)):
            for k, x in v.items() if isinstance(v, dict) else enumerate(v):
                step = k if isinstance(v, dict) else f"[{k}]"
                yield from scalars(x, f"{path} > {step}" if path else step)
        elif path:
            yield path, v

    for i, d in enumerate(docs):
        for p, v in scalars(json.loads(d)):
            assert (i, p) in fields
            if isinstance(v, str):
                assert fields[i, p] == v
    assert nested.flat_objects(df.limit(0)).count() == nested.flat_sections(df.limit(0)).count() == 0


CASES = [
    ({"Automotive": {"Range (km)": "1,589"}}, [("range", 1589)]),
    ({"Automotive": {"Range [nmi]": "143,6"}}, [("range", 266)]),
    ({"Automotive": {"Max. Speed": "~2\xa0314mph"}}, [("speed", 3724)]),
    ({"Automotive": {"Speed": {"Value": 100.0, "Unit": "knots", "Remark": "sea level"}}}, [("speed", 185)]),
    ({"Automotive": {"Ceiling": "9.9 thousand ft"}}, [("ceiling", 3018)]),
    ({"Automotive": {"Ceiling": ["3950 m", "4,384 metres"]}}, [("ceiling", 3950), ("ceiling", 4384)]),
    ({"Dimensions": {"Length, Overall": "110 ft 11 in", "MTOW": "up to 46 t"}}, [("length", 3381), ("weight", 46000)]),
    ({"Dimensions": {"Length": "37' 0\""}}, [("length", 1128)]),
    ({"Dimensions": {"Length (overall)": "5", "Length (overall) Unit": "ft"}}, [("length", 152)]),
    ({"Metadata": {"Units": "Imperial"}, "System": {"Range": 10, "MTOW": "1,000"}}, [("range", 16), ("weight", 454)]),
    ({"Metadata": {"Units": "metric"}, "System": {"Length": "2.5", "Ceiling": "n/a"}}, [("length", 250)]),
    ({"Automotive": {"_text": "Range is put at 100 NM by the maker. The ceiling is 9 km in still air."}}, [("range", 185), ("ceiling", 9000)]),
    ({"Automotive": {"Range": "100"}}, []),
    ({"Armament": {"Range (km)": "7"}, "System": {"Variants": [{"Range (km)": 3}], "Empty Weight (lb)": 5, "Rate of Climb (m/s)": 3}}, []),
    ({"Automotive": None, "Dimensions": "x", "System": {"Range (km)": True, "Speed (mph)": None, "Ceiling (m)": "-"}}, []),
    ({"Dimensions": {"Length (in)": 0.5}}, [("length", 1)]),
]


def test_units_of_written_values(spark):
    rows = [(i, json.dumps(d, ensure_ascii=False)) for i, (d, _) in enumerate(CASES)] + [(900, None), (901, ""), (902, "{"), (903, "[1]"), (904, "3")]
    df = spark.createDataFrame(rows + rows, "asset_seq long, dynamic_payload string").withColumn("quantity", F.lit("clash"))
    got = {tuple(r) for r in units.given_values(df).collect()}
    assert got == {(i, q, v) for i, (_, want) in enumerate(CASES) for q, v in want}
    assert units.common_units(df.limit(0)).count() == 0


def test_numbers_and_readings():
    assert [str(number(t)) for t in ("1,234", "1,234,567", "12,34", "1 234", "0,5", "1.5")] == ["1234", "1234567", "12.34", "1234", "0.5", "1.5"]
    assert list(readings({"System": {"Range": Decimal("-1")}})) == []


def test_missing_units_are_inferred(spark):
    r = random.Random(1)
    rows, truth = [], {}
    for i in range(3000):
        metres = 10 ** r.gauss(3.9, 0.12)
        unit = r.choice(["m", "ft", "km"])
        value = round(metres / {"m": 1, "ft": 0.3048, "km": 1000}[unit], 2)
        known = i % 3 > 0
        rows.append((i, json.dumps({"Automotive": {"Ceiling" + (f" ({unit})" if known else ""): value}})))
        if not known:
            truth[i] = unit
    got = {x["asset_seq"]: x for x in units.common_units(spark.createDataFrame(rows, "asset_seq long, dynamic_payload string")).collect()}
    right = sum(got[i]["unit"] == u for i, u in truth.items()) / len(truth)
    sure = [i for i in truth if not got[i]["uncertain"]]
    assert right > 0.9 and len(sure) > 0.5 * len(truth)
    assert sum(got[i]["unit"] == truth[i] for i in sure) / len(sure) > 0.95
    assert all(got[i]["unit_source"] == "inferred" for i in truth)
