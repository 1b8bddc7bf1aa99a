"""All queries of the core against their SQL, on the smallest data folder."""

from pathlib import Path

import pytest

from gneiss.plans import oracle, queries
from tests.compare import rows, views

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not Path(DATA).exists():
        pytest.skip("no data")
    return views(DATA)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    df = queries.QUERIES[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in oracle.SQL:
        cur = con.execute(oracle.SQL[name])
        assert got == rows([c[0] for c in cur.description], cur.fetchall())


def test_label_and_value_of_every_line(spark, tmp_path):
    texts = [(1, "Title\nRange: 900 km\n\nno label\n: empty\nempty: \nCrew: two: or three"), (2, "Only: one"), (3, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.QUERIES["kv_lines"](spark, str(tmp_path)).collect())
    assert got == [(1, 1, "Range", "900 km"), (1, 6, "Crew", "two: or three"), (2, 0, "Only", "one")]


def test_labels_of_a_second_source_are_found(spark, tmp_path):
    pages = [(p, s) for p in (1, 2, 3) for s in ("a.pdf", "b.pdf", "c.pdf")]
    spark.createDataFrame([(i, s, p, "x") for i, (p, s) in enumerate(pages)], "parent_id long, source string, page int, text string").write.parquet(f"{tmp_path}/rag_parents.parquet")
    expected = "array<struct<source: string, page: int, quote: string>>"
    cases = [("two", "q", True, "", [("b.pdf", 3, "x"), ("a.pdf", 3, None)]), ("none", "q", False, "", [])]
    spark.createDataFrame(cases, f"id string, query_text string, verified boolean, note string, expected {expected}").write.parquet(f"{tmp_path}/gold_cases.parquet")
    right = {(r["id"], r["rank"], r["source"], r["page"]) for r in queries.QUERIES["ir_all_right_pages"](spark, str(tmp_path)).collect()}
    assert {("two", 1, "a.pdf", 3), ("two", 2, "b.pdf", 3)} <= right and "c.pdf" not in {r[2] for r in right}
    two = queries.QUERIES["ir_all_metrics"](spark, str(tmp_path)).filter("id = 'two'").first()
    assert (two["labels"], two["recall"], two["best_rank"]) == (2, 1.0, 1)
