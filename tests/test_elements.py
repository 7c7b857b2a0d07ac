"""Elements of pages, and the scans that they stand on."""

import random

import pytest
from pyspark.sql import functions as F

from tabulora.operators import elements, layout
from tabulora.operators.scan import carry, numbered
from tabulora.plans import report_queries
from tabulora.plans.queries import ORACLE_SQL, QUERIES
from tests.oracle import SF, assert_same

LINES = "doc_id long, page int, y double, seq int, text string, section string"
BLOCKS = "doc_id long, page int, block_id int, x0 double, y0 double, x1 double, y1 double, text string"
TABLES = "doc_id long, page int, table_idx int, x0 double, y0 double, x1 double, y1 double, rows array<array<string>>"
IMAGES = "doc_id long, page int, image_idx int"


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_scans_equal_loops(spark, size):
    r = random.Random(size)
    rows = [(r.choice([1, 1, 1, 2, None]), k, r.choice([None, None, f"v{k}"]), k * 7) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, o int, v string, other int").repartition(4)
    block = F.floor(F.col("o") / size)
    got = {(x.k, x.o): (x.a, x.b) for x in carry(df, ["k"], ["o"], block, last={"a": F.col("v")}, first={"b": F.col("v")}).collect()}
    places = {(x.k, x.o): x.i for x in numbered(df, ["k"], ["o"], block, "i").collect()}
    for k, o, _, _ in rows:
        before = [v for k2, o2, v, _ in rows if k2 == k and o2 < o]
        seen = [v for v in before if v is not None]
        assert got[k, o] == (seen[-1] if seen else None, seen[0] if seen else None)
        assert places[k, o] == len(before)


def test_elements_in_blocks_of_two_pages(spark, monkeypatch):
    monkeypatch.setattr(elements, "PAGES", 2)
    plain = layout.steady_titles
    monkeypatch.setattr(layout, "steady_titles", lambda t: plain(t, 2))
    assert_same(spark, QUERIES["document_elements"], ORACLE_SQL["document_elements"])


def made(spark, lines=(), blocks=(), tables=(), images=()):
    out = elements.elements_of(spark.createDataFrame(list(lines), LINES), spark.createDataFrame(list(blocks), BLOCKS), spark.createDataFrame(list(tables), TABLES), spark.createDataFrame(list(images), IMAGES))
    return [tuple(r) for r in out.orderBy("doc_id", "element_seq").collect()]


def test_states_run_from_page_to_page(spark):
    lines = [(1, 1, 10.0, 0, "一、", None), (1, 1, 20.0, 1, "公司简介", None), (1, 1, 300.0, 2, "二、重要事项", None), (1, 4, 10.0, 0, "普通正文", None)]
    lines += [(1, 3, 10.0 * k, k, f"第{k}节........ {k}", None) for k in range(4)]
    box = (10.0, 320.0, 90.0, 400.0)
    tables = [(1, 1, 1, 10.0, 100.0, 90.0, 200.0, [["收入构成明细", "1"]]), (1, 1, 2, *box, [["", None], [" ", "x"]]), (1, 2, 1, *box, [["项目", "2"]]), (1, 2, 2, *box, [[None]]), (1, 3, 1, *box, [["收入构成", "3"]])]
    blocks = [(1, 1, 1, 10.0, 100.0, 90.0, 200.0, "covered"), (1, 1, 2, 500.0, 10.0, 600.0, 30.0, " free "), (1, 3, 1, 0.0, 0.0, 1.0, 1.0, "contents"), (1, 4, 1, 0.0, 0.0, 9.0, 9.0, "last"), (2, 7, 1, 0.0, 0.0, 9.0, 9.0, "alone"), (2, 8, 1, 0.0, 0.0, 9.0, 9.0, None)]
    got = made(spark, lines, blocks, tables, [(1, 3, 1), (2, 9, 1)])
    assert got == [
        (1, 0, "text", "free", 1, "一、公司简介", None, None),
        (1, 1, "table", "收入构成明细 | 1", 1, "一、公司简介", "收入构成明细", None),
        (1, 2, "table", " | x", 1, "二、重要事项", "二、重要事项 第1页表2", None),
        (1, 3, "table", "项目 | 2", 2, "二、重要事项", "二、重要事项 第2页表1", None),
        (1, 4, "image", "Image block detected on page 3.", 3, "二、重要事项", None, "Figure 1 on page 3"),
        (1, 5, "text", "last", 4, "二、重要事项", None, None),
        (2, 0, "text", "alone", 7, None, None, None),
        (2, 1, "image", "Image block detected on page 9.", 9, None, None, "Figure 1 on page 9"),
    ]


def test_elements_of_empty_tables(spark):
    assert made(spark) == []


def test_merged_text(spark):
    rows = [(1, 2, "text", "b"), (1, 0, "text", "a"), (1, 1, "table", "t"), (1, 3, "text", None), (1, 4, "text", " \n "), (2, 0, "image", "i")]
    out = elements.merged_text(spark.createDataFrame(rows, "doc_id long, element_seq int, element_type string, content string"))
    assert [tuple(r) for r in out.collect()] == [(1, "a\n\nb")]


def test_query_covers_both_branches(spark):
    rows = report_queries.report_elements(spark, SF).groupBy("element_type").agg(F.count("section_title").alias("s"), F.count("*").alias("n"), F.count_if(F.col("table_title").endswith("（续）")).alias("c"), F.count_if(F.col("table_title") == "").alias("e")).collect()
    by = {r.element_type: r for r in rows}
    assert all(0 < r.s < r.n for r in rows) and by["table"].c > 0


def test_rows_of_elements_do_not_stay_on_the_disk(spark, tmp_path, monkeypatch):
    from tabulora import cut

    monkeypatch.setattr(cut, "checkpoint_dir", lambda spark: f"file://{tmp_path}")
    rows = cut.packed(spark.range(20000).selectExpr("id", "'the same words' t", "id % 7 k").repartition(2, "k"))
    assert rows.count() == 20000 and sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 200000
    out = QUERIES["document_elements"](spark, SF)
    # the rows above and the elements to be numbered are left: pages, lines and tables on the way went
    assert out.count() > 0 and len(list(tmp_path.glob("rows-*"))) == 2 and not [f for n in ("elements", "items", "tables") for f in tmp_path.glob(f"{n}-*")]
    # windows, sums and the join of the numbering share one exchange of the elements
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4
