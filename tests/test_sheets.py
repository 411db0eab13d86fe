"""Cells of a document are made and settled in its row; those outside of its rows meet the cells of the document that has them."""

import pytest
from oracle import SF_DIR

from quire.operators.writers import layout_cells, mixed_cells
from quire.plans.placement import x4_mixed_placement, x5_layout_placement

FIELDS = "fields array<struct<ref:string,value:string>>"


def cells_of(df):
    return sorted((r.row, r.col, r.text, r.num) for r in df.collect())


@pytest.mark.parametrize("run", [x4_mixed_placement, x5_layout_placement])
def test_cells_are_not_dealt_again(spark, run):
    plan = run(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan and plan.count("Relation [l_orderkey") == 2


def test_layout_fields_beyond_their_document(spark):
    rows = "sections array<struct<key:string,rows:array<struct<label:string,value:string,at_row:int,label_at:string,value_at:string>>>>"
    docs = spark.createDataFrame([(1, 10, 0, 0, None, [("A5", "lost"), ("B6", "7"), ("A20", "far")]), (1, 11, 1, 0, None, [("A2", "(9)")])], f"job int, doc int, block int, template_id int, {rows}, {FIELDS}")
    cells = spark.createDataFrame([(0, 0, 0, "Head"), (0, 1, 0, "Foot")], "template_id int, r int, c int, value string")
    groups = spark.createDataFrame([], "template_id int, grp int, section_label string, start_row int, end_row int, label_col int, value_col int")
    assert cells_of(layout_cells(docs, cells, groups)) == [(0, 0, "Head", None), (1, 0, "Foot", None), (4, 0, "Head", None), (5, 0, None, -9.0), (5, 1, None, 7.0), (19, 0, "far", None)]


def test_layout_rows_above_and_below_their_document(spark):
    rows = "sections array<struct<key:string,rows:array<struct<label:string,value:string,at_row:int,label_at:string,value_at:string>>>>"
    told = [("Goods", [("a", "1", 9, "C", "D"), ("b", "2", -2, "C", "D")])]
    docs = spark.createDataFrame([(1, 10, 0, 0, None, None), (1, 11, 1, 0, told, None), (1, 12, 2, 0, None, [("D6", "x")])], f"job int, doc int, block int, template_id int, {rows}, {FIELDS}")
    cells = spark.createDataFrame([(0, 0, 0, "Head")], "template_id int, r int, c int, value string")
    groups = spark.createDataFrame([], "template_id int, grp int, section_label string, start_row int, end_row int, label_col int, value_col int")
    want = [(0, 0, "Head", None), (0, 2, "b", None), (0, 3, None, 2.0), (3, 0, "Head", None), (5, 0, "a", None), (5, 1, None, 1.0), (6, 0, "b", None), (6, 1, None, 2.0), (10, 0, "Head", None), (11, 2, "a", None), (11, 3, None, 1.0), (15, 3, "x", None)]
    assert cells_of(layout_cells(docs, cells, groups)) == want


def test_mixed_fields_beyond_their_document(spark):
    many = "answers array<struct<label:string,value:string>>, records array<struct<source:string,values:map<string,string>>>"
    docs = spark.createDataFrame([(1, 10, 0, 0, "a", 0, [("B2", "p"), ("A5", "lost")], None, None), (1, 11, 1, 0, "b", 0, None, None, None)], f"job int, doc int, block int, template_id int, file string, flagged int, {FIELDS}, {many}")
    cells = spark.createDataFrame([(0, 0, 0, "Head", False)], "template_id int, r int, c int, value string, target boolean")
    tables = spark.createDataFrame([], "template_id int, table_no int, header_row int, start_col int, names array<string>, section string")
    labels = spark.createDataFrame([], "template_id int, r int")
    assert cells_of(mixed_cells(docs, cells, tables, labels)) == [(0, 0, "Head", None), (1, 1, "p", None), (4, 0, "Document: b", None), (6, 0, "Head", None)]
