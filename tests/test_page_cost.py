"""What tables of printed pages may cost: pages are made once, and headers are compared without making them again."""

import random

from oracle import SF_DIR
from pyspark.sql import functions as F

from quire.functions import values as V
from quire.operators import spatial
from quire.plans import matching, placement
from quire.plans.spatial import e10_spatial_cells


def test_pages_are_made_once_for_their_headers_and_rows(spark):
    plan = placement.e11_header_row(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") <= 3
    assert plan.count("MapInArrow") == 1


def test_places_of_columns_are_those_of_pairs(spark):
    rng = random.Random(4)
    names = ["Colour", "qty", "unit price", "size"]
    texts = ["color", "colors", "quantity", "qty.", "price", "unit prices", "size", "s", "", "weights", "colour of it"]
    tables = {t: [rng.choice(texts) for _ in range(rng.randint(0, 5))] for t in range(80)}
    pairs = [(t, n, i, h) for t, hs in tables.items() for i, h in enumerate(hs) for n in names]
    want = {(r.tbl, r.col): r.header for r in matching.match_columns(spark.createDataFrame(pairs, "tbl int, col string, header int, h string")).collect()}
    lists = spark.createDataFrame(list(tables.items()), "tbl int, v array<string>")
    got = {r.tbl: r.at for r in lists.select("tbl", matching.column_places(names)(F.col("v")).alias("at")).collect()}
    assert got == {t: [want.get((t, n)) for n in names] for t in tables}


def test_lines_and_cells_of_a_page_are_settled_in_its_row(spark):
    plan = e10_spatial_cells(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Aggregate" not in plan[: plan.index("ArrowEvalPython")]


def test_numbers_on_pages_are_those_of_the_expressions(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("0123,.$-() a") for _ in range(rng.randint(0, 7))) for _ in range(600)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", V.looks_numeric(F.col("x")).alias("n"), V.signed(F.col("x")).alias("s"), spatial.norm(F.col("x")).alias("u")).collect()
    assert [(r.n, r.s, r.u) for r in sorted(got)] == [(spatial._NUMBER.match(x.replace(" ", "")) is not None, spatial._signed(x), spatial._spoken(x)[0]) for x in texts]
