"""What is made of an order's lines is made where the lines were dealt, and few times."""

from oracle import SF_DIR

from quire.operators.ruled import cells
from quire.plans.matching import match_columns
from quire.plans.spatial import e10_spatial_cells
from quire.session import dealt


def test_tasks_follow_the_rows(spark):
    assert dealt(spark, spark.range(1000), "id", 100).rdd.getNumPartitions() == 11


def test_a_page_is_read_for_all_its_cells_at_once(spark):
    plan = e10_spatial_cells(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") <= 4


def test_corners_of_ruled_cells_meet_without_a_join(spark):
    lines = [(1, x, 0.0, x, 20.0) for x in (0.0, 10.0, 20.0)] + [(1, 0.0, y, 20.0, y) for y in (0.0, 10.0, 20.0)]
    found = cells(spark.createDataFrame(lines, "page int, x0 double, y0 double, x1 double, y1 double"))
    assert sorted(map(tuple, found.collect())) == [(1, x, y, x + 10, y + 10) for x in (0.0, 10.0) for y in (0.0, 10.0)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_two_texts_are_compared_once_for_all_tables(spark):
    rows = [(t, "Skucode", h, k) for t in range(50) for k, h in enumerate(("sku code", "weight"))]
    pairs = spark.createDataFrame(rows, "tbl long, col string, h string, header int")
    found = match_columns(pairs)
    assert sorted(map(tuple, found.collect())) == [(t, "Skucode", 0) for t in range(50)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("MapInPandas") :].splitlines()[1]
    assert "Aggregate" in below
