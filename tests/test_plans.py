"""Plans have the shapes they are meant to have."""

from pyspark.sql import functions as F

from upland.operators import spatial
from upland.plans import features
from upland.sources import panel as src


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_radius_join_is_an_equi_join(spark, sf_dir):
    plan = plan_of(spatial.within_radius(src.entities(spark, sf_dir), src.towers(spark, sf_dir), 1.5))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_polygon_join_is_an_equi_join(spark, sf_dir):
    from upland.plans.spatial_queries import polygons

    plan = plan_of(spatial.in_polygons(src.entities(spark, sf_dir), polygons(spark)))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_scan_reads_only_what_it_needs(spark, sf_dir):
    plan = plan_of(src.dense_panel(spark, sf_dir))
    schema = plan[plan.index("ReadSchema") :]
    assert "l_comment" not in schema and "l_tax" not in schema and "l_shipdate" in schema


def test_shortlist_takes_ordered(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan_of(features.shortlist(spark, sf_dir))


def test_cells_cover_the_radius(spark):
    a = spark.createDataFrame([(1, 10.0, 70.0)], "id int, latitude double, longitude double")
    b = spark.createDataFrame([(2, 11.5, 70.0), (3, 11.6, 70.0), (4, 8.6, 69.9)], "id int, latitude double, longitude double")
    assert {r.r_id for r in spatial.within_radius(a, b, 1.5).select(F.col("r_id")).collect()} == {2, 4}
