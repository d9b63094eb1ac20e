"""A table whose file is small may be a million rows, which the driver would hold to broadcast them."""

from test_links import plan_of

from upland.operators import spatial, validation
from upland.plans.features import grown


def test_entities_are_not_broadcast_by_the_size_of_their_file(spark, sf_dir):
    assert "BroadcastHashJoin" not in plan_of(grown(spark, sf_dir).filter("ntl_growth_log is not null").select("id", "ntl_growth_log"))


def test_autocorrelation_broadcasts_no_points(spark, sf_dir):
    """Points of one leaf, so no row of a leaf is joined."""
    points = grown(spark, sf_dir).select("id", "latitude", "longitude", "ntl_growth_log")
    assert "BroadcastHashJoin" not in plan_of(validation.moran(points, "ntl_growth_log", 8))
    written = validation.cut(points, "points")
    assert "BroadcastHashJoin" not in plan_of(spatial.spatial_lag(written, "ntl_growth_log", 8))
    assert "BroadcastHashJoin" not in plan_of(spatial.radius_count(written, written.select("latitude", "longitude"), 0.5, "n"))
