"""Summaries that read their inputs once."""

from spanloom.operators import stats


def test_pairs_of_a_summary_are_made_once(spark):
    frames = spark.range(6).selectExpr("id as name")
    pairs = spark.range(3).selectExpr("id as a", "id + 1 as b").where("rand(7) >= 0")
    offsets = spark.createDataFrame([(True,), (False,)], "ambiguous boolean")
    out = stats.pairing_summary(frames, pairs, offsets)
    assert "rand" not in out._jdf.queryExecution().toString()
    assert {r.metric: r.value for r in out.collect()} == {"selected_geometry_count": 6, "schedule_pair_count": 3, "schedule_image_coverage": 4, "images_without_pair": 2, "ambiguous_offset_count": 1}
