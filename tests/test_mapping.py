"""The map projection at published points, there and back, and the convergence of meridians."""

import math

import pytest
from pyspark.sql import functions as F

from panolake.functions import camera, mapping


def dms(d, m, s):
    return d + m / 60 + s / 3600


def test_published_points_within_a_millimetre(spark):
    rows = spark.createDataFrame([(dms(47, 3, 28.95659233), dms(8, 29, 11.11127154)), mapping.CENTRE], "lat double, lon double")
    rows = rows.select(mapping.to_plane(F.col("lat"), F.col("lon")).alias("p"), "lat", "lon").select("p.*", "lat", "lon")
    rows = rows.withColumn("back", mapping.from_plane(F.col("east"), F.col("north")))
    rigi, bern = rows.collect()
    assert (rigi["east"], rigi["north"]) == pytest.approx((2_679_520.05, 1_212_273.44), abs=1e-3)
    assert (bern["east"], bern["north"]) == pytest.approx(mapping.ORIGIN, abs=1e-6)
    for r in (rigi, bern):
        assert (r["back"]["lat"], r["back"]["lon"]) == pytest.approx((r["lat"], r["lon"]), abs=1e-12)


def test_there_and_back_over_the_country(spark):
    places = [(e * 1000.0, n * 1000.0, h) for e in range(2485, 2834, 60) for n in range(1075, 1296, 50) for h in (0.0, 4000.0)]
    rows = spark.createDataFrame(places, "e double, n double, h double")
    g = rows.withColumn("g", mapping.from_lv95(*map(F.col, "enh")))
    back = g.withColumn("p", mapping.to_lv95(F.col("g.lat"), F.col("g.lon"), F.col("g.height")))
    back = back.withColumn("c", mapping.meridian_convergence(*map(F.col, "enh"))).withColumn("near", mapping.meridian_convergence(*map(F.col, "enh"), degrees_on=1e-4)).collect()
    for r in back:
        assert (r["p"]["east"], r["p"]["north"]) == pytest.approx((r["e"], r["n"]), abs=2e-3)
        assert 45.5 < r["g"]["lat"] < 48.2 and 5.5 < r["g"]["lon"] < 11
        # Close by, the meridian turns as that of the conformal sphere does.
        assert r["near"] == pytest.approx(-math.degrees((math.radians(r["g"]["lon"]) - math.radians(mapping.CENTRE[1])) * math.sin(math.radians(r["g"]["lat"]))), abs=0.08)
        assert r["c"] == pytest.approx(r["near"], abs=0.1)


def test_a_turn_by_no_convergence_changes_nothing(spark):
    angles = [F.lit(a) for a in (0.3, -0.2, 1.1)]
    pose = camera.opk_matrix(*angles)
    for by, kappa in ((0.0, 1.1), (10.0, 1.1 + math.radians(10))):
        turned = mapping.turned_by_convergence(camera.opk_matrix(F.lit(0.0), F.lit(0.0), F.lit(1.1)), F.lit(by))
        row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(camera.opk_of(turned))]).first()
        assert row["c2"] == pytest.approx(kappa, abs=1e-12)
    same = mapping.turned_by_convergence(pose, F.lit(0.0))
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(same)], *[c.alias(f"d{i}") for i, c in enumerate(pose)]).first()
    assert [row[f"c{i}"] for i in range(9)] == pytest.approx([row[f"d{i}"] for i in range(9)], abs=1e-12)
