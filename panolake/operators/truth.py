"""Ground truth in the world as annotations of cube-map images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panolake.functions import camera, geometry
from panolake.operators import ranges
from panolake.operators.spatial import distance_pairs


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """Rows numbered from 1 in order, by ranges, so that no task holds all of them."""
    return ranges.places(rows, *order).withColumn(name, F.col("place") + 1).drop("place")


def _vertices(objects: DataFrame, cameras: DataFrame, within: float, skipped: tuple[int, ...]) -> DataFrame:
    """The vertices of outlines (at, their place) by the cameras near them: fx, fy, fz along the camera's axes, and the face that each falls on.

    Objects and cameras are as many as the world has, so none of them goes to the driver to be broadcast; outlines, the longest
    rows, move once, to the pairs of their object.
    """
    vertices = objects.select("object_id", "outline", F.aggregate("outline", F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), lambda s, p: F.struct((s["x"] + p["x"]).alias("x"), (s["y"] + p["y"]).alias("y"))).alias("sum"))
    centre = F.coalesce(geometry.centroid(F.col("outline")), F.struct((F.col("sum.x") / F.size("outline")).alias("x"), (F.col("sum.y") / F.size("outline")).alias("y")))
    centred = ranges.settled(vertices, {"c": centre}).select(F.col("object_id").alias("id"), "c.x", "c.y")
    near = distance_pairs(centred, cameras.select(F.col("camera_id").alias("id"), "x", "y").hint("merge"), within).select("a", "b")
    posed = cameras.where(F.col("model").isin(*camera.RIGS)).select(F.col("camera_id").alias("b"), "model", "size", "image_path", *[F.col(c).alias(f"c{c}") for c in "xyz"], "rx", "ry", "rz")
    posed = ranges.settled(posed, {"opk": F.array(*camera.opk_of_world_to_camera(camera.euler_matrix(*(F.col(c) for c in ("rx", "ry", "rz")))))}).drop("rx", "ry", "rz")
    posed = ranges.settled(posed, {"turned": F.array(*camera.transposed(camera.opk_matrix(*(F.get("opk", i) for i in range(3)))))}).drop("opk")
    pairs = ranges.spread(near.join(posed.hint("merge"), "b"), "a")
    met = pairs.join(objects.select(F.col("object_id").alias("a"), "category_id", "outline").hint("merge"), "a").select(F.col("b").alias("camera_id"), F.col("a").alias("object_id"), "category_id", "model", "size", "image_path", "cx", "cy", "cz", "turned", F.posexplode("outline").alias("at", "p"))
    frame = camera.times(tuple(F.get("turned", i) for i in range(9)), tuple(F.col(f"p.{c}") - F.col(f"c{c}") for c in "xyz"))
    seen = ranges.settled(met, {f"f{n}": c for c, n in zip(frame, "xyz", strict=True)}).drop("cx", "cy", "cz", "turned", "p")
    # As camera.face_of, but within generated code.
    dots = [next(F.col(f"f{n}") * f for n, f in zip("xyz", face, strict=True) if f) for face in camera.FACES]
    seen = ranges.settled(seen, {"most": F.greatest(*dots)})
    face = F.coalesce(*[F.when(d == F.col("most"), k) for k, d in enumerate(dots)])
    seen = ranges.settled(seen, {"face": face}).drop("most")
    return seen.where(~F.col("face").isin(*skipped)) if skipped else seen


def _image_id():
    return 4 * F.col("camera_id") + F.col("face")


def images_of(objects: DataFrame, cameras: DataFrame, within: float = 20.0, skipped: tuple[int, ...] = (4, 5)) -> DataFrame:
    """The images of ``on_faces`` alone."""
    seen = _vertices(objects, cameras, within, skipped)
    return seen.select(_image_id().alias("id"), F.get("image_path", F.col("face")).alias("file_name"), F.col("size").alias("width"), F.col("size").alias("height")).distinct()


def on_faces(objects: DataFrame, cameras: DataFrame, within: float = 20.0, corners: int = 50, least: float = 200.0, skipped: tuple[int, ...] = (4, 5)) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) of outlines in the world as the cube faces of nearby cameras show them.

    ``objects``: object_id, category_id, outline (array of x, y, z; the first vertex closes it), each with its centre
    nearer than ``within`` to a camera in plan. ``cameras``: camera_id, model (a rig's name), x, y, z, rx, ry, rz
    (radians), size (pixels of a face) and image_path (a name for each face).

    Each vertex is seen by one sensor and falls on one face. What a face holds of an outline becomes an annotation
    if it has over ``corners`` vertices and an area over ``least`` pixels; its segmentation is cut to whole pixels,
    the box and the area are not. Faces that hold any vertex are images, also without an annotation; ``skipped``
    faces are neither. Image ids are ``4 * camera_id + face``, so they are unique while faces 4 and 5 are skipped.
    Unknown models, null outlines and cameras without a pose give nothing.
    """
    seen = _vertices(objects, cameras, within, skipped)
    way = tuple(F.col(f"f{n}") for n in "xyz")
    sensor, seat = None, [None] * 3
    for name, rig in camera.RIGS.items():
        own = F.col("model") == name
        mine = camera.sensor_of(*camera.lat_lon(way), rig)
        sensor = F.when(own, mine) if sensor is None else sensor.when(own, mine)
        for i, c in enumerate(camera.sensor_offset(F.col("sensor"), rig)):
            seat[i] = F.when(own, c) if seat[i] is None else seat[i].when(own, c)
    seen = ranges.settled(seen, {"sensor": sensor})
    from_seat = tuple(c - F.coalesce(s, F.lit(0.0)) for c, s in zip(way, seat, strict=True))
    model = camera.turned_by_face(F.col("face"), from_seat, back=True)
    seen = ranges.settled(seen, {"file_name": F.get("image_path", F.col("face"))} | {f"m{n}": c for c, n in zip(model, "xyz", strict=True)})
    u, v = camera.pinhole_pixel(tuple(F.col(f"m{n}") for n in "xyz"), F.col("size"))
    shapes = seen.groupBy("camera_id", "object_id", "category_id", "face", "size", "file_name").agg(F.array_sort(F.collect_list(F.struct("at", u.alias("x"), v.alias("y")))).alias("ring"))
    large = ranges.settled(shapes.where(F.size("ring") > corners), {"area": geometry.area(F.col("ring")), "b": geometry.bounds(F.col("ring"))}).where(F.col("area") > least)
    whole = F.flatten(F.transform("ring", lambda p: F.array(p["x"].cast("long"), p["y"].cast("long"))))
    rows = large.select("camera_id", "object_id", "face", _image_id().alias("image_id"), "category_id", F.array(whole).alias("segmentation"), "area", F.array("b.x", "b.y", "b.w", "b.h").alias("bbox"), F.lit(0).alias("iscrowd"))
    return images_of(objects, cameras, within, skipped), numbered(rows, "id", "camera_id", "object_id", "face").drop("camera_id", "face")
