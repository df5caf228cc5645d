"""Polygons as arrays of x and y: areas, bounds, clipping, names; all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column, digits: int) -> Column:
    """Rounds halves to even, as detection scores are rounded."""
    return F.rint(x * 10**digits) / 10**digits


def box_iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes given as x, y, w, h; 0 for an empty union."""
    width = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    height = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    both = F.greatest(width, F.lit(0)) * F.greatest(height, F.lit(0))
    union = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when(union == 0, 0.0).otherwise(both.cast("double") / union)


def boxes_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return (a["x"] <= b["x"] + b["w"]) & (b["x"] <= a["x"] + a["w"]) & (a["y"] <= b["y"] + b["h"]) & (b["y"] <= a["y"] + a["h"])


def segmentation_box(parts: Column | str) -> Column:
    """Struct x, y, w, h around all points of a segmentation; null for none."""
    axis = lambda k: F.flatten(F.transform(parts, lambda ring: F.filter(ring, lambda _, i: i % 2 == k)))
    box = lambda p: F.struct(F.array_min(p["x"]).alias("x"), F.array_min(p["y"]).alias("y"), (F.array_max(p["x"]) - F.array_min(p["x"])).alias("w"), (F.array_max(p["y"]) - F.array_min(p["y"])).alias("h"))
    return bound(F.struct(axis(0).alias("x"), axis(1).alias("y")), lambda p: F.when(F.size(p["x"]) > 0, box(p)))


def ring(flat: Column) -> Column:
    """Vertices of a flat list of coordinates; rings of under five numbers are empty."""
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(flat) / 2).cast("int") - 1, F.lit(0))), lambda i: F.struct(F.get(flat, 2 * i).alias("x"), F.get(flat, 2 * i + 1).alias("y")))
    return F.when(F.size(flat) >= 5, pairs).otherwise(F.slice(pairs, 1, 0))


def bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once; a filter that is pushed down would else put its whole expression at each use, also within lambdas."""
    return F.get(F.transform(F.array(value), use), 0)


def _cross_sums(vertices: Column, term) -> Column:
    def summed(ring: Column) -> Column:
        n = F.size(ring)
        terms = F.transform(ring, lambda v, i: term(v, F.get(ring, F.pmod(i + 1, n))))
        return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)

    return bound(vertices, summed)


def signed_area(vertices: Column) -> Column:
    return _cross_sums(vertices, lambda p, q: (p["x"] * q["y"] - q["x"] * p["y"]).cast("double")) / 2


def area(vertices: Column) -> Column:
    return F.abs(signed_area(vertices))


def centroid(vertices: Column) -> Column:
    """Struct x, y: the centre of mass; null for an empty area."""
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    six = F.nullif(6 * signed_area(vertices), F.lit(0.0))
    return F.struct(
        (_cross_sums(vertices, lambda p, q: ((p["x"] + q["x"]) * cross(p, q)).cast("double")) / six).alias("x"),
        (_cross_sums(vertices, lambda p, q: ((p["y"] + q["y"]) * cross(p, q)).cast("double")) / six).alias("y"),
    )


def bounds(vertices: Column) -> Column:
    """Struct x, y, w, h."""
    def box(ring: Column) -> Column:
        xs, ys = F.transform(ring, lambda v: v["x"]), F.transform(ring, lambda v: v["y"])
        return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"))

    return bound(vertices, box)


def shift(flat: Column, x: Column, y: Column) -> Column:
    return F.transform(flat, lambda v, i: v + F.when(i % 2 == 0, x).otherwise(y))


def scale(vertices: Column, by: float) -> Column:
    """Vertices moved from their mean by a factor."""
    def moved(ring: Column) -> Column:
        mean = lambda axis: F.aggregate(F.transform(ring, lambda v: v[axis].cast("double")), F.lit(0.0), lambda a, t: a + t) / F.size(ring)
        to = lambda m: F.transform(ring, lambda v: F.struct(*[(m[c] + (v[c] - m[c]) * by).alias(c) for c in "xy"]))
        return bound(F.struct(mean("x").alias("x"), mean("y").alias("y")), to)

    return bound(vertices, moved)


def point_buffer(x: Column, y: Column, radius: float, corners: int = 64) -> Column:
    """The polygon of ``corners`` corners around a point."""
    return F.transform(F.sequence(F.lit(0), F.lit(corners - 1)), lambda i: F.struct((x + radius * F.cos(2 * F.pi() * i / corners)).alias("x"), (y + radius * F.sin(2 * F.pi() * i / corners)).alias("y")))


def clamp(value: Column, low: Column, size: Column | int) -> Column:
    """A coordinate inside a tile that begins at ``low``."""
    return F.greatest(F.least(value - low, F.lit(size) if isinstance(size, int) else size), F.lit(0))


def clip_span(origin: Column, length: Column, size: int) -> Column:
    """Struct origin, length of a box side cut to [0, size]."""
    begin = F.greatest(origin, F.lit(0))
    cut = F.when(origin < 0, F.least(length + origin, F.lit(size))).when(origin + length > size, size - origin).otherwise(length)
    return F.struct(begin.alias("origin"), cut.alias("length"))


def clip_ring(vertices: Column, x0: Column, y0: Column, size: int) -> Column:
    """A ring clamped to a tile; runs along the tile's edges and repeated vertices collapse.

    The first vertex always stays and does not count as seen, so that a closing vertex is kept.
    """
    moved = F.transform(vertices, lambda v: F.struct(clamp(v["x"], x0, size).alias("x"), clamp(v["y"], y0, size).alias("y")))
    edge = lambda c: (c == 0) | (c == size)

    def step(kept: Column, v: Column) -> Column:
        last = F.element_at(kept, -1)
        again = (edge(v["x"]) & (v["x"] == last["x"])) | (edge(v["y"]) & (v["y"] == last["y"])) | F.array_contains(F.slice(kept, 2, F.size(kept)), v)
        return F.when(again, kept).otherwise(F.concat(kept, F.array(v)))

    return F.aggregate(F.slice(moved, 2, F.size(moved)), F.slice(moved, 1, 1), step)


def on_border(vertices: Column, size: int, share: float = 0.02) -> Column:
    """All vertices lie near the same pair of tile edges."""
    near = lambda axis: F.forall(vertices, lambda v: (v[axis] <= share * size) | (v[axis] >= (1 - share) * size))
    return near("x") | near("y")


def nearest_nonzero(values: Column) -> Column:
    """Zeros take the nearest non-zero by place, the left one on ties."""
    places = lambda i: F.filter(F.transform(values, lambda v, j: F.struct(F.abs(i - j).alias("far"), j.alias("at"), v.alias("v"))), lambda s: s["v"] != 0)
    return F.transform(values, lambda v, i: F.when(v != 0, v).otherwise(F.coalesce(F.array_min(places(i))["v"], v)))


def wrap_around(us: Column, width: Column) -> Column:
    """Columns of a shape that crosses the seam: the larger side stays, the other moves to the edge."""
    over = F.array_max(us) - F.array_min(us) > width / 2
    right = F.size(F.filter(us, lambda u: u > width / 2))
    keep_right = right >= F.size(us) - right
    moved = F.transform(us, lambda u: F.when(keep_right & (u <= width / 2), width - 1).when(~keep_right & (u > width / 2), F.lit(0)).otherwise(u))
    return F.transform(F.when(over, moved).otherwise(us), lambda u: F.greatest(F.least(u, width - 1), F.lit(0)).cast("int"))


def tile_name(image: Column, x: Column, y: Column) -> Column:
    return F.concat(F.regexp_replace(image, r"\.\w+$", ""), F.lit("_"), x, F.lit("_"), y, F.lit(".jpg"))


def parse_tile_name(name: Column) -> Column:
    """Struct image, x, y of a tile's file name; nulls for other names."""
    part = lambda k: F.nullif(F.regexp_extract(name, r"^(?:.*/)?(.*)_(\d+)_(\d+)\.jpg$", k), F.lit(""))
    return F.struct(part(1).alias("image"), part(2).cast("int").alias("x"), part(3).cast("int").alias("y"))


def parse_frame_name(name: Column) -> Column:
    """Struct frame, model, face of names such as 102-lb4-0-35582.jpg; nulls if they have under four parts."""
    parts = F.split(F.regexp_replace(name, r"\.\w+$", ""), "-")
    some = F.size(parts) >= 4
    return F.struct(F.when(some, F.concat(F.get(parts, 0), F.lit("-"), F.get(parts, 3))).alias("frame"), F.when(some, F.get(parts, 1)).alias("model"), F.when(some, F.get(parts, 2)).alias("face"))


def rings(parts: Column) -> Column:
    """The rings of a segmentation: parts of under five numbers are left out."""
    return F.transform(F.filter(parts, lambda part: F.size(part) >= 5), ring)


def flat(vertices: Column) -> Column:
    """A ring as a flat list of coordinates."""
    return F.flatten(F.transform(vertices, lambda v: F.array(v["x"], v["y"])))


def segmentation(parts: Column) -> Column:
    """Rings as a segmentation: all in one list, one after another."""
    return F.array(F.flatten(F.transform(parts, flat)))


def parts_area(parts: Column) -> Column:
    """Area of rings that do not overlap."""
    return F.aggregate(F.transform(parts, area), F.lit(0.0), lambda a, x: a + x)


def inside(x: Column, y: Column, vertices: Column) -> Column:
    """A point lies in a ring or on its edge."""
    n = F.size(vertices)
    sides = F.transform(vertices, lambda v, i: F.struct(v["x"].alias("ax"), v["y"].alias("ay"), F.get(vertices, F.pmod(i + 1, n))["x"].alias("bx"), F.get(vertices, F.pmod(i + 1, n))["y"].alias("by")))
    cross = lambda s: (s["bx"] - s["ax"]) * (y - s["ay"]) - (s["by"] - s["ay"]) * (x - s["ax"])
    between = lambda s: (x >= F.least(s["ax"], s["bx"])) & (x <= F.greatest(s["ax"], s["bx"])) & (y >= F.least(s["ay"], s["by"])) & (y <= F.greatest(s["ay"], s["by"]))
    crossed = lambda s: ((s["ay"] > y) != (s["by"] > y)) & (F.when(s["by"] > s["ay"], cross(s)).otherwise(-cross(s)) > 0)
    return F.exists(sides, lambda s: (cross(s) == 0) & between(s)) | (F.size(F.filter(sides, crossed)) % 2 == 1)


def _meet(p: Column, q: Column) -> Column:
    """Two sides (a to b) share a point."""
    turn = lambda a, b, c: F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))
    on = lambda a, b, c: (c["x"] >= F.least(a["x"], b["x"])) & (c["x"] <= F.greatest(a["x"], b["x"])) & (c["y"] >= F.least(a["y"], b["y"])) & (c["y"] <= F.greatest(a["y"], b["y"]))
    a, b, c, d = p["a"], p["b"], q["a"], q["b"]
    one, two, three, four = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
    proper = (one != two) & (three != four)
    return proper | ((one == 0) & on(a, b, c)) | ((two == 0) & on(a, b, d)) | ((three == 0) & on(c, d, a)) | ((four == 0) & on(c, d, b))


def rings_intersect(one: Column, other: Column) -> Column:
    """Two rings, as closed areas, share a point."""
    sides = lambda r: F.transform(r, lambda v, i: F.struct(v.alias("a"), F.get(r, F.pmod(i + 1, F.size(r))).alias("b")))
    # The other's sides are bound once, not worked out again for each side of the one.
    touch = F.get(F.transform(F.array(sides(other)), lambda bound: F.exists(sides(one), lambda p: F.exists(bound, lambda q: _meet(p, q)))), 0)
    first = lambda r: (F.get(r, 0)["x"], F.get(r, 0)["y"])
    return touch | inside(*first(one), other) | inside(*first(other), one)


def with_suffix(name: Column, suffix: str) -> Column:
    """The name, ending in the suffix once."""
    return F.when(F.endswith(name, F.lit(suffix)), name).otherwise(F.concat(name, F.lit(suffix)))


def list_literal(text: Column) -> Column:
    """The strings of a list written as ['a', 'b']; null where it is none."""
    return F.from_json(F.replace(text, F.lit("'"), F.lit('"')), "array<string>")


def shown_name(name: Column, dataset: Column) -> Column:
    """Name of an image's picture with its dataset before it; tif becomes png."""
    return F.concat(dataset, F.lit("_"), F.replace(name, F.lit(".tif"), F.lit(".png")))


def truncated(box: Column) -> Column:
    """A box of whole numbers, cut toward zero."""
    return F.transform(box, lambda v: v.cast("int"))


def well_known_binary(vertices: Column) -> Column:
    """A ring as the well-known binary of a polygon, big-endian; the first vertex closes it."""
    closed = F.when(F.get(vertices, 0) == F.element_at(vertices, -1), vertices).otherwise(F.concat(vertices, F.slice(vertices, 1, 1)))
    head = F.concat(F.lit("000000000300000001"), F.lpad(F.hex(F.size(closed)), 8, "0"))
    return F.unhex(F.concat(head, F.array_join(F.transform(flat(closed), double_hex), "")))


def double_hex(value: Column) -> Column:
    """The sixteen hex digits of a double, from its sign, exponent and fraction."""
    v = F.abs(value.cast("double"))
    power = F.floor(F.log2(F.when(v == 0, 1.0).otherwise(v)))
    power = power + F.when(v >= F.pow(F.lit(2.0), power + 1), 1).when(v < F.pow(F.lit(2.0), power), -1).otherwise(0)
    fraction = ((v / F.pow(F.lit(2.0), power) - 1) * 2.0**52).cast("long")
    bits = F.when(v == 0, F.lit(0).cast("long")).otherwise(F.shiftleft((power + 1023).cast("long"), 52).bitwiseOR(fraction))
    return F.lpad(F.hex(bits.bitwiseOR(F.when(value < 0, F.lit(-(1 << 63))).otherwise(F.lit(0).cast("long")))), 16, "0")
