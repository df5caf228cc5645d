"""Camera geometry in closed form over DOUBLE columns: rotations, spherical and cube-map projection.

Vectors are tuples of three columns and matrices tuples of nine, row by row; angles are radians unless said.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]
Matrix = tuple[Column, ...]

#: The sensors of each rig: pos, dx, dy, dz, dphi, dkappa, domega (degrees), focal length, latmin, latmax, longmin, longmax.
RIGS = {
    "lb4": (
        (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 4.2589, -50, 45, -36, 36),
        (1, 0.059, 0.0, 0.042, -71.907528, -0.560417, -0.747527, 4.2622, -50, 45, 36, 108),
        (2, 0.035, 0.0, 0.111, -144.178867, 0.273426, 0.27623, 4.2598, -50, 45, 108, 180),
        (3, -0.037, 0.0, 0.11, -216.133942, 0.148435, 0.067258, 4.2711, -50, 45, -180, -108),
        (4, -0.058, 0.0, 0.042, -287.957784, 0.021902, 0.095168, 4.2693, -50, 45, -108, -36),
        (5, 0.0, 0.076, 0.061, -0.276425, 180.070803, 90.03968, 4.2496, 45, 90, -180, 180),
    ),
    "lb7": (
        (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 6.9523, -80, 48.5, -36, 36),
        (1, 0.081, 0.0, 0.059, -71.408048, -0.187507, -0.18868, 6.9605, -80, 48.5, 36, 108),
        (2, 0.05, 0.0, 0.155, -35.877048, 179.885125, 179.966422, 6.9843, -80, 48.5, 108, 180),
        (3, -0.05, 0.0, 0.155, 35.686974, 179.9219, 179.989853, 6.9582, -80, 48.5, -180, -108),
        (4, -0.081, 0.0, 0.059, 71.811261, -0.301029, 0.107712, 6.9669, -80, 48.5, -108, -36),
        (5, 0.0, 0.098, 0.085, 0.019793, 179.895394, 90.036577, 6.991, 48.5, 90, -180, 180),
    ),
    "lb8": (
        (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 6.9475, -80, 48.5, -36, 36),
        (1, 0.081, 0.0, 0.06, -71.925635, -0.066317, -0.003691, 6.9396, -80, 48.5, 36, 108),
        (2, 0.049, 0.001, 0.156, -143.834084, 0.272609, 0.418854, 6.9629, -80, 48.5, 108, 180),
        (3, -0.051, 0.001, 0.154, -215.966141, 0.139956, 0.010938, 6.9424, -80, 48.5, -180, -108),
        (4, -0.081, 0.0, 0.058, -287.842047, 0.260135, -0.126164, 6.9581, -80, 48.5, -108, -36),
        (5, -0.001, 0.095, 0.086, -0.15884, 179.999686, 90.133725, 6.9459, 48.5, 90, -180, 180),
    ),
    "lb10": (
        (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 6.9666, -80, 48.5, -36, 36),
        (1, 0.081, 0.001, 0.059, -72.0007, 0.766589, 0.83249, 6.9602, -80, 48.5, 36, 108),
        (2, 0.05, 0.0, 0.155, -36.053938, 179.809987, -179.999046, 6.9518, -80, 48.5, 108, 180),
        (3, -0.05, 0.0, 0.156, 35.6003, 179.644969, -179.722306, 6.9445, -80, 48.5, -180, -108),
        (4, -0.081, 0.0, 0.059, 72.018611, 0.571209, -0.604061, 6.9489, -80, 48.5, -108, -36),
        (5, 0.0, 0.098, 0.085, 0.131969, 179.782896, 89.923159, 6.9521, 48.5, 90, -180, 180),
    ),
}
LB4 = RIGS["lb4"]
#: Omega and phi of the cube faces, in degrees.
FACE_ANGLES = ((0, 0), (0, 180), (0, 90), (0, 270), (90, 0), (270, 0))
#: Axes that the six cube faces look along.
FACES = ((0, 0, -1), (0, 0, 1), (-1, 0, 0), (1, 0, 0), (0, 1, 0), (0, -1, 0))


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def length(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vector) -> Vector:
    return tuple(x / length(a) for x in a)


def transposed(m: Matrix) -> Matrix:
    return tuple(m[3 * j + i] for i in range(3) for j in range(3))


def times(m: Matrix, v: Vector) -> Vector:
    return tuple(m[3 * i] * v[0] + m[3 * i + 1] * v[1] + m[3 * i + 2] * v[2] for i in range(3))


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3))


def opk_matrix(omega: Column, phi: Column, kappa: Column) -> Matrix:
    """Rotation about x by omega, then y by phi, then z by kappa."""
    so, co, sp, cp, sk, ck = F.sin(omega), F.cos(omega), F.sin(phi), F.cos(phi), F.sin(kappa), F.cos(kappa)
    return (cp * ck, -cp * sk, sp, co * sk + so * sp * ck, co * ck - so * sp * sk, -so * cp, so * sk - co * sp * ck, so * ck + co * sp * sk, co * cp)


def opk_of(m: Matrix) -> Vector:
    """omega, phi, kappa of a rotation; omega is 0 where phi is a right angle."""
    locked = F.sqrt(m[0] * m[0] + m[1] * m[1]) < 1e-12
    return (
        F.when(locked, 0.0).otherwise(F.atan2(-m[5], m[8])),
        F.when(locked, F.signum(m[2]) * math.pi / 2).otherwise(F.atan2(m[2], F.sqrt(m[0] * m[0] + m[1] * m[1]))),
        F.when(locked, F.atan2(m[3], m[4])).otherwise(F.atan2(-m[1], m[0])),
    )


def ypr_matrix(yaw: Column, pitch: Column, roll: Column) -> Matrix:
    """Rz(-yaw) Rx(pitch) Ry(roll), in degrees."""
    y, p, r = -F.radians(yaw), F.radians(pitch), F.radians(roll)
    zero, one = F.lit(0.0), F.lit(1.0)
    rz = (F.cos(y), -F.sin(y), zero, F.sin(y), F.cos(y), zero, zero, zero, one)
    rx = (one, zero, zero, zero, F.cos(p), -F.sin(p), zero, F.sin(p), F.cos(p))
    ry = (F.cos(r), zero, F.sin(r), zero, one, zero, -F.sin(r), zero, F.cos(r))
    return product(product(rz, rx), ry)


def camera_axes(yaw: Column, pitch: Column, roll: Column) -> Matrix:
    """Camera to local: level and unturned, x looks east, y down, z north."""
    m = ypr_matrix(yaw, pitch, roll)
    return tuple(e for i in range(3) for e in (m[3 * i], -m[3 * i + 2], m[3 * i + 1]))


def to_camera(point: Vector, pose: Vector, yaw: Column, pitch: Column, roll: Column) -> Vector:
    return times(transposed(camera_axes(yaw, pitch, roll)), minus(point, pose))


def to_local(point: Vector, pose: Vector, yaw: Column, pitch: Column, roll: Column) -> Vector:
    return tuple(a + b for a, b in zip(times(camera_axes(yaw, pitch, roll), point), pose, strict=True))


def spherical_pixel(point: Vector, width: float, height: float) -> tuple[Column, Column]:
    f = width / (2 * math.pi)
    x, y, z = point
    return width / 2 + f * F.atan2(x, z), height / 2 + f * F.atan2(y, F.sqrt(x * x + z * z))


def spherical_point(u: Column, v: Column, distance: Column, width: float, height: float) -> Vector:
    f = width / (2 * math.pi)
    azimuth, elevation = (u - width / 2) / f, (v - height / 2) / f
    return distance * F.sin(azimuth) * F.cos(elevation), distance * F.sin(elevation), distance * F.cos(azimuth) * F.cos(elevation)


def homogeneous(rows: tuple[Column, ...], point: Vector) -> Vector:
    """A 4x4 matrix, row by row, applied to a point; divided by the fourth coordinate unless that is 0."""
    at = [rows[4 * i] * point[0] + rows[4 * i + 1] * point[1] + rows[4 * i + 2] * point[2] + rows[4 * i + 3] for i in range(4)]
    w = F.when(at[3] == 0, 1.0).otherwise(at[3])
    return tuple(x / w for x in at[:3])


def opk_degrees_of(m: Matrix) -> Vector:
    """omega, phi, kappa in degrees of a matrix in the transposed convention; omega is 0 where phi is nearly a right angle."""
    phi = F.atan2(m[6], F.sqrt(m[7] * m[7] + m[8] * m[8]))
    locked = F.abs(F.cos(phi)) <= 1e-8
    turned = F.atan2(m[1], m[2])
    upright = F.abs(phi - math.pi / 2) <= 1e-8 + 1e-5 * math.pi / 2
    return (
        F.degrees(F.when(locked, 0.0).otherwise(F.atan2(-m[7], m[8]))),
        F.degrees(phi),
        F.degrees(F.when(locked, F.when(upright, turned).otherwise(-turned)).otherwise(F.atan2(-m[3], m[0]))),
    )


def euler_matrix(rx: Column, ry: Column, rz: Column) -> Matrix:
    """Rz Ry Rx, in radians."""
    zero, one = F.lit(0.0), F.lit(1.0)
    z = (F.cos(rz), -F.sin(rz), zero, F.sin(rz), F.cos(rz), zero, zero, zero, one)
    y = (F.cos(ry), zero, F.sin(ry), zero, one, zero, -F.sin(ry), zero, F.cos(ry))
    x = (one, zero, zero, zero, F.cos(rx), -F.sin(rx), zero, F.sin(rx), F.cos(rx))
    return product(product(z, y), x)


def opk_of_world_to_camera(m: Matrix) -> Vector:
    """omega, phi, kappa of a rotation from world to camera axes; omega is 0 at the two poles."""
    free = F.abs(m[6]) < 1.0
    phi = F.when(free, F.asin(-m[6])).when(m[6] <= -1.0, math.pi / 2).otherwise(-math.pi / 2)
    c = F.cos(phi)
    return F.when(free, F.atan2(m[7] / c, m[8] / c)).otherwise(0.0), phi, F.when(free, F.atan2(m[3] / c, m[0] / c)).otherwise(F.atan2(-m[1], m[4]))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _vector(s: Column) -> Vector:
    return s["x"], s["y"], s["z"]


def _struct(v: Vector) -> Column:
    return F.struct(*[c.alias(n) for c, n in zip(v, "xyz", strict=True)])


def face_matrix(face: int) -> tuple[int, ...]:
    """Rotation of a cube face: right angles, so that its entries are whole numbers."""
    (so, co), (sp, cp) = ((round(math.sin(math.radians(a))), round(math.cos(math.radians(a)))) for a in FACE_ANGLES[face])
    return (cp, 0, sp, so * sp, co, -so * cp, -co * sp, so, co * cp)


def turned_by_face(face: Column, v: Vector, back: bool = False) -> Vector:
    """A vector from a face's axes to the camera's, or ``back``; null for other faces. Each axis is one of the vector's, or its opposite."""
    out = []
    for axis in range(3):
        choice = None
        for k in range(len(FACE_ANGLES)):
            m = face_matrix(k)
            row = [m[3 * i + axis] if back else m[3 * axis + i] for i in range(3)]
            at = next(i for i in range(3) if row[i])
            one = v[at] if row[at] > 0 else -v[at]
            choice = F.when(face == k, one) if choice is None else choice.when(face == k, one)
        out.append(choice)
    return tuple(out)


def sensor_offset(sensor: Column, rig=LB4) -> Vector:
    """dx, dy, dz of a sensor; null for an unknown number."""
    return tuple(F.get(F.array(*[F.lit(float(s[axis])) for s in rig]), sensor.cast("int")) for axis in range(1, 4))


def frame_to_model(frame: Vector, sensor: Column, face: Column, rig=LB4) -> Vector:
    """From the camera's axes to those of a cube face, seen from a sensor."""
    return turned_by_face(face, minus(frame, sensor_offset(sensor, rig)), back=True)


def sensor_of_model(model: Vector, face: Column, rig=LB4) -> Column:
    """The sensor whose mosaic holds a direction in a face's axes."""
    return _let(_struct(turned_by_face(face, model)), lambda v: sensor_of(*lat_lon(_vector(v)), rig))


def model_to_frame(model: Vector, sensor: Column, face: Column, rig=LB4) -> Vector:
    return tuple(a + b for a, b in zip(turned_by_face(face, model), sensor_offset(sensor, rig), strict=True))


def sensor_pose(sensor: Column, pose: Vector, opk: Vector, rig=LB4) -> Vector:
    """Where a sensor of a rig stands in the world."""
    return tuple(a + b for a, b in zip(times(opk_matrix(*opk), sensor_offset(sensor, rig)), pose, strict=True))


def world_to_frame(point: Vector, pose: Vector, opk: Vector) -> Vector:
    return times(transposed(opk_matrix(*opk)), minus(point, pose))


def frame_to_world(point: Vector, pose: Vector, opk: Vector) -> Vector:
    return tuple(a + b for a, b in zip(times(opk_matrix(*opk), point), pose, strict=True))


def lat_lon(frame: Vector) -> tuple[Column, Column]:
    """Degrees; the latitude is taken over x and y, as the mosaics of the rigs expect."""
    x, y, z = frame
    return F.degrees(F.atan2(y, F.sqrt(x * x + y * y))), F.degrees(F.atan2(x, -z))


def sensor_of(lat: Column, lon: Column, rig=LB4) -> Column:
    """The first sensor whose mosaic holds the direction, -1 for none."""

    def chosen(at: Column) -> Column:
        out = F.lit(-1)
        for pos, *_, latmin, latmax, longmin, longmax in reversed(rig):
            turn = longmin % 360
            inside = (F.pmod(at["lon"] - turn, F.lit(360.0)) <= (longmax - turn) % 360) & (at["lat"] >= latmin) & (at["lat"] <= latmax)
            out = F.when(inside, pos).otherwise(out)
        return out

    return _let(F.struct(lat.alias("lat"), lon.alias("lon")), chosen)


def face_of(direction: Vector) -> Column:
    """The cube face with the largest dot product, the first on ties."""
    dots = F.array(*[next(d if f > 0 else -d for d, f in zip(direction, face, strict=True) if f) for face in FACES])
    return _let(dots, lambda a: (F.array_position(a, F.array_max(a)) - 1).cast("int"))


def pinhole_pixel(point: Vector, size: float, pixel: float = 0.001) -> tuple[Column, Column]:
    """Pixel of a point in a cube face's axes; the focal length is half the face."""
    f = size * pixel / 2
    x, y = -f * point[0] / point[2], -f * point[1] / point[2]
    return x / pixel + size / 2, -y / pixel + size / 2


def pinhole_ray(u: Column, v: Column, size: float, pixel: float = 0.001) -> Vector:
    f = size * pixel / 2
    return unit(((u - size / 2) * pixel, -(v - size / 2) * pixel, F.lit(-f)))


def image_point(u: Column, v: Column, size: float, pixel: float = 0.001) -> tuple[Column, Column]:
    """Metres on the image plane of a pixel, the inverse of the last step of ``pinhole_pixel``."""
    return (u - size / 2) * pixel, -(v - size / 2) * pixel


def spherical_ray(u: Column, v: Column, pose: Vector, ypr: Vector, width: float, height: float) -> tuple[Vector, Vector]:
    """Origin and direction in the world of the ray through a panorama's pixel."""
    return pose, minus(to_local(spherical_point(u, v, F.lit(1.0), width, height), pose, *ypr), pose)


def cubemap_ray(u: Column, v: Column, face: Column, pose: Vector, opk: Vector, size: float, rig=LB4) -> Column:
    """Struct origin, direction, sensor: the ray in the world through a cube face's pixel, from the sensor that sees it."""
    turned = lambda v, m: tuple(m[f"m{3 * i}"] * v[0] + m[f"m{3 * i + 1}"] * v[1] + m[f"m{3 * i + 2}"] * v[2] for i in range(3))
    rotation = F.struct(*[c.alias(f"m{i}") for i, c in enumerate(opk_matrix(*opk))])

    def of(s: Column) -> Column:
        sensor = _let(s["way"], lambda w: sensor_of(*lat_lon(_vector(w)), rig))
        seat = turned(tuple(F.coalesce(c, F.lit(0.0)) for c in sensor_offset(sensor, rig)), s["m"])
        origin = tuple(a + b for a, b in zip(seat, pose, strict=True))
        return F.struct(_struct(origin).alias("origin"), _struct(turned(_vector(s["way"]), s["m"])).alias("direction"), sensor.alias("sensor"))

    model = _let(_struct(pinhole_ray(u, v, size)), lambda m: _struct(turned_by_face(face, _vector(m))))
    return _let(F.struct(model.alias("way"), rotation.alias("m")), of)


def radius_of_area(area: Column, ray: Vector, distance: Column, width: float, height: float) -> Column:
    """Radius of a level disk from its mask area; the ray's second axis is up. A zero ray raises an error."""
    n = length(ray)
    vy = ray[1] / F.when(n == 0, F.raise_error(F.lit("a ray must not be zero"))).otherwise(n)
    scale = (width * height) / (2 * math.pi**2) * (F.abs(vy) / F.sqrt(F.greatest(1 - vy * vy, F.lit(1e-12))))
    return distance * F.sqrt(area / scale)
