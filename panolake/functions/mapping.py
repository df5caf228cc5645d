"""The Swiss oblique Mercator projection as column expressions: both ways, its datum, and the convergence of meridians.

Angles are degrees, east and north metres in LV95. The sphere between ellipsoid and plane touches at the old observatory
of Bern; formulas are the closed ones of the survey's publication, in the order ellipsoid, sphere, turned sphere, plane.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from panolake.functions.camera import opk_matrix, product

#: Bessel's ellipsoid, the projection's centre, its false origin, the shift of the datum, and the ellipsoid of WGS 84.
BESSEL_A, BESSEL_E2 = 6377397.155, 0.006674372230614
CENTRE = (46 + 57 / 60 + 8.66 / 3600, 7 + 26 / 60 + 22.50 / 3600)
ORIGIN = (2_600_000.0, 1_200_000.0)
SHIFT = (674.374, 15.056, 405.346)
WGS84_A, WGS84_E2 = 6378137.0, 0.00669437999014

_E = math.sqrt(BESSEL_E2)
_PHI0, _LAMBDA0 = map(math.radians, CENTRE)
RADIUS = BESSEL_A * math.sqrt(1 - BESSEL_E2) / (1 - BESSEL_E2 * math.sin(_PHI0) ** 2)
ALPHA = math.sqrt(1 + BESSEL_E2 / (1 - BESSEL_E2) * math.cos(_PHI0) ** 4)
B0 = math.asin(math.sin(_PHI0) / ALPHA)
K = math.log(math.tan(math.pi / 4 + B0 / 2)) - ALPHA * math.log(math.tan(math.pi / 4 + _PHI0 / 2)) + ALPHA * _E / 2 * math.log((1 + _E * math.sin(_PHI0)) / (1 - _E * math.sin(_PHI0)))


def _let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` of a struct of values, each of which is worked out once."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), 0)


def _struct(**values: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in values.items()])


def _isometric(phi: Column) -> Column:
    return F.log(F.tan(math.pi / 4 + phi / 2)) - _E / 2 * F.log((1 + _E * F.sin(phi)) / (1 - _E * F.sin(phi)))


def to_plane(lat: Column, lon: Column) -> Column:
    """Struct east, north of a place on Bessel's ellipsoid."""
    turned = lambda s: _struct(
        l=F.atan(F.sin(s["l"]) / (math.sin(B0) * F.tan(s["b"]) + math.cos(B0) * F.cos(s["l"]))),
        b=F.asin(math.cos(B0) * F.sin(s["b"]) - math.sin(B0) * F.cos(s["b"]) * F.cos(s["l"])),
    )
    plane = lambda t: _struct(east=ORIGIN[0] + RADIUS * t["l"], north=ORIGIN[1] + RADIUS / 2 * F.log((1 + F.sin(t["b"])) / (1 - F.sin(t["b"]))))
    sphere = {"b": 2 * (F.atan(F.exp(ALPHA * _isometric(F.radians(lat)) + K)) - math.pi / 4), "l": ALPHA * (F.radians(lon) - _LAMBDA0)}
    return _let(sphere, lambda s: _let({"t": turned(s)}, lambda t: plane(t["t"])))


def from_plane(east: Column, north: Column, rounds: int = 7) -> Column:
    """Struct lat, lon on Bessel's ellipsoid; the latitude by a series that gains over two digits a round."""
    turned = {"l": (east - ORIGIN[0]) / RADIUS, "b": 2 * (F.atan(F.exp((north - ORIGIN[1]) / RADIUS)) - math.pi / 4)}

    def ellipsoid(t: Column) -> Column:
        b = F.asin(math.cos(B0) * F.sin(t["b"]) + math.sin(B0) * F.cos(t["b"]) * F.cos(t["l"]))
        l = F.atan(F.sin(t["l"]) / (math.cos(B0) * F.cos(t["l"]) - math.sin(B0) * F.tan(t["b"])))  # noqa: E741
        step = lambda level: lambda p, _: 2 * F.atan(F.exp(level + _E / 2 * F.log((1 + _E * F.sin(p)) / (1 - _E * F.sin(p))))) - math.pi / 2
        phi = _let({"b": b}, lambda s: _let({"b": s["b"], "level": (F.log(F.tan(math.pi / 4 + s["b"] / 2)) - K) / ALPHA}, lambda v: F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), v["b"], step(v["level"]))))
        return _struct(lat=F.degrees(phi), lon=F.degrees(_LAMBDA0 + l / ALPHA))

    return _let(turned, ellipsoid)


def _geocentric(lat: Column, lon: Column, height: Column, a: float, e2: float) -> Column:
    def place(s: Column) -> Column:
        n = a / F.sqrt(1 - e2 * F.sin(s["phi"]) * F.sin(s["phi"]))
        across = (n + s["h"]) * F.cos(s["phi"])
        return _struct(x=across * F.cos(s["lam"]), y=across * F.sin(s["lam"]), z=(n * (1 - e2) + s["h"]) * F.sin(s["phi"]))

    return _let({"phi": F.radians(lat), "lam": F.radians(lon), "h": height}, place)


def _geodetic(at: Column, sign: int, a: float, e2: float, rounds: int = 6) -> Column:
    """Struct lat, lon, height of a place, shifted by the datum first."""
    moved = {c: at[c] + sign * d for c, d in zip("xyz", SHIFT, strict=True)}
    step = lambda s: lambda f, _: F.atan2(s["z"] + e2 * a / F.sqrt(1 - e2 * F.sin(f) * F.sin(f)) * F.sin(f), s["p"])
    height = lambda v: v["p"] / F.cos(v["phi"]) - a / F.sqrt(1 - e2 * F.sin(v["phi"]) * F.sin(v["phi"]))
    found = lambda v: _struct(lat=F.degrees(v["phi"]), lon=F.degrees(v["lon"]), height=height(v))
    flat = lambda m: {"z": m["z"], "p": F.sqrt(m["x"] * m["x"] + m["y"] * m["y"]), "lon": F.atan2(m["y"], m["x"])}
    phi = lambda s: F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.atan2(s["z"], s["p"] * (1 - e2)), step(s))
    return _let(moved, lambda m: _let(flat(m), lambda s: _let({"p": s["p"], "lon": s["lon"], "phi": phi(s)}, found)))


def to_lv95(lat: Column, lon: Column, height: Column) -> Column:
    """Struct east, north of a place of WGS 84."""
    place = {"at": _geocentric(lat, lon, height, WGS84_A, WGS84_E2)}
    return _let(place, lambda s: _let({"g": _geodetic(s["at"], -1, BESSEL_A, BESSEL_E2)}, lambda v: to_plane(v["g"]["lat"], v["g"]["lon"])))


def from_lv95(east: Column, north: Column, height: Column) -> Column:
    """Struct lat, lon, height of WGS 84."""
    place = lambda s: {"at": _geocentric(s["p"]["lat"], s["p"]["lon"], s["h"], BESSEL_A, BESSEL_E2)}
    return _let({"p": from_plane(east, north), "h": height}, lambda s: _let(place(s), lambda v: _geodetic(v["at"], 1, WGS84_A, WGS84_E2)))


def meridian_convergence(east: Column, north: Column, height: Column, degrees_on: float = 1.0) -> Column:
    """Degrees by which the way ``degrees_on`` further north along the meridian turns from grid north, to the east."""
    ahead = lambda g: to_lv95(g["lat"] + degrees_on, g["lon"], g["height"])
    place = {"g": from_lv95(east, north, height)}
    return _let(place, lambda s: _let({"to": ahead(s["g"])}, lambda v: F.degrees(F.atan2(v["to"]["east"] - east, v["to"]["north"] - north))))


def turned_by_convergence(pose: tuple[Column, ...], convergence: Column) -> tuple[Column, ...]:
    """A rotation (nine entries by rows) in a frame that is turned by minus the convergence about the vertical axis."""
    zero = F.lit(0.0)
    turn = opk_matrix(zero, zero, F.radians(-convergence))
    return product(tuple(turn[3 * j + i] for i in range(3) for j in range(3)), pose)
