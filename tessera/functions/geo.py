"""Affine, geographic and polygon expressions. A ring is an array of (x, y) structs."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import rings

EARTH_M = 6_371_000.0
#: WGS84.
A, FLAT = 6_378_137.0, 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
K0 = 0.9996
N = FLAT / (2 - FLAT)
RECT = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
#: Krueger's series to the fourth order.
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45, 7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45, 56 * N**3 / 15 - 136 * N**4 / 35, 4279 * N**4 / 630)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row."""
    return F.transform(F.array(value), body)[0]


def to_crs(x: Column, y: Column, t: tuple[Column, ...]) -> tuple[Column, Column]:
    a, b, c, d, e, f = t
    return c + x * a + y * b, f + x * d + y * e


def to_pixel(gx: Column, gy: Column, t: tuple[Column, ...]) -> tuple[Column, Column]:
    """Inverse affine; (0, 0) where it is singular."""
    a, b, c, d, e, f = t
    det = a * e - b * d
    flat = F.abs(det) < 1e-20
    dx, dy = gx - c, gy - f
    inv = lambda v: F.when(flat, 0.0).otherwise(F.try_divide(v, det))
    return inv(e * dx - b * dy), inv(a * dy - d * dx)


def to_pixel_or_null(gx: Column, gy: Column, t: tuple[Column, ...]) -> tuple[Column, Column]:
    """Inverse affine as the screen takes it: null where the determinant is below 1e-10."""
    a, b, c, d, e, f = t
    det = a * e - b * d
    dx, dy = gx - c, gy - f
    inv = lambda v: F.when(F.abs(det) >= 1e-10, F.try_divide(v, det))
    return inv(e * dx - b * dy), inv(a * dy - d * dx)


def transform_cols(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(f"{prefix}{c}") for c in "abcdef")


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def ring_to_crs(ring: Column, t: tuple[Column, ...]) -> Column:
    return F.transform(ring, lambda p: point(*to_crs(p["x"], p["y"], t)))


def both(value: Column, body) -> Column:
    """Point of the pair ``body(x, y)`` of a point that is computed once a row, as lambdas share no subexpressions."""
    return let(value, lambda p: point(*body(p["x"], p["y"])))


def ring_to_pixel(ring: Column, t: tuple[Column, ...]) -> Column:
    return F.transform(ring, lambda p: point(*to_pixel(p["x"], p["y"], t)))


def utm_inverse(x: Column, y: Column, zone: Column, south: Column) -> Column:
    """Point (lon, lat) of UTM coordinates."""
    at = point((x - 500_000.0) / (K0 * RECT), (y - F.when(south, 10_000_000.0).otherwise(0.0)) / (K0 * RECT))

    def on_sphere(eta: Column, xi: Column) -> tuple[Column, Column]:
        xi1, eta1 = xi, eta
        for j, b in enumerate(BETA, 1):
            xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        return eta1, xi1

    def degrees(eta1: Column, xi1: Column) -> tuple[Column, Column]:
        latitude = lambda chi: F.degrees(chi + sum((dj * F.sin(2 * j * chi) for j, dj in enumerate(DELTA, 1)), F.lit(0.0)))
        return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), let(F.asin(F.sin(xi1) / F.cosh(eta1)), latitude)

    return both(both(at, on_sphere), degrees)


def utm_forward(lon: Column, lat: Column, zone: Column) -> Column:
    """Point of UTM coordinates (northern hemisphere's origin) of lon/lat."""
    k = 2 * math.sqrt(N) / (1 + N)
    at = point(F.radians(lon - (zone * 6 - 183)), let(F.sin(F.radians(lat)), lambda s: F.sinh(F.atanh(s) - k * F.atanh(k * s))))

    def metres(eta: Column, xi: Column) -> tuple[Column, Column]:
        x, y = eta, xi
        for j, a in enumerate(ALPHA, 1):
            x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return 500_000.0 + K0 * RECT * x, K0 * RECT * y

    return both(both(at, lambda lam, t: (F.atanh(F.sin(lam) / F.sqrt(1 + t * t)), F.atan2(t, F.cos(lam)))), metres)


def lonlat_point(gx: Column, gy: Column, epsg: Column) -> Column:
    """Identity for 4326, inverse Web Mercator for 3857, inverse UTM for 326xx and 327xx; else a point of nulls."""
    utm = epsg.between(32601, 32660) | epsg.between(32701, 32760)

    def at(p: Column) -> Column:
        x, y = p["x"], p["y"]
        lon = F.when(epsg == 4326, x).when(epsg == 3857, F.degrees(x / A))
        lat = F.when(epsg == 4326, y).when(epsg == 3857, F.degrees(2 * F.atan(F.exp(y / A)) - math.pi / 2))
        return F.when(utm, utm_inverse(x, y, epsg % 100, epsg >= 32701)).otherwise(point(lon, lat))

    return let(point(gx.cast("double"), gy.cast("double")), at)


def to_lonlat(gx: Column, gy: Column, epsg: Column) -> tuple[Column, Column]:
    p = lonlat_point(gx, gy, epsg)
    return p["x"], p["y"]


def crs_point(lon: Column, lat: Column, epsg: Column) -> Column:
    """The way back from ``lonlat_point``."""
    utm = epsg.between(32601, 32660) | epsg.between(32701, 32760)

    def at(p: Column) -> Column:
        x = F.when(epsg == 4326, p["x"]).when(epsg == 3857, A * F.radians(p["x"]))
        y = F.when(epsg == 4326, p["y"]).when(epsg == 3857, A * F.log(F.tan(math.pi / 4 + F.radians(p["y"]) / 2)))
        north = F.when(epsg >= 32701, 10_000_000.0).otherwise(0.0)
        return F.when(utm, both(utm_forward(p["x"], p["y"], epsg % 100), lambda u, v: (u, v + north))).otherwise(point(x, y))

    return let(point(lon.cast("double"), lat.cast("double")), at)


def from_lonlat(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    p = crs_point(lon, lat, epsg)
    return p["x"], p["y"]


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.atan2(F.sqrt(h), F.sqrt(1 - h))


#: Angle in radians beyond which two points are nearly opposite; steps of the two ways to a geodesic; nodes of its integrals.
OPPOSITE, TURNS, HALVINGS, NODES = 3.0, 14, 48, 16


def _excess(s: Column, sigma: Column, sin: Column, cos: Column, twice: Column) -> Column:
    """How much the sphere's longitude exceeds the ellipsoid's: Vincenty's series for a geodesic that leaves the equator with
    sine ``s``, ``twice`` being the cosine of twice the middle of the arc."""
    c2 = 1 - s * s
    c = FLAT / 16 * c2 * (4 + FLAT * (4 - 3 * c2))
    return (1 - c) * FLAT * s * (sigma + c * sin * (twice + c * cos * (2 * twice * twice - 1)))


def _arc(p: Column, sin: Column, cos: Column) -> Column:
    """Arc on the auxiliary sphere that leaves the first latitude with this azimuth and ends at its ascent of the second."""
    s0, x = sin * p["cu"], cos * p["cu"]
    y = F.sqrt(F.greatest(F.lit(0.0), x * x + (p["su"] - p["sv"]) * (p["su"] + p["sv"])))
    ends = F.struct(s0.alias("s0"), (cos * cos + sin * sin * p["su"] * p["su"]).alias("c2"), F.atan2(p["su"], x).alias("from"), F.atan2(p["sv"], y).alias("to"))
    return ends.withField("turn", F.atan2(s0 * p["sv"], y) - F.atan2(s0 * p["su"], x))


def _length(p: Column, arc: Column) -> Column:
    """Length by Gauss-Legendre integration; what the longitude misses is added by the first variation of the length."""
    x, w = np.polynomial.legendre.leggauss(NODES)
    nodes = F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("w")) for a, b in zip(x, w)))
    half, mid, k2 = (arc["to"] - arc["from"]) / 2, (arc["to"] + arc["from"]) / 2, arc["c2"] * (E2 / (1 - E2))
    root = lambda n: F.sqrt(1 + k2 * F.pow(F.sin(mid + half * n["x"]), 2))
    add = lambda s, n: let(root(n), lambda r: F.struct((s["m"] + n["w"] * r).alias("m"), (s["l"] + n["w"] * (2 - FLAT) / (1 + (1 - FLAT) * r)).alias("l")))
    zero = F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("l"))
    missed = lambda s: p["lam"] - arc["turn"] + FLAT * arc["s0"] * half * s["l"]
    return F.aggregate(nodes, zero, add, lambda s: A * (1 - FLAT) * half * s["m"] + A * arc["s0"] * missed(s))


def _direct(p: Column) -> Column:
    """Arc between points that are not nearly opposite: Vincenty's iteration of the sphere's longitude."""

    def at(lam: Column) -> Column:
        y = p["cv"] * F.sin(lam)
        x = F.sin(p["v"] - p["u"]) + 2 * p["su"] * p["cv"] * F.pow(F.sin(lam / 2), 2)
        return F.struct(y.alias("y"), x.alias("x"), F.hypot(x, y).alias("sin"), (p["su"] * p["sv"] + p["cu"] * p["cv"] * F.cos(lam)).alias("cos"))

    def turn(lam: Column, _: Column) -> Column:
        def longer(g: Column) -> Column:
            s = F.when(g["sin"] > 0, p["cu"] * g["y"] / g["sin"]).otherwise(0.0)
            twice = lambda s: g["cos"] - F.coalesce(F.try_divide(2 * p["su"] * p["sv"], 1 - s * s), F.lit(0.0))
            return let(s, lambda s: let(twice(s), lambda t: p["lam"] + _excess(s, F.atan2(g["sin"], g["cos"]), g["sin"], g["cos"], t)))

        return let(at(lam), longer)

    lam = F.aggregate(F.sequence(F.lit(1), F.lit(TURNS)), p["lam"], turn)
    azimuth = lambda g: F.when(g["sin"] > 0, F.struct((g["y"] / g["sin"]).alias("s"), (g["x"] / g["sin"]).alias("c"))).otherwise(F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("c")))
    return let(let(lam, lambda v: let(at(v), azimuth)), lambda z: _arc(p, z["s"], z["c"]))


def _opposite(p: Column) -> Column:
    """Arc between points that are nearly opposite: the one azimuth in 0..pi that meets the longitude, by bisection."""

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        turn = lambda a: a["turn"] - _excess(a["s0"], a["to"] - a["from"], F.sin(a["to"] - a["from"]), F.cos(a["to"] - a["from"]), F.cos(a["to"] + a["from"]))
        over = let(_arc(p, F.sin(mid), F.cos(mid)), lambda a: turn(a) > p["lam"])
        return F.when(over, F.struct(s["lo"].alias("lo"), mid.alias("hi"))).otherwise(F.struct(mid.alias("lo"), s["hi"].alias("hi")))

    both = F.struct(F.lit(0.0).alias("lo"), F.lit(math.pi).alias("hi"))
    mid = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), both, halve, lambda s: (s["lo"] + s["hi"]) / 2)
    return let(mid, lambda z: _arc(p, F.sin(z), F.cos(z)))


def geodesic(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points on WGS84, to far below a millimetre, opposite points and poles included; null if a coordinate is."""
    b1, b2 = (F.atan((1 - FLAT) * F.tan(F.radians(v.cast("double")))) for v in (lat1, lat2))
    lam = F.radians(F.abs(F.pmod(lon2 - lon1 + F.lit(180.0), F.lit(360.0)) - 180))
    # By symmetry the first point lies south of the equator and at least as far from it as the second.
    first = F.abs(b1) >= F.abs(b2)
    far, near = F.when(first, b1).otherwise(b2), F.when(first, b2).otherwise(b1)
    u = F.when(far.isNotNull() & near.isNotNull() & lam.isNotNull(), F.least(-F.abs(far), F.lit(-1e-100)))
    v = F.when(far > 0, -near).otherwise(near)
    full = lambda c: F.struct(*(c[k].alias(k) for k in ("u", "v", "lam")), F.sin(c["u"]).alias("su"), F.cos(c["u"]).alias("cu"), F.sin(c["v"]).alias("sv"), F.cos(c["v"]).alias("cv"))
    wide = lambda p: p["su"] * p["sv"] + p["cu"] * p["cv"] * F.cos(p["lam"]) < math.cos(OPPOSITE)
    arc = lambda p: let(F.when(wide(p), _opposite(p)).otherwise(_direct(p)), lambda a: _length(p, a))
    return let(F.struct(u.alias("u"), v.alias("v"), lam.alias("lam")), lambda c: let(full(c), arc))


def pixel_size_m(a: Column, e: Column, lat: Column, geographic: Column) -> tuple[Column, Column]:
    scale = 111_320.0
    return F.when(geographic, F.abs(a) * scale * F.cos(F.radians(lat))).otherwise(F.abs(a)), F.when(geographic, F.abs(e) * scale).otherwise(F.abs(e))


def edges(ring: Column) -> Column:
    """Array of (ax, ay, bx, by), the last vertex joined to the first."""
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, turned, lambda p, q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")))


def _sum(items: Column, term) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, e: s + term(e))


def _cross(e: Column) -> Column:
    return e["ax"] * e["by"] - e["bx"] * e["ay"]


def signed_area(ring: Column) -> Column:
    """Shoelace; positive if counter-clockwise with y upwards. Counted from the first vertex, so that small rings far
    from the origin keep their digits."""
    first = F.get(ring, F.lit(0))
    near = F.transform(ring, lambda p: point(p["x"] - first["x"], p["y"] - first["y"]))
    return _sum(edges(near), _cross) / 2


def perimeter(ring: Column) -> Column:
    return _sum(edges(ring), lambda e: F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"]))


def centroid(ring: Column) -> tuple[Column, Column]:
    """Area-weighted; the vertices' mean if the area is 0."""
    area = signed_area(ring)
    mean = lambda k: _sum(ring, lambda p: p[k]) / F.size(ring)
    x = _sum(edges(ring), lambda e: (e["ax"] + e["bx"]) * _cross(e))
    y = _sum(edges(ring), lambda e: (e["ay"] + e["by"]) * _cross(e))
    pick = lambda v, k: F.when(F.abs(area) < 1e-12, mean(k)).otherwise(F.try_divide(v, area * 6))
    return pick(x, "x"), pick(y, "y")


def diameter(ring: Column) -> Column:
    """Greatest distance of two vertices."""
    return rings.diameter(ring)


def closed(ring: Column) -> Column:
    """Finite vertices only, first one repeated at the end."""
    fine = F.filter(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")))
    return F.when((F.size(fine) > 0) & (F.get(fine, F.lit(0)) != F.element_at(fine, -1)), F.concat(fine, F.slice(fine, 1, 1))).otherwise(fine)


def crosses(e: Column, x: Column, y: Column) -> Column:
    """Whether the ray from a point to greater x crosses an edge; an edge holds its lower end only."""
    at = F.try_divide((e["bx"] - e["ax"]) * (y - e["ay"]), e["by"] - e["ay"]) + e["ax"]
    return F.coalesce(((e["ay"] > y) != (e["by"] > y)) & (x < at), F.lit(False))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd ray casting, lower and left borders inside."""
    return F.size(F.filter(edges(ring), lambda e: crosses(e, x, y))) % 2 == 1


def on_border(all_edges: Column, x: Column, y: Column) -> Column:
    """Whether a point lies on one of the edges."""
    flat = lambda e: (e["bx"] - e["ax"]) * (y - e["ay"]) == (e["by"] - e["ay"]) * (x - e["ax"])
    near = lambda e: x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))
    return F.exists(all_edges, lambda e: F.coalesce(near(e) & flat(e), F.lit(False)))


def simple(ring: Column) -> Column:
    """Whether the edges of a ring meet only where one ends and the next begins; fewer than three vertices make no ring."""
    return rings.simple(ring)


def thinned(ring: Column, least: float = 4.0) -> Column:
    """Drops a vertex that is closer than ``least`` to the last one kept."""
    none = F.slice(ring, 1, 0)
    far = lambda acc, p: (F.size(acc) == 0) | (F.hypot(p["x"] - F.element_at(acc, -1)["x"], p["y"] - F.element_at(acc, -1)["y"]) >= least)
    return F.aggregate(ring, none, lambda acc, p: F.when(F.size(acc) == 0, F.array(p)).when(far(acc, p), F.concat(acc, F.array(p))).otherwise(acc))


def circle_ring(cx: Column, cy: Column, r: Column, steps: int = 64) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: point(cx + r * F.cos(i * (2 * math.pi / steps)), cy - r * F.sin(i * (2 * math.pi / steps))))


def square(cx: Column, cy: Column, r: Column) -> Column:
    """Closed ring from the corner of least x and greatest y on, clockwise with y upwards."""
    return F.array(point(cx - r, cy + r), point(cx + r, cy + r), point(cx + r, cy - r), point(cx - r, cy - r), point(cx - r, cy + r))


#: Units of a metre.
UNITS = {
    "meters": 1.0, "centimeters": 100.0, "millimeters": 1000.0, "kilometers": 0.001, "feet": 3.28084,
    "yards": 1.09361, "miles": 0.000621371, "inches": 39.3701, "degrees": 1 / 111_320.0,
}
#: Metres of a screen pixel at 96 dots an inch.
SCREEN_PIXEL_M = 0.0002645833


def in_units(metres: Column) -> Column:
    """Struct with a distance in every unit."""
    return F.struct(*[(metres * k).alias(n) for n, k in UNITS.items()])


def calibration(a: Column, e: Column, geographic: Column, gsd_cm: Column) -> Column:
    """(status, x, y): metres of a pixel from a manual ground distance in cm, else from the transform if both sizes are plausible."""
    degrees = F.coalesce(geographic, F.lit(False)) & (F.abs(a) < 0.01)
    x, y = (F.abs(v) * F.when(degrees, 111_320.0).otherwise(1.0) for v in (a, e))
    plausible = lambda v: (v > 1e-5) & (v < 1e4)
    manual, known = F.coalesce(gsd_cm > 0, F.lit(False)), F.coalesce(plausible(x) & plausible(y), F.lit(False))
    status = F.when(manual, "calibrated").when(known, "georeferenced").otherwise("not_calibrated")
    pick = lambda v: F.when(manual, gsd_cm / 100).when(known, v)
    return F.struct(status.alias("status"), pick(x).alias("x"), pick(y).alias("y"))


def extent_in_pixels(min_x: Column, min_y: Column, max_x: Column, max_y: Column, t: tuple[Column, ...], margin: float = 0.1) -> Column:
    """Pixel rectangle (x, y, w, h) of bounds in the CRS, wider by ``margin`` of its size on each side."""
    (ax, ay), (bx, by) = to_pixel(min_x, min_y, t), to_pixel(max_x, max_y, t)
    w, h = F.abs(bx - ax), F.abs(by - ay)
    grown = 1 + 2 * margin
    return F.struct((F.least(ax, bx) - w * margin).alias("x"), (F.least(ay, by) - h * margin).alias("y"), (w * grown).alias("w"), (h * grown).alias("h"))


def scale_denominator(pixel_m: Column, zoom: Column) -> Column:
    """Whole number n of a map scale 1:n, at least 1; null without a pixel size."""
    return F.when(pixel_m > 0, F.greatest(F.floor(pixel_m / zoom / SCREEN_PIXEL_M), F.lit(1)))


def lookup(x: Column, y: Column, t: tuple[Column, ...], epsg: Column) -> tuple[Column, Column]:
    """(lon, lat) of the whole pixel under a point."""
    return to_lonlat(*to_crs(x.cast("int"), y.cast("int"), t), epsg)


def clockwise(ring: Column) -> Column:
    """Closed ring whose vertices run clockwise with y upwards, as vector files want exteriors."""
    return closed(F.when(signed_area(ring) > 0, F.reverse(ring)).otherwise(ring))


def geodesic_area(ring: Column) -> Column:
    """Area in m2 of a ring in longitude and latitude on the ellipsoid: the shoelace of its cylindrical equal-area image.

    Exact for edges along meridians and parallels; other edges are straight in that image instead of geodesic, which
    is far below a millionth for rings of some kilometres.
    """
    e = math.sqrt(E2)

    def height(lat: Column) -> Column:
        s = F.sin(F.radians(lat))
        return (1 - E2) / 2 * (s / (1 - E2 * s * s) + F.atanh(e * s) / e)

    return F.abs(signed_area(F.transform(ring, lambda p: point(A * F.radians(p["x"]), A * height(p["y"])))))


def local_utm_area(ring: Column) -> Column:
    """Area in m2 of a ring in longitude and latitude, in the UTM zone of its vertices' mean."""
    lon, lat = label_position(ring)
    zone = F.greatest(F.lit(1), F.least(F.lit(60), F.floor((lon + 180) / 6) + 1))
    return F.abs(signed_area(F.transform(ring, lambda p: utm_forward(p["x"], p["y"], zone))))


def area_m2(ring_crs: Column, epsg: Column) -> Column:
    """Area of a ring in its CRS: in the local UTM zone for longitude and latitude, else planar (metres or pixels)."""
    return F.when(epsg == 4326, local_utm_area(ring_crs)).otherwise(F.abs(signed_area(ring_crs)))


def label_position(ring: Column) -> tuple[Column, Column]:
    """Mean of the vertices."""
    return tuple(_sum(ring, lambda p, k=k: p[k]) / F.size(ring) for k in ("x", "y"))
