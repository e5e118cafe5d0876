"""Points against many polygons: each polygon is covered by cells of a grid, and points meet the cells by an equality join.

A polygon's grid is as coarse as its extent allows: at most `across` cells a side, so a
cover is bounded however large the polygon. A cell that no edge passes is inside or outside
as a whole; points of inside cells are answered by the join, and only those of cells on the
edge are tested by ray casting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells a side of a polygon's extent.
ACROSS = 48
#: What rounding can shift an edge, in cells.
MARGIN = 1e-6


def level_of(extent: float, across: int = ACROSS) -> int:
    """Cells of 2**-level degrees, as many as fit `across` times into the extent at most."""
    return int(np.floor(np.log2(across / extent))) if extent > 0 else 24


def cells_of(lat: np.ndarray, lng: np.ndarray, across: int = ACROSS) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(level, rows, columns, inner) of the cells that the polygon touches; inner ones lie in it as a whole."""
    level = level_of(max(np.ptp(lat), np.ptp(lng)), across)
    size = 2.0**-level
    y, x = lat / size, lng / size
    top, left = int(np.floor(y.min() - MARGIN)), int(np.floor(x.min() - MARGIN))
    height, width = int(np.floor(y.max() + MARGIN)) - top + 1, int(np.floor(x.max() + MARGIN)) - left + 1
    edge, inside = np.zeros((height, width), bool), np.zeros((height, width), bool)
    middle_y, middle_x = np.arange(height) + top + 0.5, np.arange(width) + left + 0.5
    for ay, ax, by, bx in zip(y, x, np.roll(y, -1), np.roll(x, -1), strict=True):
        low, high = min(ay, by), max(ay, by)
        rows = np.arange(int(np.floor(low - MARGIN)), int(np.floor(high + MARGIN)) + 1)
        if ay == by:
            one, two = np.full(len(rows), ax), np.full(len(rows), bx)
        else:
            at = lambda v: ax + (np.clip(v, low, high) - ay) / (by - ay) * (bx - ax)
            one, two = at(rows), at(rows + 1.0)
        for r, c0, c1 in zip((rows - top).tolist(), (np.floor(np.minimum(one, two) - MARGIN) - left).astype(int).tolist(), (np.floor(np.maximum(one, two) + MARGIN) - left).astype(int).tolist(), strict=True):
            edge[r, max(c0, 0) : c1 + 1] = True
        across_row = (ay > middle_y) != (by > middle_y)
        if across_row.any():
            meets = ax + (middle_y[across_row] - ay) / (by - ay) * (bx - ax)
            inside[across_row] ^= middle_x[None, :] < meets[:, None]
    r, c = np.nonzero(edge | inside)
    return level, r + top, c + left, ~edge[r, c]


def covers(polygons: DataFrame, key: str, across: int = ACROSS) -> DataFrame:
    """key, level, r, c, inner of each polygon's cells, from key and vertices: array<struct<lat, lng>>; less than three vertices hold nothing."""
    kind = polygons.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, vertices in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                place = np.array([(v["lat"], v["lng"]) for v in vertices], float)
                level, r, c, inner = cells_of(place[:, 0], place[:, 1], across)
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(r), batch.column(0).type), pa.array(np.full(len(r), level, np.int32)), pa.array(r), pa.array(c), pa.array(inner)], names=[key, "level", "r", "c", "inner"])

    return polygons.filter("size(vertices) >= 3").select(key, "vertices").mapInArrow(work, f"{key} {kind}, level int, r long, c long, inner boolean")


def odd_crossings(lat: Column, lng: Column, vertices: Column) -> Column:
    """Ray casting against array<struct<lat, lng>>: whether an odd number of edges lies east of the point."""
    n = F.size(vertices)

    def crossed(i: Column) -> Column:
        a, b = F.get(vertices, i), F.get(vertices, (i + 1) % n)
        at = (b["lng"] - a["lng"]) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lng"]
        return ((a["lat"] > lat) != (b["lat"] > lat)) & (lng < at)

    return F.size(F.filter(F.sequence(F.lit(0), n - 1), crossed)) % 2 == 1


def holding(points: DataFrame, polygons: DataFrame, point: str, key: str, across: int = ACROSS) -> DataFrame:
    """(point, key): every point with every polygon that holds it. points: point, lat, lng; polygons: key, vertices."""
    cells = covers(polygons, key, across)
    levels = sorted(r.level for r in cells.select("level").distinct().collect())  # a power of two each: a few dozen at most
    if not levels:
        return points.select(point).join(polygons.select(key).limit(0), F.lit(False))
    at = lambda c, level: F.floor(F.col(c) * float(2.0**level)).cast("long")
    places = F.inline(F.array(*[F.struct(F.lit(n).alias("level"), at("lat", n).alias("r"), at("lng", n).alias("c")) for n in levels]))
    met = points.select(point, "lat", "lng", places).join(cells, ["level", "r", "c"])
    sure = met.filter("inner").select(point, key)
    tested = met.filter("not inner").join(polygons.select(key, "vertices"), key)
    return sure.unionByName(tested.filter(odd_crossings(F.col("lat"), F.col("lng"), F.col("vertices"))).select(point, key))


def outlines(rows: DataFrame, key: str, tie: str, directions: int = 32) -> DataFrame:
    """key, vertices: the farthest row of each key in each of so many directions, counter-clockwise; a polygon of hull points, in one aggregation."""
    far = []
    for d in range(directions):
        turn = 2 * np.pi * d / directions
        along = F.col("lat") * float(np.sin(turn)) + F.col("lng") * float(np.cos(turn))
        far.append(F.max_by(F.struct("lat", "lng"), F.struct(along.alias("a"), F.col(tie))).alias(f"v{d}"))
    return rows.groupBy(key).agg(*far).select(key, F.array(*[f"v{d}" for d in range(directions)]).alias("vertices"))
