"""What SQL users call: a table function for tile grids, and functions for boxes, distances and polygons."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


@F.udtf
class TileWindows:
    """``tile_windows(w, h, tile, overlap)``: a row for each overlapping tile (tile_id, x_off, y_off, w, h); the last one of
    a row or column shrinks to the edge. Nulls give no tile."""

    @staticmethod
    def analyze(w: AnalyzeArgument, h: AnalyzeArgument, tile: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        if tile.isConstantExpression and overlap.isConstantExpression and None not in (tile.value, overlap.value) and not 0 <= overlap.value < tile.value:
            raise ValueError("overlap must be less than the tile")
        out = StructType()
        for c in ("tile_id", "x_off", "y_off", "w", "h"):
            out = out.add(c, IntegerType())
        return AnalyzeResult(out)

    def eval(self, w: int, h: int, tile: int, overlap: int) -> Iterator[tuple[int, int, int, int, int]]:
        if None in (w, h, tile, overlap):
            return
        if not 0 <= overlap < tile:
            raise ValueError("overlap must be less than the tile")
        stride = tile - overlap
        nx, ny = (max(1, -(-(n - overlap) // stride)) for n in (w, h))
        for i in range(nx * ny):
            x, y = i % nx * stride, i // nx * stride
            yield i + 1, x, y, min(tile, w - x), min(tile, h - y)


BOX = "STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>"
RING = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"
_SIDE = "greatest(0D, least(a.{1}, b.{1}) - greatest(a.{0}, b.{0}))"
_INTER = f"{_SIDE.format('x1', 'x2')} * {_SIDE.format('y1', 'y2')}"
_AREA = "greatest(0D, {0}.x2 - {0}.x1) * greatest(0D, {0}.y2 - {0}.y1)"
_UNION = f"({_AREA.format('a')} + {_AREA.format('b')} - {_INTER})"
_HALF = "(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))"
_TURNED = "concat(slice(ring, 2, greatest(size(ring) - 1, 0)), slice(ring, 1, 1))"
_CROSSES = "coalesce((p.y > y) <> (q.y > y) AND x < try_divide((q.x - p.x) * (y - p.y), q.y - p.y) + p.x, false)"
#: name: parameters, result, expression. Spark puts the expression in the place of the call, so all of it is optimised.
FUNCTIONS = {
    "iou": (f"a {BOX}, b {BOX}", "DOUBLE", f"CASE WHEN {_UNION} > 0 THEN {_INTER} / {_UNION} ELSE 0D END"),
    "haversine": ("lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE", "DOUBLE", f"2 * 6371000D * atan2(sqrt({_HALF}), sqrt(1 - {_HALF}))"),
    "in_polygon": (f"ring {RING}, x DOUBLE, y DOUBLE", "BOOLEAN", f"size(filter(zip_with(ring, {_TURNED}, (p, q) -> {_CROSSES}), c -> c)) % 2 = 1"),
}


def register(spark: SparkSession) -> None:
    """Makes ``tile_windows``, ``iou``, ``haversine`` and ``in_polygon`` known to a session's SQL."""
    spark.udtf.register("tile_windows", TileWindows)
    for name, (given, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {kind} RETURN {body}")
