"""Box algebra as column expressions. A box is four columns (x1, y1, x2, y2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def cols(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))  # type: ignore[return-value]


def letterbox(w: Column, h: Column, to_w: Column, to_h: Column) -> tuple[Column, Column, Column]:
    """(scale, pad_x, pad_y) of a fit that keeps the aspect; sizes round half-even, pads floor."""
    scale = F.least(to_h / h, to_w / w)
    return scale, F.floor((to_w - F.rint(w * scale)) / 2), F.floor((to_h - F.rint(h * scale)) / 2)


def unletterbox(v: Column, pad: Column, scale: Column) -> Column:
    return F.try_divide(v - pad, scale)


def ordered(b: Box) -> Box:
    return F.least(b[0], b[2]), F.least(b[1], b[3]), F.greatest(b[0], b[2]), F.greatest(b[1], b[3])


def clamped(b: Box, w: Column, h: Column) -> Box:
    zero = F.lit(0.0)
    return tuple(F.greatest(zero, F.least(m, v)) for v, m in zip(b, (w, h, w, h)))  # type: ignore[return-value]


def shifted(b: Box, dx: Column, dy: Column) -> Box:
    return b[0] + dx, b[1] + dy, b[2] + dx, b[3] + dy


def centre(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def border_distance(b: Box, w: Column, h: Column) -> tuple[Column, Column]:
    """Least distance to a side of the tile, and the same in halves of its shorter side, clamped to 0..1."""
    least = F.least(b[0], b[1], w - b[2], h - b[3])
    return least, F.greatest(F.lit(0.0), F.least(F.lit(1.0), least / F.greatest(F.lit(1.0), F.least(w, h) / 2)))


def on_edge(least: Column, overlap: Column) -> Column:
    return (overlap > 0) & (least <= overlap / 2)


def from_centre(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def corners(b: Box, cx: Column, cy: Column, w: Column, h: Column) -> Box:
    """Corners where a record has them, else from its centre and size."""
    return tuple(F.coalesce(a, c) for a, c in zip(b, from_centre(cx, cy, w, h)))  # type: ignore[return-value]


def on_preview(b: Box, scale: Column) -> Box:
    """Whole pixels of a scaled-down image, cut towards 0."""
    return tuple((v * scale).cast("int") for v in b)  # type: ignore[return-value]


def drawn_size(b: Box) -> tuple[Column, Column]:
    """Width and height on the screen: at least 1."""
    return F.greatest(F.lit(1.0), b[2] - b[0]), F.greatest(F.lit(1.0), b[3] - b[1])


#: Least side of a box that is drawn anew, and of one that is resized.
LEAST_DRAWN, LEAST_RESIZED = 5.0, 2.0


def large_enough(b: Box, least: float = LEAST_DRAWN) -> Column:
    return (b[2] - b[0] >= least) & (b[3] - b[1] >= least)


def absolute(b: Box, size: Column, tile: Sequence[str]) -> Box:
    """Coordinates of up to 1.01 in all of a tile's boxes, or in a row's own, are fractions of the input size."""
    top = F.greatest(*map(F.abs, b))
    fraction = (F.max(top).over(Window.partitionBy(*tile)) <= 1.01) | (top <= 1.01)
    return tuple(F.when(fraction, v * size).otherwise(v) for v in b)  # type: ignore[return-value]


def area(b: Box) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def iou(a: Box, b: Box) -> Column:
    """Intersection over union of clamped areas; 0 if the union is empty."""
    inter = area((F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])))
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def _parts(a: Box, b: Box) -> tuple[Column, Column, Column]:
    """Width and height of what two boxes share (negative if they are apart), and the sum of their areas as they come."""
    raw = lambda v: (v[2] - v[0]) * (v[3] - v[1])
    return F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1]), raw(a) + raw(b)


def iou_raw(a: Box, b: Box) -> Column:
    """Intersection over union of areas as they come, negative ones too; 0 for boxes that are apart and for unions of 0 or less."""
    w, h, both = _parts(a, b)
    return F.when((w < 0) | (h < 0), 0.0).when(both - w * h <= 0, 0.0).otherwise(F.try_divide(w * h, both - w * h))


def iou_unguarded(a: Box, b: Box) -> Column:
    """Intersection over union without a guard: not a number if both are empty, infinite if only the union is."""
    w, h, both = _parts(a, b)
    inter = F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)
    return F.when(both != inter, F.try_divide(inter, both - inter)).otherwise(F.when(inter > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))


def duplicate(a: Box, b: Box, limit: Column) -> Column:
    """Whether the unguarded form exceeds ``limit``; what is not a number is no duplicate."""
    v = iou_unguarded(a, b)
    return ~F.isnan(v) & (v > limit)


def circle(b: Box, a: Column, e: Column) -> dict[str, Column]:
    """Inscribed circle in pixels and, by the pixel sizes, in CRS units."""
    r = F.least(b[2] - b[0], b[3] - b[1]) / 2
    m = r * (F.abs(a) + F.abs(e)) / 2
    return {"radius_px": r, "radius_m": m, "diameter_m": m * 2, "area_m2": F.pi() * m * m}


def ring(b: Box) -> Column:
    """Closed ring of five points."""
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(p(b[0], b[1]), p(b[2], b[1]), p(b[2], b[3]), p(b[0], b[3]), p(b[0], b[1]))


def class_name(class_id: Column, names: Column) -> Column:
    """``names`` is a map of ids to names; unknown ids are named by their number."""
    return F.coalesce(F.try_element_at(names, class_id), class_id.cast("string"))


#: Colours (blue, green, red) that classes take in turn.
COLOURS = [(0, 255, 0), (0, 165, 255), (255, 0, 0), (255, 255, 0), (255, 0, 255)]


def colour(class_id: Column) -> Column:
    every = F.array(*[F.array(*map(F.lit, c)) for c in COLOURS])
    return F.get(every, F.pmod(class_id, F.lit(len(COLOURS))).cast("int"))
