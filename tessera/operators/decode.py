"""Model outputs to detections, and scoring by a user's model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import box as B


def decode_rows(raw: DataFrame, size: float, conf: float, pad: float = 0.0, scale: float = 1.0, overlap: float = 64.0) -> DataFrame:
    """Rows ``vec`` of 5 (box, score), 6 (box, score, class) or more features (box, objectness, class scores)."""
    n, v = F.size("vec"), lambda i: F.get("vec", F.lit(i)).cast("double")
    scores = F.slice("vec", 6, F.greatest(n - 5, F.lit(1)))
    best = F.array_max(scores).cast("double")
    df = raw.withColumn("score", F.when(n > 6, v(4) * best).otherwise(v(4)))
    df = df.withColumn("class_id", F.when(n > 6, F.array_position(scores, F.array_max(scores)) - 1).when(n == 6, F.floor(v(5))).otherwise(0).cast("int"))
    box = B.absolute((v(0), v(1), v(2), v(3)), F.lit(size), ["raster_id", "tile_id"])
    df = df.where("size(vec) >= 5").withColumns(dict(zip(("x1", "y1", "x2", "y2"), box)))
    cx, cy = B.centre(B.cols())
    df = df.where((F.col("score") >= conf) & cx.between(pad, size - pad) & cy.between(pad, size - pad))
    back = B.ordered(tuple(B.unletterbox(c, F.lit(pad), F.lit(scale)) for c in B.cols()))
    df = df.withColumns(dict(zip(("x1", "y1", "x2", "y2"), back))).where("x2 > x1 AND y2 > y1")
    least, share = B.border_distance(B.cols(), F.lit(size), F.lit(size))
    return df.withColumn("edge", B.on_edge(least, F.lit(overlap))).withColumn("border_dist", share).drop("vec")


SIDES = ("x1", "y1", "x2", "y2")
#: What is known of a tile: its letterbox in the model's input, its corner in the raster, its size.
TILE = ("scale", "left", "top", "tile_x", "tile_y", "tile_w", "tile_h")


def placed(df: DataFrame, overlap: float = 64.0) -> DataFrame:
    """Boxes of a model's input back in the raster: letterbox undone, ordered, cut to the tile, moved to its corner. Empty
    ones go; ``edge`` and ``border_dist`` are the tile's."""
    w, h = F.col("tile_w").cast("double"), F.col("tile_h").cast("double")
    back = tuple(B.unletterbox(F.col(c), F.col(p), F.col("scale")) for c, p in zip(SIDES, ("left", "top", "left", "top")))
    inside = B.clamped(B.ordered(back), w, h)
    least, share = B.border_distance(inside, w, h)
    moved = dict(zip(SIDES, B.shifted(inside, F.col("tile_x"), F.col("tile_y"))))
    df = df.withColumns(moved | {"edge": B.on_edge(least, F.lit(overlap)), "border_dist": share})
    return df.where("x2 > x1 AND y2 > y1").drop(*TILE)


def _listed(raw: DataFrame, *more: str) -> DataFrame:
    df = raw.select("raster_id", "tile_id", *TILE, *more, F.posexplode(F.arrays_zip("boxes", "labels", "scores")).alias("det_idx", "d"))
    at = [F.get("d.boxes", F.lit(i)).cast("double").alias(c) for i, c in enumerate(SIDES)]
    return df.select("raster_id", "tile_id", *TILE, *more, "det_idx", *at, F.col("d.labels").cast("int").alias("class_id"), F.col("d.scores").cast("double").alias("score"))


def decode_lists(raw: DataFrame, conf: float, overlap: float = 64.0) -> DataFrame:
    """Parallel arrays boxes, labels, scores of a two-stage detector (and ``TILE``); of unequal lengths: no rows."""
    same = (F.size("boxes") == F.size("labels")) & (F.size("boxes") == F.size("scores"))
    return placed(_listed(raw.where(same)).where(F.col("score") >= conf), overlap)


def decode_three(raw: DataFrame, size: float, conf: float, overlap: float = 64.0) -> DataFrame:
    """Outputs boxes, scores, labels (and ``TILE``) as far as the shortest goes. Coordinates of up to 1.01 in all of a
    tile's boxes are fractions of the input size; after that those of a box's own are."""
    top = F.array_max(F.transform("boxes", lambda b: F.array_max(F.transform(F.slice(b, 1, 4), lambda v: F.abs(v)))))
    n = F.least(F.size("boxes"), F.size("labels"), F.size("scores"))
    df = raw.withColumn("fractions", F.coalesce(top <= 1.01, F.lit(False)))
    df = _listed(df.withColumns({c: F.slice(c, F.lit(1), n) for c in ("boxes", "labels", "scores")}), "fractions")
    df = df.withColumns({c: F.when(F.col("fractions"), F.col(c) * size).otherwise(F.col(c)) for c in SIDES})
    small = F.greatest(*map(F.abs, B.cols())) <= 1.01
    df = df.withColumns({c: F.when(small, F.col(c) * size).otherwise(F.col(c)) for c in SIDES})
    return placed(df.where(F.col("score") >= conf).drop("fractions"), overlap)


def layout(shapes: Column) -> Column:
    """What a model's outputs are, from an array of shapes (unknown sizes null): kind (``lists`` of three outputs, else
    ``rows``), valid, transposed, detections, features.

    Rows are (batch, detections, features) of at least five features, or transposed if the second size is under 100 and
    the third over 1000. Where a size is unknown: 8400 detections, and 85 features if theirs is.
    """
    one = F.get(shapes, F.lit(0))
    a, b, flat = F.get(one, F.lit(1)), F.get(one, F.lit(2)), F.size(one) == 3
    turned, known = F.coalesce((a < 100) & (b > 1000), F.lit(False)), a.isNotNull() & b.isNotNull()
    features = F.when(turned, a).otherwise(F.coalesce(b, F.lit(85)))
    rows = F.struct(
        F.lit("rows").alias("kind"),
        F.coalesce(flat & (features >= 5), F.lit(False)).alias("valid"),
        F.coalesce(flat & turned, F.lit(False)).alias("transposed"),
        F.when(flat, F.when(turned, b).when(known, a).otherwise(8400)).cast("int").alias("detections"),
        F.when(flat, features).cast("int").alias("features"),
    )
    none = F.lit(None).cast("int")
    lists = F.struct(F.lit("lists").alias("kind"), F.lit(True).alias("valid"), F.lit(False).alias("transposed"), none.alias("detections"), none.alias("features"))
    return F.when(F.size(shapes) == 3, lists).otherwise(rows)


def from_centres(rows: DataFrame) -> DataFrame:
    """Rows ``vec`` of five or more features, whose box is centre and size: as corners."""
    v = lambda i: F.get("vec", F.lit(i)).cast("double")
    rest = F.slice(F.col("vec").cast("array<double>"), F.lit(5), F.greatest(F.size("vec") - 4, F.lit(0)))
    turned = F.concat(F.array(*B.from_centre(v(0), v(1), v(2), v(3))), rest)
    return rows.withColumn("vec", F.when(F.size("vec") >= 5, turned).otherwise(F.col("vec").cast("array<double>")))


def transposed(raw: DataFrame) -> DataFrame:
    """(key columns, feature, values) -> (key columns, det_idx, vec): features become positions."""
    df = raw.select("raster_id", "tile_id", "feature", F.posexplode("values").alias("det_idx", "v"))
    vec = F.transform(F.array_sort(F.collect_list(F.struct("feature", "v"))), lambda x: x["v"])
    return df.groupBy("raster_id", "tile_id", "det_idx").agg(vec.alias("vec"))


def tile_shape(shape: Column) -> tuple[Column, Column]:
    """(h, w): of three axes the last two if the first is channels (at most 4), else the first two; otherwise the last two.
    0 where there are fewer."""
    first = (F.size(shape) == 3) & (F.get(shape, F.lit(0)) > 4)
    at = lambda k: F.when(first, F.get(shape, F.lit(k))).when(F.size(shape) >= 2, F.get(shape, F.size(shape) - 2 + k)).otherwise(0)
    return at(0), at(1)


def score_tiles(tiles: DataFrame, model: Callable[[np.ndarray], list[np.ndarray]], shape: tuple[int, ...], batch: int = 4) -> DataFrame:
    """The user's model over payloads in batches, scaled to 0..1; it returns an array (n, 5+) of rows for each tile."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                x = np.stack(part["payload"].to_numpy()).reshape(-1, *shape) / 255.0
                for key, found in zip(part[["raster_id", "tile_id"]].itertuples(index=False), model(x.astype(np.float32))):
                    out += [(*key, k, np.asarray(v, np.float32)) for k, v in enumerate(found)]
            yield pd.DataFrame(out, columns=["raster_id", "tile_id", "det_idx", "vec"])

    return tiles.select("raster_id", "tile_id", "payload").mapInPandas(run, "raster_id int, tile_id long, det_idx int, vec array<float>")


def named_rows(results: DataFrame, names: Column, keys: list[str]) -> DataFrame:
    """Result arrays (boxes, scores, classes) as a row per detection with its class name; arrays count as far as the shortest
    goes, a null one is empty."""
    arrays = [F.coalesce(c, F.array()) for c in map(F.col, ("boxes", "scores", "classes"))]
    n = F.least(*map(F.size, arrays))
    rows = F.arrays_zip(*[F.slice(c, 1, n).alias(k) for c, k in zip(arrays, ("box", "score", "class_id"))])
    df = results.select(*keys, F.posexplode(rows).alias("pos", "r"))
    sides = [F.get("r.box", F.lit(i)).cast("double").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]
    return df.select(*keys, "pos", *sides, F.col("r.score").cast("double").alias("score"), B.class_name(F.col("r.class_id"), names).alias("class_name"))
