"""Rings cut by cells against rings tested whole."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.spatial import points_in_polygons, ring_cells

RING = "raster_id int, polygon_id int, role string, ring array<struct<x double, y double>>"


def rings():
    rnd = random.Random(2)
    star = lambda n, r: [(300 + math.cos(2 * math.pi * k / n) * r * (0.4 + 0.6 * rnd.random()), 300 + math.sin(2 * math.pi * k / n) * r * (0.4 + 0.6 * rnd.random())) for k in range(n)]
    stairs = [(p, q) for i in range(12) for p, q in ((i * 16, i * 16), (i * 16 + 16, i * 16))] + [(192, 300), (0, 300)]
    box = [(32, 32), (64, 32), (96, 32), (96, 96), (64, 96), (32, 96), (32, 64)]
    comb = [(0, 0), *[(x, 0 if x % 64 else 250) for x in range(32, 512, 32)], (512, 0), (512, 300), (0, 300)]
    tie = [(100, 100), (200, 200), (200, 100), (100, 200)]
    return [star(300, 280), star(40, 200), stairs, box, comb, tie, [(x, y) for x, y in reversed(stairs)]]


@pytest.mark.parametrize("cell,mode", [(32, "ring"), (77, "strict"), (1000, "ring")])
def test_same_points(spark, cell, mode):
    rnd = random.Random(1)
    shapes = [(i % 2, i, "aoi", [(float(x), float(y)) for x, y in r]) for i, r in enumerate(rings())]
    shapes.append(shapes[3])
    at = [(k % 2, float(x), float(y)) for k in range(2) for x in range(0, 520, 32) for y in range(0, 520, 32)]
    at += [(rnd.randrange(2), rnd.uniform(-10, 600), rnd.uniform(-10, 600)) for _ in range(1000)] + [(s[0], *p) for s in shapes for p in s[3]]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "id int, raster_id int, x double, y double").repartition(4)
    polygons = spark.createDataFrame(shapes, RING)
    whole = points_in_polygons(points, polygons, cell, mode, 10**6)
    cut = points_in_polygons(points, polygons, cell, mode, 0)
    rows = lambda df: sorted(tuple(r) for r in df.select("id", "polygon_id", "role").collect())
    want = rows(whole)
    assert len(want) > 500 and rows(cut) == want


def test_edges_are_not_copied(spark):
    n = 5_000
    ring = [(4000 + math.cos(2 * math.pi * k / n) * 3900, 4000 + math.sin(2 * math.pi * k / n) * 3900) for k in range(n)]
    cells = ring_cells(spark.createDataFrame([(0, 1, "aoi", ring)], RING), 128)
    held = cells.agg(F.sum(F.size("_edges")), F.max(F.size("_edges")), F.count("*")).first()
    assert n <= held[0] < 1.1 * n and held[1] < 0.05 * n and held[2] < 62 * 62
    assert points_in_polygons(spark.createDataFrame([(0, 4000.0, 4000.0), (0, 100.0, 100.0)], "raster_id int, x double, y double"), spark.createDataFrame([(0, 1, "aoi", ring)], RING)).count() == 1
