"""Geodesics with known lengths, and what has none."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import geo as G

CASES = [
    ((0.0, 0.0, 180.0, 0.0), 20003931.4586254),  # over a pole
    ((0.0, 90.0, 50.0, -90.0), 20003931.4586254),
    ((0.0, 0.0, 0.0, 90.0), 10001965.7293127),
    ((0.0, 0.0, 90.0, 0.0), 6378137 * math.pi / 2),
    ((0.0, 0.0, 179.0, 0.0), 6378137 * math.radians(179)),  # along the equator, nearly opposite
    ((0.0, 0.0, 179.5, 0.5), 19936288.578965),
    ((0.0, -30.0, 179.8, 29.9), 19989832.827610),
    ((179.9, 29.9, 0.1, -30.0), 19989832.827610),  # the same pair turned about, across the date line
    ((12.0, 40.0, 12.0, 40.0), 0.0),
    ((179.9999, 0.0, -179.9999, 0.0), 6378137 * math.radians(0.0002)),
    ((None, 0.0, 1.0, 1.0), None),
    ((1.0, 0.0, 1.0, None), None),
]


def test_known_lengths(spark):
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(CASES)], "i int, a double, b double, c double, d double")
    got = {r.i: r.m for r in df.select("i", G.geodesic(*map(F.col, "abcd")).alias("m")).collect()}
    for i, (_, want) in enumerate(CASES):
        assert got[i] == (want if want is None else pytest.approx(want, abs=1e-5)), CASES[i]
