"""Distributed selection against Spark's own percentile, bit by bit."""

from __future__ import annotations

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.selection import percentiles

bits = lambda x: None if x is None else "nan" if math.isnan(x) else struct.pack(">d", x + 0.0)
FRACTIONS = [0.0, 0.02, 0.37, 0.5, 0.98, 1.0]


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(3)
    inf, nan = float("inf"), float("nan")
    groups = [
        rng.normal(0, 1, 3000), np.exp(rng.normal(0, 60, 3000)), rng.integers(0, 5, 3000).astype(float), [7.0] * 50, [1.5], [2.0, 1.0], [nan, nan],
        [*rng.normal(0, 1, 500), inf, inf, -inf, nan, nan, None], [-1e300, 1e300, 0.0, -0.0, 5e-324, 1e-300], [None, None],
    ]
    rows = [(k, i % 2, None if v is None else float(v)) for k, g in enumerate(groups) for i, v in enumerate(g)]
    return spark.createDataFrame(rows, "k int, odd int, v double").repartition(5).cache()


@pytest.mark.parametrize("direct,small", [(0, 10_000), (0, 20), (0, 1), (10**6, 20)])
def test_same_bits(values, direct, small):
    want = values.where("v IS NOT NULL").groupBy("k").agg(F.count("*"), F.min("v"), F.max("v"), *[F.percentile("v", F.lit(p)) for p in FRACTIONS])
    got = percentiles(values, ["k"], F.col("v"), FRACTIONS, direct, small)
    rows = lambda df: sorted((r[0], r[1], *map(bits, r[2:])) for r in df.collect())
    assert rows(got) == rows(want)


def test_empty(values):
    assert percentiles(values.limit(0), ["k", "odd"], F.col("v"), [0.5], 0).count() == 0
