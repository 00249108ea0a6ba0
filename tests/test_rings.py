"""Simple rings and diameters against plain loops over all pairs."""

from __future__ import annotations

import math
import random
import time
from fractions import Fraction

import numpy as np
import pytest

from tessera.functions import geo as G
from tessera.functions.rings import is_simple, widest


def meet(p, q, r, s):
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    on = lambda a, b, c: side(a, b, c) == 0 and min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])
    if any((on(p, q, r), on(p, q, s), on(r, s, p), on(r, s, q))):
        return True
    return (side(p, q, r) > 0) != (side(p, q, s) > 0) and (side(r, s, p) > 0) != (side(r, s, q) > 0) and 0 not in (side(p, q, r), side(p, q, s), side(r, s, p), side(r, s, q))


def plain(ring):
    r = [tuple(map(Fraction, p)) for i, p in enumerate(ring) if not i or p != ring[i - 1]]
    if len(r) > 1 and r[0] == r[-1]:
        r.pop()
    n = len(r)
    if n < 3:
        return False
    e = [(r[i], r[(i + 1) % n]) for i in range(n)]
    for i in range(n):
        (a, b), (_, c) = e[i], e[(i + 1) % n]
        u, v = (b[0] - a[0], b[1] - a[1]), (c[0] - b[0], c[1] - b[1])
        if u[0] * v[1] == u[1] * v[0] and u[0] * v[0] + u[1] * v[1] < 0:
            return False
    return not any(meet(*e[i], *e[j]) for i in range(n) for j in range(i + 2, n) if (i, j) != (0, n - 1))


def test_simple_rings_of_small_numbers():
    rnd = random.Random(3)
    seen = set()
    for _ in range(6000):
        ring = [(rnd.randrange(5), rnd.randrange(5)) for _ in range(rnd.randrange(0, 8))]
        want = plain(ring)
        seen.add((want, len(ring)))
        assert is_simple(np.array(ring, float).reshape(-1, 2)) == want, ring
    assert {(True, 5), (False, 5), (True, 6)} <= seen


@pytest.mark.parametrize("ring,want", [([(0, 0), (4, 0), (4, 4), (0, 4)], True), ([(0, 0), (4, 4), (4, 0), (0, 4)], False), ([(0, 0), (4, 0), (6, 0), (4, 0), (4, 4)], False), ([(0, 0), (4, 0), (4, 4), (2, 0), (0, 4)], False), ([(0, 0), (4, 0), (4, 2), (3, 0), (1, 0), (0, 4)], False)])
def test_kinds(spark, ring, want):
    assert plain(ring) == want
    df = spark.createDataFrame([([(float(x), float(y)) for x, y in ring],), (None,)], "ring array<struct<x double, y double>>")
    assert [r[0] for r in df.select(G.simple(df.ring)).collect()] == [want, None]


def test_diameters():
    rnd = random.Random(4)
    for _ in range(800):
        ring = [(rnd.randrange(7), rnd.randrange(7)) for _ in range(rnd.randrange(1, 12))] if rnd.random() < 0.5 else [(rnd.gauss(0, 1), rnd.gauss(0, 3)) for _ in range(rnd.randrange(1, 60))]
        assert math.isclose(widest(np.array(ring, float)), max(math.dist(p, q) for p in ring for q in ring), abs_tol=1e-12)
    assert widest(np.zeros((0, 2))) is None


def test_a_hundred_thousand_vertices():
    t = np.arange(100_000) * (2 * np.pi / 100_000)
    ring = np.stack([np.cos(t), np.sin(t)], axis=1) * (1000 + 5 * np.sin(50 * t))[:, None]
    start = time.time()
    assert is_simple(ring) and abs(widest(ring) - 2010) < 1e-3
    ring[77_777] = ring[77_770]
    assert not is_simple(ring)
    assert time.time() - start < 60
