"""Undo and redo in slices against a plain replay."""

from __future__ import annotations

import random

import pytest

from tessera.operators.corrections import Summary, effective, replay


def standing(actions):
    history, cursor = [], 0
    for i, a in enumerate(actions):
        if a == "undo":
            cursor = max(0, cursor - 1)
        elif a == "redo":
            cursor = min(len(history), cursor + 1)
        else:
            history[cursor:] = [i]
            cursor += 1
    return history[:cursor]


def acts(rnd, n):
    weights = rnd.choice([(6, 3, 1), (1, 5, 5), (2, 6, 3), (1, 1, 8), (0, 1, 1)])
    return rnd.choices(["edit", "undo", "redo"], weights, k=n)


def test_summaries_are_the_replay():
    rnd = random.Random(1)
    for _ in range(1500):
        a = acts(rnd, rnd.randrange(1, 30))
        s = Summary.unpacked(Summary.of(a).packed())
        for _ in range(12):
            length = rnd.randrange(0, 40)
            cursor = rnd.randrange(0, length + 1)
            c, n, cut, _ = replay(a, cursor, length)
            assert s(cursor, length) == (c, n, float("inf") if cut is None else cut), (a, cursor, length)


@pytest.mark.parametrize("size", [7, 4096])
def test_sessions_in_slices(spark, size):
    rnd = random.Random(2)
    sessions = {k: [x for _ in range(rnd.randrange(1, 12)) for x in acts(rnd, rnd.randrange(1, 25))] for k in range(25)}
    sessions[99] = [x for _ in range(60) for x in acts(rnd, 30)]  # most of all events
    rows = [(k, 10 * i, x, f"{k}:{i}") for k, a in sessions.items() for i, x in enumerate(a)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "session_id long, seq long, action string, note string")
    got = sorted(tuple(r) for r in effective(df, size).collect())
    assert got == sorted((k, 10 * i, a[i], f"{k}:{i}") for k, a in sessions.items() for i in standing(a))
    assert effective(df.limit(0), size).count() == 0
