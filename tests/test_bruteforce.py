"""Operators that SQL does not express, against plain loops."""

from __future__ import annotations

import random
import time

import pytest

from tessera.operators import dedup
from tessera.operators.components import components
from tessera.streaming import streams

BOX = "det_id long, raster_id int, class_id int, batch_no int, x1 double, y1 double, x2 double, y2 double, score double, border_dist double, edge boolean, tile_id int"
NAMES = [c.split()[0] for c in BOX.split(", ")]


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    i = max(0.0, w) * max(0.0, h)
    u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i
    return i / u if u > 0 else 0.0


def box(r):
    return [r["x1"], r["y1"], r["x2"], r["y2"]]


def boxes(n=600, seed=5):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rnd.choice([rnd.uniform(0, 1900), 500 + rnd.uniform(-30, 30)]), rnd.choice([rnd.uniform(0, 1900), 511 + rnd.uniform(-8, 8)])
        rows.append(dict(zip(NAMES, (i, rnd.randrange(2), rnd.randrange(2), rnd.randrange(5), x, y, x + rnd.uniform(30, 60), y + rnd.uniform(30, 60), rnd.random(), rnd.random(), rnd.random() < 0.3, rnd.randrange(9)))))
    return rows


def fold(rows, threshold):
    out = []
    for r in sorted(rows, key=lambda r: (r["batch_no"], r["det_id"])):
        for g in out:
            if (g["raster_id"], g["class_id"]) == (r["raster_id"], r["class_id"]) and iou(box(g), box(r)) >= threshold:
                p, q = g["score"] * (1 + 0.5 * g["border_dist"]), r["score"] * (1 + 0.5 * r["border_dist"])
                for c in ("x1", "y1", "x2", "y2", "border_dist"):
                    g[c] = (g[c] * p + r[c] * q) / (p + q + 1e-12)
                g.update(score=max(g["score"], r["score"]), edge=g["edge"] and r["edge"], tile_id=g["tile_id"] if p >= q else r["tile_id"], n=g["n"] + 1)
                break
        else:
            out.append(r | {"n": 1})
    return out


def suppress(rows, threshold, key):
    kept = []
    for r in sorted(rows, key=lambda r: (-r["score"], r["det_id"])):
        if all(any(k[c] != r[c] for c in key) or iou(box(k), box(r)) < threshold for k in kept):
            kept.append(r)
    return kept


def same(df, want):
    got = {r["det_id"]: r.asDict() for r in df.collect()}
    assert sorted(got) == sorted(r["det_id"] for r in want)
    for r in want:
        for c, v in r.items():
            assert got[r["det_id"]][c] == v or abs(got[r["det_id"]][c] - v) < 1e-6, (r, got[r["det_id"]])


def test_fuse_batches(spark):
    rows = boxes()
    want = fold([dict(r) for r in rows], 0.3)
    assert any(r["n"] > 2 for r in want)
    same(dedup.fuse_batches(spark.createDataFrame([tuple(r.values()) for r in rows], BOX), 0.3), want)


def test_fuse_batches_without_optional_columns(spark):
    rows = boxes(200, 6)
    cut = NAMES[:9]
    want = fold([r | {"border_dist": 0.0, "edge": False, "tile_id": None} for r in rows], 0.3)
    got = dedup.fuse_batches(spark.createDataFrame([tuple(r.values()) for r in rows], BOX).select(*cut), 0.3)
    assert got.columns == [*cut, "n"]
    same(got, [{c: r[c] for c in [*cut, "n"]} for r in want])


def chain(n=120):
    """A row of boxes over many former blocks, each in reach of the next only, and a box that the fused ones drift into."""
    rows = [dict(zip(NAMES, (i, 0, 0, i * 7 % 5, 40.0 * i * 0.5, 100.0, 40.0 * i * 0.5 + 60, 160.0, 0.2 + (i * 37 % 80) / 100, (i % 10) / 10, i % 3 == 0, i))) for i in range(n)]
    return rows + [dict(zip(NAMES, (1000 + i, 0, 0, 6, 300.0 * i, 112.0, 300.0 * i + 58, 168.0, 0.9, 0.5, False, 1))) for i in range(8)]


@pytest.mark.parametrize("most,threshold", [(20_000, 0.3), (50, 0.3), (20, 0.45)])
def test_fuse_a_chain(spark, most, threshold):
    """One group over the whole raster, folded at once or in waves of groups of few boxes."""
    rows = chain()
    want = fold([dict(r) for r in rows], threshold)
    assert any(r["n"] > (3 if threshold < 0.4 else 1) for r in want)
    same(dedup.fuse_batches(spark.createDataFrame([tuple(r.values()) for r in rows], BOX).repartition(3), threshold, most), want)


def scan(rows, threshold):
    order = sorted(rows, key=lambda r: (-r["score"], r["det_id"]))
    gone, kept = set(), []
    for i, r in enumerate(order):
        if i in gone:
            continue
        for j in range(i + 1, len(order)):
            s = order[j]
            if j in gone or (r["raster_id"], r["class_id"]) != (s["raster_id"], s["class_id"]) or iou(box(r), box(s)) <= threshold:
                continue
            if (r["edge"] and not s["edge"]) or (r["edge"] == s["edge"] and s["border_dist"] > r["border_dist"]):
                gone.add(i)
                break
            gone.add(j)
        if i not in gone:
            kept.append(r)
    return kept


@pytest.mark.parametrize("most", [1_000_000, 4, 0])
def test_scan_with_casualties(spark, most):
    """Boxes that go after they dropped others; streamed by component, in rounds, and both."""
    rows = boxes(500, 9) + [r | {"det_id": r["det_id"] + 5000, "score": r["score"] // 0.2 * 0.2} for r in boxes(300, 10)]
    want = scan(rows, 0.2)
    got = dedup.merge_preferring_inner(spark.createDataFrame([tuple(r.values()) for r in rows], BOX), 0.2, most)
    assert sorted(r.det_id for r in got.collect()) == sorted(r["det_id"] for r in want)


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1150)] + [(5000, 5000 + i) for i in range(60)] + [(9, 9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_legacy_composition(spark):
    rows, key = boxes(400, 7), ["raster_id", "class_id"]
    want = fold(suppress([dict(r) for r in rows], 0.45, [*key, "batch_no"]), 0.45)
    want = suppress(suppress(want, 0.45, key), 0.3, key)
    same(dedup.legacy_composition(spark.createDataFrame([tuple(r.values()) for r in rows], BOX)), [r for r in want if r["score"] >= 0.01])


def test_signature_tells_changes(spark):
    rows = boxes(50, 8)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], BOX)
    assert dedup.changed(df, df.repartition(5)).count() == 0
    assert [r.raster_id for r in dedup.changed(df, df.where("raster_id = 1")).collect()] == [0]


def replayed(rows, s):
    history, cursor = [], 0
    for _, seq, action in (r for r in rows if r[0] == s):
        if action == "undo":
            cursor = max(0, cursor - 1)
        elif action == "redo":
            cursor = min(len(history), cursor + 1)
        else:
            history[cursor:], cursor = [seq], cursor + 1
    return history[:cursor]


def test_sessions_over_several_files_and_a_restart(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(rnd.randrange(4), i, rnd.choice(["add", "edit", "undo", "undo", "redo"])) for i in range(160)]
    kind = "session_id long, seq long, action string"
    for first, last in ((0, 3), (3, 4)):
        for k in range(first, last):
            spark.createDataFrame([r for r in rows if r[1] // 40 == k], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.files_stream(spark, str(tmp_path / "in"), kind)
        changes = streams.run_to_table(streams.standing_events(stream), "sessions", "update", rocksdb=True, at=str(tmp_path / "out"))
        seen = [r for r in rows if r[1] < 40 * last]
        got = sorted(tuple(r) for r in streams.standing(changes).collect())
        assert got == sorted((s, i, seq) for s in range(4) for i, seq in enumerate(replayed(seen, s)))
    # What is written grows with the events, not with the histories.
    assert changes.where("place IS NOT NULL").count() <= sum(r[2] in ("add", "edit") for r in rows)


def test_idle_sessions_are_closed(spark, tmp_path):
    kind = "session_id long, seq long, action string"
    for part in ([(1, 1, "add"), (2, 2, "add"), (1, 3, "edit")], [(2, 4, "undo")]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    changes = streams.standing_events(streams.files_stream(spark, str(tmp_path / "in"), kind), 500)
    before, seen = spark.conf.get(streams.STORE[0]), []
    spark.conf.set(*streams.STORE)
    q = changes.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, _: seen.extend(df.collect())).start()
    try:
        end = time.time() + 90
        while time.time() < end and q.isActive and {r.session_id for r in seen if r.closed} != {1, 2}:
            time.sleep(0.5)
    finally:
        q.stop()
        spark.conf.set(streams.STORE[0], before)
    assert {(r.session_id, r.last_seq, r.cursor) for r in seen if r.closed} == {(1, 3, 2), (2, 4, 0)}


def test_small_classes_are_folded_without_rounds(spark, monkeypatch):
    """One pass for rasters' classes of few boxes, crowds and odd boxes among them; rounds for the larger ones only."""
    nan, rnd = float("nan"), random.Random(8)
    crowd = [r | {"det_id": 2000 + r["det_id"], "raster_id": 1, "class_id": 5} for r in boxes(150, 11)]
    for r in crowd:
        x, y = rnd.uniform(100, 160), rnd.uniform(100, 160)
        r.update(x1=x, y1=y, x2=x + rnd.uniform(2, 40), y2=y + rnd.uniform(2, 40))
    odd = [dict(zip(NAMES, (3000 + i, 0, 0, i % 5, *xy, 0.5, 0.1 * i, False, i))) for i, xy in enumerate([(-5000.0, -5000.0, 9000.0, 9000.0), (-4900.0, -5000.0, 9000.0, 9100.0), (50.0, 50.0, 40.0, 40.0), (7.0, 7.0, 7.0, 7.0), (-130.0, -1.0, 2.0, 140.0), (-128.0, 0.0, 4.0, 138.0)])]
    rows = boxes() + crowd + odd
    want = fold([dict(r) for r in rows], 0.3)
    given = spark.createDataFrame([tuple(r.values()) for r in rows] + [(4000, 0, 0, 3, nan, 1.0, 9.0, 9.0, 0.5, 0.5, False, None)], BOX).repartition(3)
    mixed = dedup.fuse_batches(given, 0.3, 151).where("det_id <> 4000")  # the crowd at once, the other classes in rounds
    same(mixed, want)
    monkeypatch.setattr(dedup, "components", None)
    same(dedup.fuse_batches(given, 0.3).where("det_id <> 4000"), want)
    assert dedup.fuse_batches(given.limit(0), 0.3).count() == 0


class Held:
    """State of one session in memory, which counts the calls that write."""

    def __init__(self):
        self.values, self.writes = {}, 0

    getMapState = getValueState = lambda self, *_: self

    def get(self):
        return self.values.get("ends")

    def getValue(self, key):
        return self.values.get(key)

    def update(self, value):
        self.updateValue("ends", value)

    def updateValue(self, key, value):
        self.values[key], self.writes = value, self.writes + 1


def test_histories_are_written_in_blocks(monkeypatch):
    import pandas as pd

    rnd = random.Random(12)
    for size in (3, 256):
        monkeypatch.setattr(streams, "BLOCK", size)
        state, history = Held(), streams.History()
        history.init(state)
        rows, changes = [], {}
        for k in range(12):
            new = [(7, 1000 * k + i, a) for i, a in enumerate(rnd.choices(["add", "undo", "redo"], rnd.choice([(6, 3, 1), (1, 5, 5), (2, 6, 3)]), k=300))]
            rows, before = rows + new, state.writes
            shuffled = pd.DataFrame(rnd.sample(new, len(new)), columns=["session_id", "seq", "action"])
            (out,) = history.handleInputRows((7,), iter([shuffled[:100], shuffled[100:]]), None)
            assert out["place"].isna().tolist() == [False] * (len(out) - 1) + [True] and set(out["last_seq"]) == {new[-1][1]}
            changes |= dict(zip(out["place"].tolist()[:-1], out["seq"].tolist()[:-1]))
            assert state.writes - before <= 2 + 300 // size
            want, cursor = replayed(rows, 7), state.values["ends"][0]
            assert [changes[p] for p in range(cursor)] == want and set(out["cursor"]) == {cursor}
            assert [state.values[(p // size,)][0][p % size] for p in range(cursor)] == want


def test_legacy_composition_seeks_pairs_twice(spark, monkeypatch):
    """Before the fold, and once for both passes after it."""
    rows = boxes(400, 13)
    fused = fold(suppress(rows, 0.45, ("raster_id", "class_id", "batch_no")), 0.45)
    want = [r for r in suppress(suppress(fused, 0.45, ("raster_id", "class_id")), 0.3, ("raster_id", "class_id")) if r["score"] >= 0.01]
    seen, pairs = [], dedup.overlapping_pairs
    monkeypatch.setattr(dedup, "overlapping_pairs", lambda *a, **k: seen.append(a) or pairs(*a, **k))
    got = dedup.legacy_composition(spark.createDataFrame([tuple(r.values()) for r in rows], BOX))
    assert sorted(r.det_id for r in got.collect()) == sorted(r["det_id"] for r in want)
    assert len(seen) == 2
