from __future__ import annotations

from tessera.operators import corrections

RAW = [(1, 0, 0, 0.0, 0.0, 10.0, 10.0, 0.5), (2, 0, 1, 5.0, 5.0, 9.0, 9.0, 0.6), (3, 0, 1, 1.0, 1.0, 2.0, 2.0, 0.1)]
RAW_SCHEMA = "det_id long, raster_id int, class_id int, x1 double, y1 double, x2 double, y2 double, score double"
EVENTS = [
    (1, "edit", 1, 3.0), (2, "delete", 2, None), (3, "undo", None, None),  # the deletion is undone
    (4, "add", 9, 7.0), (5, "add", 10, 8.0), (6, "undo", None, None), (7, "redo", None, None), (8, "delete", 10, None),
    (9, "add", 11, 4.0), (10, "undo", None, None),
]


def tables(spark, events):
    rows = [(1, i, a, d, i, 0 if x else None, x, x, x and x + 1, x and x + 1) for i, a, d, x in events]
    schema = "session_id long, seq long, action string, det_id long, event_id long, raster_id int, x1 double, y1 double, x2 double, y2 double"
    return spark.createDataFrame(RAW, RAW_SCHEMA), spark.createDataFrame(rows, schema)


def test_state_after_undo_with_new_boxes(spark):
    state = corrections.current_state(*tables(spark, EVENTS))
    got = {r.det_id: (r.status, r.x1, r.x2, r.score, r.class_name) for r in state.collect()}
    assert got == {
        1: ("edited", 3.0, 4.0, 0.5, "c0"), 2: ("not_corrected", 5.0, 9.0, 0.6, "c1"), 3: ("not_corrected", 1.0, 2.0, 0.1, "c1"),
        9: ("added", 7.0, 8.0, 1.0, "manual"), 10: ("eliminated", 8.0, 9.0, 1.0, "manual"),
    }


def test_export_needs_an_action(spark):
    for events, want in ((EVENTS, [1, 2, 9]), ([(1, "add", 9, 7.0), (2, "undo", None, None)], [1, 2]), ([(1, "undo", None, None)], [])):
        raw, log = tables(spark, events)
        out = corrections.corrected_export(corrections.current_state(raw, log), log, 0.3, "a reviewer", "2026-01-02")
        assert sorted(r.det_id for r in out.collect()) == want
