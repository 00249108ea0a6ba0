"""Refusals."""

from __future__ import annotations

import pytest

from tessera.functions import sql
from tessera.operators import checks, corrections, saved


def test_boxes_without_size_fail(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0), (2, 3.0, 0.0, 3.0, 2.0)], "det_id long, x1 double, y1 double, x2 double, y2 double")
    assert checks.asserted(df.where("det_id = 1")).count() == 1
    with pytest.raises(Exception, match="box without size: 2"):
        checks.asserted(df).collect()


def test_unknown_models_fail(spark):
    models = spark.createDataFrame([("a", "x")], "model_name string, description string")
    assert saved.model_named(models, "a").count() == 1
    with pytest.raises(ValueError, match="not registered"):
        saved.model_named(models, "b")


def test_exports_need_reviewer_and_date(spark):
    for reviewer, day in (("", "2026-01-01"), ("a reviewer", "")):
        with pytest.raises(ValueError, match="mandatory"):
            corrections.corrected_export(None, None, 0.1, reviewer, day)


def test_tile_windows_in_sql(spark):
    sql.register(spark)
    rows = spark.sql("SELECT t.k, g.* FROM VALUES (1, 100, 30), (2, 40, 40), (3, NULL, 5) t(k, w, h), LATERAL tile_windows(t.w, t.h, 40, 10) g").collect()
    assert [tuple(r) for r in sorted(rows)] == [(1, 1, 0, 0, 40, 30), (1, 2, 30, 0, 40, 30), (1, 3, 60, 0, 40, 30), (2, 1, 0, 0, 40, 40)]
    with pytest.raises(Exception, match="overlap must be less"):
        spark.sql("SELECT * FROM tile_windows(10, 10, 4, 4)").collect()
