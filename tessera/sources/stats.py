"""Band statistics as JSON texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ONE = "mean: double, p_low: double, p_high: double"
SCHEMA = f"map<string, struct<{_ONE}, sources: map<string, struct<{_ONE}>>>>"


def band_statistics(files: DataFrame) -> DataFrame:
    """Rows (raster_id, slot, source, mean, p_low, p_high) of JSON objects ``text`` by slot: one of each source, or one
    without a source where a slot has plain statistics. Texts that are no such object give no row."""
    df = files.select("raster_id", F.explode(F.from_json("text", SCHEMA)).alias("slot", "s"))
    own = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.struct("s.mean", "s.p_low", "s.p_high").alias("value")))
    df = df.select("raster_id", F.expr("try_cast(slot AS int)").alias("slot"), F.explode(F.coalesce(F.map_entries("s.sources"), own)).alias("e"))
    return df.select("raster_id", "slot", F.col("e.key").alias("source"), "e.value.*")
