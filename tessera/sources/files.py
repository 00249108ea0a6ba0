"""Files of rasters: what a folder holds, and where the raster that a layer shows lies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files under a folder with name, stem, suffix (lower case, null without one), length and time; contents are not read.
    Folders named ``key=value`` give columns."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "false").load(path).drop("content")
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.nullif(F.regexp_extract(name, r"^.+\.([^.]+)$", 1), F.lit("")))
    return df.withColumns({"name": name, "stem": F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1), "suffix": suffix})


def catalogue(rasters: DataFrame, files: DataFrame, suffixes: list[str]) -> DataFrame:
    """Each raster with its file (by raster_id, of several the first path) and ``state``: ok, unsupported or missing."""
    first = files.groupBy("raster_id").agg(F.min(F.struct("path", "suffix", "length")).alias("file"))
    suffix = F.col("file.suffix")
    state = F.when(F.col("file").isNull(), "missing").when(F.coalesce(suffix.isin(suffixes), F.lit(False)), "ok").otherwise("unsupported")
    return rasters.join(first, "raster_id", "left").select(rasters["*"], F.col("file.path").alias("path"), F.col("file.length").alias("length"), state.alias("state"))


def path_of(layers: DataFrame, opened: DataFrame, active: Column, fallback: Column) -> DataFrame:
    """Path of the active layer's raster (layers: layer_id, raster_id; opened: raster_id, path); of ``fallback``, the raster that
    was opened last, if the layer has none; null if neither has."""
    paths = opened.select("raster_id", "path").where("path IS NOT NULL")
    df = layers.where(F.col("layer_id") == active).join(paths, "raster_id", "left").select("layer_id", F.lit(0).alias("turn"), "path")
    last = layers.where(F.col("layer_id") == active).withColumn("raster_id", fallback).join(paths, "raster_id", "left").select("layer_id", F.lit(1).alias("turn"), "path")
    return df.unionByName(last).groupBy("layer_id").agg(F.min_by("path", F.when(F.col("path").isNotNull(), F.col("turn"))).alias("path"))
