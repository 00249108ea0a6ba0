"""Which input band fills which slot of a model."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geo import let

#: Keywords in the order in which they are tried, and their slots.
KEYWORDS = [("coastal", 0), ("blue", 1), ("green", 2), ("yellow", 3), ("red", 4), ("edge", 5), ("nir", 6), ("near", 6), ("ir", 7)]
#: Slot -> band (from 0) by band count; 8 and more bands fill slots 0 to 7 in order.
PROFILES = {3: {4: 0, 2: 1, 1: 2}, 4: {4: 0, 2: 1, 1: 2, 6: 3}, 5: {4: 0, 2: 1, 1: 2, 5: 3, 6: 4}, 7: {1: 0, 2: 1, 4: 2, 6: 5}}
SLOTS = 8


def keyword_slot(description: Column) -> Column:
    """Slot of the first keyword that the description holds; null if none."""

    def first(text: Column) -> Column:
        out = F.lit(None).cast("int")
        for word, slot in reversed(KEYWORDS):
            out = F.when(text.contains(word), F.lit(slot)).otherwise(out)
        return out

    return let(F.lower(description), first)


def profile(n: Column) -> Column:
    """Map of slots to bands (from 0) for a raster of n bands; empty where none is known."""
    out = F.create_map().cast("map<int,int>")
    for k, slots in PROFILES.items():
        out = F.when(n == k, F.create_map(*[F.lit(x) for pair in slots.items() for x in pair])).otherwise(out)
    each = F.sequence(F.lit(0), F.lit(SLOTS - 1))
    return F.when(n >= SLOTS, F.map_from_arrays(each, each)).otherwise(out)


def routed(descriptions: Column, n: Column) -> Column:
    """Map of slots to bands (from 0) by keywords; the last band of a slot wins. With fewer than min(n, 3) slots found, the profile."""
    found = F.transform(descriptions, lambda d, i: F.struct(keyword_slot(d).alias("slot"), i.alias("band")))

    def lasts(found: Column) -> Column:
        at = lambda s: F.array_max(F.transform(F.filter(found, lambda f: f["slot"] == s), lambda f: f["band"]))
        return F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda s: F.struct(s.alias("key"), at(s).alias("value")))

    by_word = F.coalesce(F.map_from_entries(F.filter(let(found, lasts), lambda e: e["value"].isNotNull())), F.create_map().cast("map<int,int>"))
    return let(by_word, lambda m: F.when(F.size(m) < F.least(n, F.lit(3)), profile(n)).otherwise(m))


def rgb_indices(mapping: Column, n: Column) -> Column:
    """(r, g, b): the bands (from 0) of slots 4, 2 and 1, else 0, 1 and 2 as far as there are bands."""
    at = lambda slot, i: F.coalesce(F.try_element_at(mapping, F.lit(slot)), F.least(F.lit(i), n - 1))
    return F.struct(F.coalesce(F.try_element_at(mapping, F.lit(4)), F.lit(0)).alias("r"), at(2, 1).alias("g"), at(1, 2).alias("b"))


def slotted(pixels: DataFrame, mappings: DataFrame) -> DataFrame:
    """Pixels in slots 0 to 7 by each raster's ``mapping``; slots without a band, and bands out of range, are 0.

    A pixel's bands are gathered once, then spun to the slots: one shuffle, no row for what is not there.
    """
    wide = pixels.groupBy("raster_id", "row", "col").agg(F.map_from_entries(F.collect_list(F.struct("band", "value"))).alias("m"))
    df = wide.join(mappings.select("raster_id", "mapping"), "raster_id").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    value = F.try_element_at("m", F.try_element_at("mapping", F.col("slot")) + 1)
    return df.select("raster_id", "slot", "row", "col", F.coalesce(value, F.lit(0.0)).alias("value"))


def greedy_assignment(references: DataFrame, means: DataFrame) -> DataFrame:
    """References (slot, source, mean) against each raster's band means: again and again the smallest difference among
    the slots and bands left; ties go to the first slot, source, band. Few rows a raster, rasters in parallel."""
    pairs = means.crossJoin(references.withColumnRenamed("mean", "ref")).withColumn("diff", F.abs(F.col("ref") - F.col("mean")))

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["diff", "slot", "source", "band"])
        slots, bands, out = set(), set(), []
        for r in pdf.itertuples():
            if r.slot not in slots and r.band not in bands:
                slots.add(r.slot), bands.add(r.band), out.append((r.raster_id, r.slot, r.band, r.source, r.diff))
        return pd.DataFrame(out, columns=["raster_id", "slot", "band", "source", "diff"])

    return pairs.groupBy("raster_id").applyInPandas(assign, "raster_id int, slot int, band int, source string, diff double")


def strategy(n_slots: Column, n_bands: Column, manual: Column, multiref: Column, forced: Column) -> Column:
    """Precedence: manual, identity, multi-reference, adaptive if forced, else an error."""
    return F.when(manual, "manual").when((n_slots == n_bands) & ~multiref, "identity").when(multiref, "multiref").when(forced, "adaptive").otherwise("error")


def mismatch(assignment: DataFrame, limit: float = 0.05) -> DataFrame:
    df = assignment.groupBy("raster_id").agg(F.max("diff").alias("max_diff"), F.count("*").alias("n_slots"))
    return df.withColumn("attention", F.col("max_diff") > limit)


def band_mismatch(rasters: DataFrame, assignment: DataFrame, n_slots: int, multiref: Column, limit: float = 0.05) -> DataFrame:
    """Whether a raster's bands need attention: with one reference if their number is not that of the slots (``max_diff`` is by
    how many), with several if an assigned band is further than ``limit`` from its reference; without any assignment 0."""
    worst = mismatch(assignment, limit).select("raster_id", F.col("max_diff").alias("worst"))
    df = rasters.withColumn("multiref", multiref).join(worst, "raster_id", "left")
    off = F.abs(F.col("bands") - n_slots).cast("double")
    diff = F.when(F.col("multiref"), F.coalesce(F.round("worst", 6), F.lit(0.0))).otherwise(off)  # six decimals, as it is reported
    df = df.select("raster_id", F.col("bands").alias("n_bands"), F.lit(n_slots).alias("expected"), "multiref", diff.alias("max_diff"))
    return df.withColumn("attention", F.when(F.col("multiref"), F.col("max_diff") > limit).otherwise(F.col("max_diff") > 0))


def checked_mapping(mapping: DataFrame, rasters: DataFrame, slots: list[int]) -> DataFrame:
    """Manual mapping (raster_id, slot, input_band) over the expected slots of each raster: status ok, blank, out_of_range
    (an error), duplicate (a warning); unknown slots are left out."""
    expected = rasters.select("raster_id", "bands", F.explode(F.array(*map(F.lit, slots))).alias("slot"))
    # Sizes are guessed without the rows that explode adds, so a join by guess would send the mapping through the driver.
    df = expected.join(mapping.hint("merge"), ["raster_id", "slot"], "left")
    same = F.count("*").over(Window.partitionBy("raster_id", "input_band"))
    status = F.when(F.col("input_band").isNull(), "blank").when(~F.col("input_band").between(1, F.col("bands")), "out_of_range").when(same > 1, "duplicate").otherwise("ok")
    return df.select("raster_id", "slot", "input_band", status.alias("status"))


#: What bands are called, by the number of bands.
BAND_NAMES = {
    3: ["Red", "Green", "Blue"],
    4: ["Red", "Green", "Blue", "NIR/Alpha"],
    7: ["Blue", "Green", "Red", "NIR", "Red Edge", "Red Edge 2", "Red Edge 3"],
}


def band_label(band: Column, n: Column) -> Column:
    """Label of a band (from 1) of n; seven and more bands are named alike."""
    name = F.lit(None).cast("string")
    for k, names in BAND_NAMES.items():
        name = F.when(n >= k if k == 7 else n == k, F.get(F.array(*map(F.lit, names)), band - 1)).otherwise(name)
    plain = F.concat(F.lit("Band "), band.cast("string"))
    return F.coalesce(F.concat(plain, F.lit(" ("), name, F.lit(")")), plain)
