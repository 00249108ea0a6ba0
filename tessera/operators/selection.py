"""Exact percentiles of groups of any size by distributed selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.storage import discard, materialize, maybe_broadcast

#: Values of a group up to which one task may hold them all, and of an interval up to which one task may sort them.
DIRECT, SMALL = 1_000_000, 10_000
BINS = 1024


def percentiles(df: DataFrame, key: list[str], value: Column, fractions: list[float], direct: int = DIRECT, small: int = SMALL) -> DataFrame:
    """(key..., n, low, high, p0, p1, ...): count, least and greatest value and the interpolated percentiles of each group
    that has a value; nulls do not count, NaN is greater than all. Bit by bit what ``percentile`` gives.

    No task gets a group's values if there are over ``direct`` of them. The interval of each wanted rank is cut into
    ``BINS`` bins; counts, least and greatest values of the bins are combined before they are shuffled; the bin that holds
    the rank is the next interval, until its values are equal, or few enough to be sorted.
    """
    v = df.select(*key, value.cast("double").alias("_v")).where("_v IS NOT NULL")
    number = F.when(~F.isnan("_v"), F.col("_v"))
    names = [f"p{i}" for i in range(len(fractions))]
    groups = materialize(v.groupBy(*key).agg(F.count("*").alias("n"), F.count(number).alias("_numbers"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.min(number).alias("lo"), F.max(number).alias("hi")), "groups")
    if (groups.agg(F.max("n")).first()[0] or 0) <= direct:
        found = v.groupBy(*key).agg(*[F.percentile("_v", F.lit(p)).alias(c) for c, p in zip(names, fractions)])
        return groups.select(*key, "n", "low", "high").join(found, key)
    place = {f"_at{i}": (F.col("n") - 1) * F.lit(p) for i, p in enumerate(fractions)}
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(c), F.ceil(c)) for c in place.values()])))
    wanted = groups.select(*key, "n", "_numbers", "lo", "hi", F.explode(ranks).alias("rank"))
    state = materialize(wanted.where("rank < _numbers").select(*key, "rank", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("_numbers").alias("inside")), "ranks")
    here = [*key, "lo", "hi"]
    wide = (F.col("lo") < F.col("hi")) & (F.col("inside") > small)
    while not state.where(wide).isEmpty():
        share = F.nanvl((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.5))
        bin_ = F.when(F.col("_v") == F.col("lo"), 0).when(F.col("_v") == F.col("hi"), BINS + 1).otherwise(1 + F.least(F.floor(share * BINS), F.lit(BINS - 1)))
        bins = _within(v, state.where(wide), key).groupBy(*here, bin_.alias("_bin")).agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        bins = bins.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*here).orderBy("_bin")))
        local = F.col("rank") - F.col("below")
        hit = state.where(wide).join(bins, here).where((local < F.col("_upto")) & (local >= F.col("_upto") - F.col("_c")))
        hit = hit.select(*key, "rank", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), (F.col("below") + F.col("_upto") - F.col("_c")).alias("below"), F.col("_c").alias("inside"))
        old, state = state, materialize(state.where(~wide).unionByName(hit), "ranks")
        discard(old)
    rest = state.where("lo < hi")
    order = F.row_number().over(Window.partitionBy(*here).orderBy("_v")) - 1
    sorted_ = _within(v, rest, key).withColumn("_i", order)
    picked = rest.join(sorted_, here).where(F.col("rank") - F.col("below") == F.col("_i")).select(*key, "rank", "_v")
    picked = picked.unionByName(state.where("lo = hi").select(*key, "rank", F.col("lo").alias("_v"))).unionByName(wanted.where("rank >= _numbers").select(*key, "rank", F.lit(float("nan")).alias("_v")))
    values = picked.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("rank", "_v"))).alias("_values"))
    out = groups.withColumns(place).join(values, key)

    def between(at: Column) -> Column:
        a, b = (F.element_at("_values", f(at)) for f in (F.floor, F.ceil))
        return F.when(a == b, a).otherwise((F.ceil(at) - at) * a + (at - F.floor(at)) * b)

    return out.select(*key, "n", "low", "high", *[between(F.col(f"_at{i}")).alias(c) for i, c in enumerate(names)])


def _within(v: DataFrame, state: DataFrame, key: list[str]) -> DataFrame:
    """Values in the intervals of ``state``, with these; each interval counts once however many ranks it holds."""
    intervals = materialize(state.select(*key, "lo", "hi").distinct(), "intervals")
    return v.join(maybe_broadcast(intervals), key).where(F.col("_v").between(F.col("lo"), F.col("hi")))
