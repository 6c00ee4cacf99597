"""Exact quantiles of groups of any size.

Small groups are left to Spark's percentile, which keeps a group's values in one buffer. Groups of
more than `small` rows are searched: each pass counts the values of a bracket in equal bins and
narrows it to the least and greatest value of the bin that holds the wanted rank. A pass keeps a few
numbers for each bin, whatever the group's size; it ends when few values or equal ones are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

BINS = 1024


def _ranked(values: DataFrame, counts: DataFrame, keys: list[str], quantiles: dict[str, float], few: int) -> DataFrame:
    """Rows (keys, quantile's name, value) of large groups."""
    places = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q")) for n, q in quantiles.items()]))
    asked = counts.withColumn("p", places).select(*keys, "p.name", (F.col("p.q") * (F.col("n") - 1)).alias("at"), "lo", "hi", "n")
    ends = F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at"))))
    state = written(asked.withColumn("rank", ends).select(*keys, "name", "at", "rank", "lo", "hi", "n", F.lit(0).cast("long").alias("below")))
    group = [*keys, "name", "rank"]
    steps = Window.partitionBy(*group).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    while not (wide := state.where((F.col("lo") < F.col("hi")) & (F.col("n") > few))).isEmpty():
        met = values.join(wide, keys).where("v BETWEEN lo AND hi")
        place = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
        bins = met.groupBy(*group, "at", "below", place.alias("bin")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
        bins = bins.withColumn("upto", F.col("below") + F.sum("n").over(steps))
        found = bins.where("rank < upto AND rank >= upto - n").select(*group, "at", "lo", "hi", "n", (F.col("upto") - F.col("n")).alias("below"))
        rest = state.join(wide.select(*group), group, "left_anti")
        state = written(rest.unionByName(found.select(*rest.columns)))
    equal = state.where("lo = hi").select(*keys, "name", "at", "rank", F.col("lo").alias("v"))
    order = Window.partitionBy(*group).orderBy("v")
    left = values.join(state.where("lo < hi"), keys).where("v BETWEEN lo AND hi").withColumn("i", F.col("below") + F.row_number().over(order) - 1)
    both = equal.unionByName(left.where("i = rank").select(*keys, "name", "at", "rank", "v"))
    share = F.when(F.floor("at") == F.ceil("at"), 1.0).when(F.col("rank") == F.floor("at"), F.ceil("at") - F.col("at")).otherwise(F.col("at") - F.floor("at"))
    return both.groupBy(*keys, "name").agg(F.sum(F.col("v") * share).alias("v"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], small: int = 1_000_000, few: int = 10_000) -> DataFrame:
    """keys and one column for each quantile (name=share): linear between neighbours, as percentile.
    Missing values are left out; groups without a value have missing quantiles."""
    if any(not 0 <= q <= 1 for q in quantiles.values()):
        raise ValueError("quantiles lie from 0 to 1")
    rows = df.select(*keys, F.col(value).cast("double").alias("v"))
    plain = lambda some: some.groupBy(*keys).agg(*[F.percentile("v", q).alias(n) for n, q in quantiles.items()])
    counts = rows.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where(F.col("n") > small)
    large = written(counts.withColumn("group", F.monotonically_increasing_id()))
    if large.isEmpty():
        return plain(rows)
    named = large.select("group", *[F.col(k).alias(f"_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    values = rows.join(named, same) if keys else rows.crossJoin(F.broadcast(named))  # without keys one row
    values = written(values.where("v IS NOT NULL").select("group", "v"))
    found = _ranked(values, large.select("group", "n", "lo", "hi"), ["group"], quantiles, few)
    found = found.groupBy("group").agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in quantiles])
    found = large.select("group", *keys).join(found, "group").drop("group")
    return plain(rows.join(named, same, "left_anti")).unionByName(found) if keys else found
