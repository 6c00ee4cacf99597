"""Growing inputs: same-day merging of scenes and tower sums as Structured Streaming plans.

The batch operators see whole tables; these forms close a day when the watermark has passed it
and keep only open days as state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stack import PIXEL


def daily_scenes(scenes: DataFrame, values: list[str], keys: list[str] = PIXEL, ts: str = "scene_ts", late: str = "2 days") -> DataFrame:
    """Mean of a day's scenes per key, without a value where one of them shows snow."""
    days = scenes.withWatermark(ts, late).groupBy(F.window(ts, "1 day"), *keys)
    merged = days.agg(F.max(F.col("is_snow").cast("int")).alias("_snow"), *[F.avg(v).alias(v) for v in values])
    snow = F.coalesce(F.col("_snow"), F.lit(0)) == 1
    return merged.select(*keys, F.to_date("window.start").alias("date"), snow.alias("is_snow"), *[F.when(~snow, F.col(v)).alias(v) for v in values])


def rolling_rain(obs: DataFrame, keys: list[str], rain: str, ts: str = "t", span: str = "24 hours", step: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Rain of the last hours at each step."""
    return obs.withWatermark(ts, late).groupBy(F.window(ts, span, step), *keys).agg(F.sum(rain).alias("rain")).select(*keys, F.col("window.end").alias(ts), "rain")
